"""Record streams as a lazy builder: filter, sort, window, detect, handle. The order of execution is fixed, whatever the order of the calls."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import RANK, ahead, back, neighbours, ranked
from ..operators.pmap import PMap
from ..operators.rangejoin import range_join
from .munion import Munion


class WindowView:
    """w[i] of a detector: the record i - offset rows from the current one, as a struct that is null outside the stream."""

    def __init__(self, columns: list[str], size: int, offset: int):
        self.columns, self.size, self.offset = columns, size, offset

    def __getitem__(self, i: int) -> Column:
        if not 0 <= i < self.size:
            raise IndexError(f"window slot {i} of {self.size}")
        record, d = F.struct(*self.columns), i - self.offset
        return record if d == 0 else back(record, -d) if d < 0 else ahead(record, d)


@dataclass(frozen=True)
class Stream:
    """df with seq, the arrival number of its rows."""

    df: DataFrame
    seq: str
    predicates: tuple[Callable[[DataFrame], Column] | Column, ...] = ()
    keys: tuple[str, ...] | None = ()
    size: int = 1
    offset: int = 0
    detector: Callable[[WindowView], Column] | None = None
    munion: Munion | None = None
    partitions: int | None = None

    def filtered(self, predicate: Callable[[DataFrame], Column] | Column) -> Stream:
        return replace(self, predicates=(*self.predicates, predicate))

    def sorted_by(self, *keys: str) -> Stream:
        if self.keys:
            raise ValueError("a stream is sorted once")
        for k in keys:
            if k.split(".")[0] not in self.df.columns:
                raise ValueError(f"sort field {k} is not a member of the record")
        return replace(self, keys=keys)

    def sorted(self) -> Stream:
        return replace(self, keys=None)

    def detect(self, munion: Munion, detector: Callable[[WindowView], Column], size: int = 1, offset: int = 0) -> Stream:
        if not 0 <= offset < size:
            raise ValueError("a window needs 0 <= offset < size")
        if self.detector:
            raise ValueError("a stream has one detector")
        return replace(self, munion=munion, detector=detector, size=size, offset=offset)

    def records(self) -> DataFrame:
        """The rows that pass the filters."""
        df = self.df
        for p in self.predicates:
            df = df.where(p(df) if callable(p) else p)
        return df

    def ordered(self) -> DataFrame:
        """records with _rank, their place in the sort order."""
        return ranked(self.records(), None if self.keys is None else list(self.keys), self.seq, self.partitions)

    def events(self) -> DataFrame:
        """ordered rows with the column event, the detector's multi-union; without a detector one member, record."""
        rows = self.ordered()
        if not self.detector:
            return rows
        view = WindowView(self.df.columns, self.size, self.offset)
        return neighbours(rows, {"event": self.detector(view)}, self.offset, self.size - 1 - self.offset)

    def on(self, *handlers: tuple[str, Callable[[Column], Column]], keep: tuple[str, ...] = ()) -> DataFrame:
        """(_rank, step, name, out), and the record's fields in ``keep``: what each handler makes of its event, in the order the handlers are listed. Events without a handler are ignored."""
        names = [n for n, _ in handlers]
        if len(set(names)) < len(names):
            raise ValueError("an event has one handler")
        rows = self.events()
        made = []
        for i, (name, handle) in enumerate(handlers):
            if self.detector:
                on, value = self.munion.has(F.col("event"), name), (F.col("event") if isinstance(self.munion._member(name), Munion) else self.munion.read(F.col("event"), name))
            else:
                on, value = F.lit(True), F.struct(*self.df.columns)
            made.append(F.when(on, F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), handle(value).alias("out"))))
        steps = F.filter(F.array(*made), lambda x: x.isNotNull())
        return rows.select(RANK, *keep, F.explode(steps).alias("s")).select(RANK, *keep, "s.step", "s.name", "s.out")

    def accumulate(self, by: list[str], state: dict[str, Column], emit: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """Handlers with state: (_rank, by, keep, state) of each row with event ``emit`` (all rows without). A state is an
        aggregate over the rows of the group from its first to this one, in order; it starts anew with each group."""
        w = Window.partitionBy(*by).orderBy(RANK).rowsBetween(Window.unboundedPreceding, 0)
        rows = self.events().withColumns({n: c.over(w) for n, c in state.items()})
        if emit:
            rows = rows.where(self.munion.has(F.col("event"), emit))
        return rows.select(RANK, *by, *keep, *state)

    def iterate(self, keys: PMap, low: Callable[[DataFrame], Column], high: Callable[[DataFrame], Column], event: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """A handler that opens an iterate: for each row with the event (each row without), the map's entries with keys in
        [low, high] of the row: (_rank, keep, key, values)."""
        rows = self.events()
        if event:
            rows = rows.where(self.munion.has(F.col("event"), event))
        (key,) = keys.spec.key_names
        ranges = rows.select(RANK, *keep, low(rows).alias("_low"), high(rows).alias("_high"))
        return range_join(ranges, "_low", "_high", keys.scan().select(key, *keys.spec.values), key).drop("_low", "_high")
