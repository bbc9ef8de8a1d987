"""Keyed maps: a key domain, a value, a default for absent keys. Only present keys are rows of the table.

Every operation returns a new map over an immutable table, so a copy is free and a map may be read while its next
version is computed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


#: Arrival number of a record, as sources make it.
SEQ = "_seq"


class DomainError(ValueError):
    """A key lies outside the map's domain."""


@dataclass(frozen=True)
class MapSpec:
    """keys: (column, low, high) of each key level, bounds inclusive; value columns; default: constants, or columns of the keys and parameters."""

    keys: tuple[tuple[str, int, int], ...]
    values: tuple[str, ...]
    default: dict[str, Any] | Callable[..., dict[str, Column]] = field(default_factory=dict)
    params: tuple = ()
    split: tuple[int, int] | None = None
    #: Codec of an entry, or of a stripe when its columns are windows over ``stripe_window()``; drop: entries to remove when written.
    encode: Callable[[dict[str, Column]], dict[str, Column]] | None = None
    decode: Callable[[dict[str, Column]], dict[str, Column]] | None = None
    drop: Callable[[dict[str, Column]], Column] | None = None

    def __post_init__(self) -> None:
        if not self.keys or not self.values:
            raise ValueError("a map needs a key and a value")
        for name, low, high in self.keys:
            if low > high:
                raise ValueError(f"{name}: low {low} is above high {high}")
        if (self.encode is None) != (self.decode is None):
            raise ValueError("encode and decode come together")
        if self.drop and not self.encode:
            raise ValueError("only a codec drops entries")
        if self.split and len(self.keys) > 1:
            raise ValueError("only a map with one key column is split")

    @property
    def key_names(self) -> list[str]:
        return [k for k, _, _ in self.keys]

    def stripe_window(self) -> WindowSpec:
        """All entries of a stripe, for codecs that see a stripe at once."""
        block, stripe, _ = self.split_columns()
        return Window.partitionBy(block, stripe)

    def encoded(self, rows: DataFrame) -> DataFrame:
        """rows as they are stored: without the entries that the codec drops, values encoded."""
        if not self.encode:
            return rows
        values = {v: F.col(v) for v in self.values}
        kept = rows.where(~F.coalesce(self.drop(values), F.lit(False))) if self.drop else rows
        return kept.withColumns(self.encode(values))

    def defaults(self) -> dict[str, Column]:
        if callable(self.default):
            return self.default(*[F.col(k) for k in self.key_names], *self.params)
        return {v: F.lit(self.default.get(v, 0)) for v in self.values}

    def in_domain(self) -> Column:
        ok = F.lit(True)
        for name, low, high in self.keys:
            ok = ok & F.col(name).between(low, high)
        return F.coalesce(ok, F.lit(False))

    def split_columns(self) -> tuple[Column, Column, Column]:
        """Block, stripe and entry of a key."""
        if not self.split:
            raise ValueError("the map has no split")
        (name, low, _), (block, stripe) = self.keys[0], self.split
        off = F.col(name) - low
        rest = off % block
        return F.expr(f"({name} - {low}) div {block}"), F.floor(rest / stripe).cast("long"), (rest % stripe).cast("long")



@dataclass(frozen=True)
class PMap:
    spec: MapSpec
    table: DataFrame
    const: bool = False

    @classmethod
    def empty(cls, spark, spec: MapSpec, value_types: dict[str, str]) -> PMap:
        schema = ", ".join([f"{k} bigint" for k in spec.key_names] + [f"{v} {value_types[v]}" for v in spec.values])
        return cls(spec, spark.createDataFrame([], schema))

    def _read(self) -> DataFrame:
        if not self.spec.decode:
            return self.table
        return self.table.withColumns(self.spec.decode({v: F.col(v) for v in self.spec.values}))

    def bounds(self) -> list[tuple[str, int, int]]:
        return list(self.spec.keys)

    def get(self, rows: DataFrame, errors: str = "raise") -> DataFrame:
        """rows with the map's value columns: stored, or the default of absent keys. Keys outside the domain raise or give null."""
        names = self.spec.key_names
        if errors == "raise":
            self._check(rows)
        stored = self._read().select(*names, *self.spec.values, F.lit(True).alias("_present"))
        out = rows.join(stored, names, "left")
        for v, d in self.spec.defaults().items():
            filled = F.when(F.col("_present"), F.col(v)).otherwise(d)
            out = out.withColumn(v, filled if errors == "raise" else F.when(self.spec.in_domain(), filled))
        return out.drop("_present")

    def _check(self, rows: DataFrame) -> None:
        bad = rows.where(~self.spec.in_domain()).select(*self.spec.key_names).limit(1).collect()
        if bad:
            raise DomainError(f"key {tuple(bad[0])} is outside {self.bounds()}")

    def _writable(self) -> None:
        if self.const:
            raise PermissionError("the map is const")

    def put(self, rows: DataFrame, checked: bool = True, order: str | None = None) -> PMap:
        """The map with rows' values. Of several rows of a key the last in ``order`` counts, the arrival number unless given;
        rows without either that repeat a key fail when the map is read."""
        self._writable()
        names = self.spec.key_names
        if checked:
            self._check(rows)
        order = order or (SEQ if SEQ in rows.columns else None)
        value = F.struct(*self.spec.values)
        if order:
            one = F.max_by(value, order)
        else:
            one = F.when(F.count(F.lit(1)) == 1, F.first(value)).otherwise(F.raise_error(F.lit("a key is put twice and the rows have no order")))
        new = rows.groupBy(*names).agg(one.alias("_one")).select(*names, *[F.col("_one")[v].alias(v) for v in self.spec.values])
        new = self.spec.encoded(new)
        kept = self.table.join(rows.select(*names), names, "left_anti")
        return replace(self, table=kept.select(*names, *self.spec.values).unionByName(new))

    def fold(self, rows: DataFrame, combine: Callable[[Column, Column], Column], checked: bool = True) -> PMap:
        """m[k] = combine(m[k], x) for one row of each key: a full outer join, absent keys read as the default."""
        self._writable()
        names = self.spec.key_names
        if checked:
            self._check(rows)
        new = rows.select(*names, *[F.col(v).alias(f"_new_{v}") for v in self.spec.values], F.lit(True).alias("_seen"))
        both = self._read().withColumn("_present", F.lit(True)).join(new, names, "full")
        defaults = self.spec.defaults()
        for v in self.spec.values:
            old = F.when(F.col("_present"), F.col(v)).otherwise(defaults[v])
            both = both.withColumn(v, F.when(F.col("_seen"), combine(old, F.col(f"_new_{v}"))).otherwise(F.col(v)))
        out = both.select(*names, *self.spec.values)
        return replace(self, table=self.spec.encoded(out))

    def member(self, rows: DataFrame, into: str = "present") -> DataFrame:
        names = self.spec.key_names
        flags = self.table.select(*names).withColumn(into, F.lit(True))
        return rows.join(flags, names, "left").withColumn(into, F.coalesce(into, F.lit(False)))

    def test(self, rows: DataFrame, into: str = "in_domain") -> DataFrame:
        return rows.withColumn(into, self.spec.in_domain())

    def remove(self, rows: DataFrame) -> PMap:
        self._writable()
        return replace(self, table=self.table.join(rows.select(*self.spec.key_names).distinct(), self.spec.key_names, "left_anti"))

    def scan(self, low: tuple | int | None = None, high: tuple | int | None = None) -> DataFrame:
        """Present rows with keys in [low, high], ascending."""
        out = self._read()
        for bound, compare in ((low, "ge"), (high, "le")):
            if bound is None:
                continue
            values = bound if isinstance(bound, tuple) else (bound,)
            if len(values) != len(self.spec.keys):
                raise ValueError("a bound needs a value for each key level")
            for name, v in zip(self.spec.key_names, values):
                out = out.where(F.col(name) >= v if compare == "ge" else F.col(name) <= v)
        return out.orderBy(*self.spec.key_names)

    def copy_to(self, target: PMap) -> PMap:
        """target := this map; the target must be empty and of the same declaration."""
        target._writable()
        if target.spec.keys != self.spec.keys or target.spec.values != self.spec.values:
            raise TypeError("maps of different declarations cannot be copied")
        if not target.table.isEmpty():
            raise ValueError("the target of a copy must be empty")
        return replace(target, table=self.table)


def any_of(*maps: PMap, low: int | None = None, high: int | None = None) -> DataFrame:
    """Keys in one map or more, ascending."""
    out = None
    for m in maps:
        k = m.scan(low, high).select(*m.spec.key_names)
        out = k if out is None else out.unionByName(k)
    return out.distinct().orderBy(*maps[0].spec.key_names)


def all_of(*maps: PMap, low: int | None = None, high: int | None = None) -> DataFrame:
    """Keys in all maps, ascending."""
    names = maps[0].spec.key_names
    out = maps[0].scan(low, high).select(*names)
    for m in maps[1:]:
        out = out.join(m.table.select(*names), names, "left_semi")
    return out.orderBy(*names)
