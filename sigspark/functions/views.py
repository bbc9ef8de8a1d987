"""Views: pairs of types with conversions both ways. Ranges: bounded integers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class View:
    """A logical and a physical side, with the conversion to each."""

    to_physical: Callable[[Column], Column]
    to_logical: Callable[[Column], Column]

    @classmethod
    def same(cls) -> View:
        return cls(lambda c: c, lambda c: c)

    @classmethod
    def record(cls, **fields: View) -> View:
        """A view of structs from views of their fields."""

        def side(pick):
            return lambda c: F.struct(*[pick(v)(c[n]).alias(n) for n, v in fields.items()])

        return cls(side(lambda v: v.to_physical), side(lambda v: v.to_logical))

    def array(self) -> View:
        return View(lambda c: F.transform(c, self.to_physical), lambda c: F.transform(c, self.to_logical))

    def then(self, other: View) -> View:
        return View(lambda c: other.to_physical(self.to_physical(c)), lambda c: self.to_logical(other.to_logical(c)))


@dataclass(frozen=True)
class Range:
    """Integers low..high, both inclusive."""

    low: int
    high: int

    def __post_init__(self) -> None:
        if self.low > self.high:
            raise ValueError(f"range {self.low} .. {self.high} is empty")

    def holds(self, column: Column) -> Column:
        return F.coalesce(column.between(self.low, self.high), F.lit(False))

    def checked(self, column: Column, name: str = "value") -> Column:
        """The column, raising where it is outside the range."""
        return F.when(self.holds(column), column).otherwise(F.raise_error(F.format_string(f"{name} %s is outside {self.low} .. {self.high}", column.cast("string"))).cast("bigint"))
