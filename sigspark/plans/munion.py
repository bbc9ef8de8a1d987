"""Multi-unions: records of which any subset of named members is present.

As a column, a multi-union is a struct with a field for each member: a struct {on, value}, or a nested multi-union.
``on`` tells a member that is present with a null or no value from an absent one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Munion:
    """members: a Spark type for the value, None for no value, or a nested Munion."""

    members: dict[str, str | None | Munion]

    def _kind(self, name: str) -> str:
        return self.members[name] or "boolean"

    def _member(self, path: str):
        m = self
        for part in path.split("."):
            if not isinstance(m, Munion) or part not in m.members:
                raise KeyError(f"no member {path}")
            m = m.members[part]
        return m

    def empty(self) -> Column:
        return self.build()

    def build(self, **given: Column | bool) -> Column:
        """Members given a Column are present where the column is not null; True or a boolean Column flags a member without value."""
        for name in given:
            self._member(name)
        fields = []
        for name, kind in self.members.items():
            if isinstance(kind, Munion):
                part = given.get(name)
                fields.append((part if part is not None else kind.empty()).alias(name))
                continue
            x = given.get(name)
            if kind is None:
                on = F.lit(False) if x is None else x if isinstance(x, Column) else F.lit(bool(x))
                fields.append(F.struct(F.coalesce(on, F.lit(False)).alias("on"), F.lit(None).cast("boolean").alias("value")).alias(name))
            elif isinstance(x, bool):
                raise TypeError(f"member {name} needs a value")
            else:
                value = F.lit(None).cast(kind) if x is None else x.cast(kind)
                fields.append(F.struct(value.isNotNull().alias("on"), value.alias("value")).alias(name))
        return F.struct(*fields)

    def _pairwise(self, a: Column, b: Column, leaf: Callable[[Column, Column], Column]) -> Column:
        return F.struct(*[(m._pairwise(a[n], b[n], leaf) if isinstance(m, Munion) else leaf(a[n], b[n])).alias(n) for n, m in self.members.items()])

    def union(self, a: Column, b: Column) -> Column:
        """Members of either; b's value where both have one."""
        return self._pairwise(a, b, lambda x, y: F.when(y["on"], y).otherwise(x))

    def difference(self, a: Column, b: Column) -> Column:
        """a's members that b hasn't, at every level."""
        off = lambda x: F.struct(F.lit(False).alias("on"), F.when(F.lit(False), x["value"]).alias("value"))
        return self._pairwise(a, b, lambda x, y: F.when(y["on"], off(x)).otherwise(x))

    def _change(self, a: Column, path: list[str], make: Callable[[Column, object], Column]) -> Column:
        name, *rest = path
        fields = []
        for n, m in self.members.items():
            x = a[n]
            if n == name:
                x = m._change(x, rest, make) if rest else make(x, m)
            fields.append(x.alias(n))
        return F.struct(*fields)

    def remove(self, a: Column, path: str) -> Column:
        self._member(path)

        def clear(x: Column, m) -> Column:
            if isinstance(m, Munion):
                return m.empty()
            return F.struct(F.lit(False).alias("on"), F.lit(None).cast(m or "boolean").alias("value"))

        return self._change(a, path.split("."), clear)

    def has(self, a: Column, path: str) -> Column:
        """Presence of a member; of a nested one, of any member in it."""
        m = self._member(path)
        for part in path.split("."):
            a = a[part]
        if not isinstance(m, Munion):
            return a["on"]
        out = F.lit(False)
        for n in m.members:
            out = out | m.has(a, n)
        return out

    def read(self, a: Column, path: str) -> Column:
        self._member(path)
        for part in path.split("."):
            a = a[part]
        return a["value"]

    def write(self, a: Column, path: str, value: Column) -> Column:
        self._member(path)
        return self._change(a, path.split("."), lambda x, m: F.struct(F.lit(True).alias("on"), value.cast(m or "boolean").alias("value")))
