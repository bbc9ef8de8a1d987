"""Begin and end events of a key and of nested keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import RANK, ahead, back, neighbours, order_columns, ranked


def prefix_flags(df: DataFrame, keys: list[str], seq: str, levels: list[list[str]] | None = None) -> DataFrame:
    """begin_<i>, end_<i> for each prefix of the sort keys (fast path: one partitioned window per level).

    Equal prefixes are adjacent in the sort order, so the first and last row of a prefix are the borders that a
    neighbour comparison finds.
    """
    order = order_columns(df, keys, seq)
    levels = levels or [keys[: i + 1] for i in range(len(keys))]
    for level in levels:
        if level != keys[: len(level)]:
            raise ValueError(f"{level} is not a prefix of the sort keys {keys}; use run_flags")
    for i, level in enumerate(levels):
        w = Window.partitionBy(*level).orderBy(*order)
        df = df.withColumns({f"begin_{i}": F.row_number().over(w) == 1, f"end_{i}": F.lead(F.lit(1)).over(w).isNull()})
    return df


def run_flags(df: DataFrame, keys: list[str] | None, seq: str, watched: list[list[str]], partitions: int | None = None) -> DataFrame:
    """begin_<i>, end_<i> of runs of equal values of each watched column list, over the whole sorted stream."""
    columns = {}
    for i, cols in enumerate(watched):
        here = F.struct(*cols)
        columns[f"begin_{i}"] = F.coalesce(~back(here).eqNullSafe(here), F.lit(True))
        columns[f"end_{i}"] = F.coalesce(~ahead(here).eqNullSafe(here), F.lit(True))
    out = neighbours(ranked(df, keys, seq, partitions), columns, 1, 1)
    for i in range(len(watched)):
        out = out.withColumn(f"begin_{i}", F.col(f"begin_{i}"))
    return out


__all__ = ["RANK", "prefix_flags", "run_flags"]
