"""Per-key aggregation: groups, ageing, bounded profiles, last values."""

from __future__ import annotations



import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_key(df: DataFrame, keys: list[str], **measures: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])


def hierarchy(df: DataFrame, keys: list[str], **measures: Column) -> DataFrame:
    """One row for each group at each level of nested keys, and the total; level is the number of keys that hold."""
    level = F.lit(len(keys)) - sum((F.grouping(k).cast("int") for k in keys), F.lit(0))
    return df.rollup(*keys).agg(level.alias("level"), *[c.alias(n) for n, c in measures.items()])


def blend(old: Column, new: Column, weight: float) -> Column:
    """weight * new + (1 - weight) * old, absent sides counting as 0."""
    return F.lit(weight) * F.coalesce(new, F.lit(0.0)) + F.lit(1 - weight) * F.coalesce(old, F.lit(0.0))


def age(column: Column, weight: float) -> Column:
    return column * F.lit(1 - weight)


def capped(column: Column, cap: int) -> Column:
    return F.least(column, F.lit(cap)).cast("tinyint" if cap < 128 else "int")


def last_per_key(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def top_n(df: DataFrame, keys: list[str], item: str, n: int) -> DataFrame:
    """(keys, rank, item, count): the n most frequent items of a key, ties by item, and rank n + 1 with the sum of the rest and no item."""
    counts = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), item))
    ranked = counts.withColumn("rank", F.least(rank, F.lit(n + 1)))
    return ranked.groupBy(*keys, "rank").agg(F.when(F.col("rank") <= n, F.max(item)).alias(item), F.sum("count").alias("count"))


def top_n_lossy(df: DataFrame, keys: list[str], item: str, seq: str, n: int) -> DataFrame:
    """(keys, item, weight): n slots for a key filled in order of seq; a new item beyond them replaces the oldest slot, whose weight goes to item null.

    The victim's turn goes round per key, so keys are independent of one another.
    """

    def fill(batch: pd.DataFrame) -> pd.DataFrame:
        slots: dict = {}
        lost = 0
        for x in batch.sort_values(seq)[item]:
            if x in slots:
                slots[x] += 1
            else:
                if len(slots) == n:
                    lost += slots.pop(next(iter(slots)))
                slots[x] = 1
        rows = [*slots.items(), *([(None, lost)] if lost else [])]
        out = pd.DataFrame(rows, columns=[item, "weight"])
        for k in reversed(keys):
            out.insert(0, k, batch[k].iloc[0])
        return out

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {item} {kinds[item]}, weight bigint"
    return df.select(*keys, item, seq).groupBy(*keys).applyInPandas(fill, schema)


__all__ = ["age", "blend", "capped", "hierarchy", "last_per_key", "per_key", "top_n", "top_n_lossy"]
