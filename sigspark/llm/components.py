"""Connected components by alternating large and small stars: joins and sums only, nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import release, stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m"))


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(u, v): v is the smallest node of u's component, for each node of an edge (u, v of bigint) that isn't itself smallest."""
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).withColumn("m", F.least("m", "m_u"))
        large = both.join(least, both["u"] == least["m_u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _least(large)
        small = large.join(least, large["u"] == least["m_u"]).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select(F.col("m_u").alias("u"), F.col("m").alias("v"))).distinct()
        after = stage(small, "edges")
        was, mark = mark, _mark(after)
        release(now)
        now = after
        if mark == was:
            return now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
