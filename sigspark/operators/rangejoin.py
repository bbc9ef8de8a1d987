"""Joins of points with ranges, by blocks of keys, so that Spark joins on equal blocks and never compares all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(ranges: DataFrame, low: str, high: str, points: DataFrame, key: str, block: int = 64) -> DataFrame:
    """Rows of ranges with each row of points whose key is in [low, high]; a wide range is listed once for each block of keys it meets."""
    cell = lambda c: F.floor(F.col(c) / block).cast("long")
    spread = ranges.where(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    met = spread.join(points.withColumn("_cell", cell(key)), "_cell")
    return met.where(F.col(key).between(F.col(low), F.col(high))).drop("_cell")
