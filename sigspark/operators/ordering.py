"""Sorting, global ranks and neighbours over one total order, without a single-partition window.

``ranked`` range-partitions by the order, writes the sorted partitions with their rows numbered (when it is called: the
query isn't lazy up to there), and adds the count of the partitions before (one number per partition, broadcast). Floats
are in total order: -0.0 below 0.0, NaN last. ``neighbours`` cuts the ranks into blocks, lends each block the few rows beyond
its borders, and looks to both sides inside a block; a block is a task's worth of rows however large the input is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..sources.workspace import cut

RANK = "_rank"
BLOCK = 1 << 16


def order_columns(df: DataFrame, keys: list[str] | None, seq: str) -> list[str]:
    """Sort keys and the arrival number that makes the order total; without keys the whole record in field order."""
    keys = list(keys) if keys is not None else [c for c in df.columns if c != seq]
    for k in keys:
        if k not in df.columns:
            raise ValueError(f"sort field {k} is not a member of the record")
    return [*keys, *([seq] if seq not in keys else [])]


def ranked(df: DataFrame, keys: list[str] | None, seq: str, partitions: int | None = None) -> DataFrame:
    """df with _rank: 0, 1, ... in the order of keys, then seq."""
    order = [total_order(c) if isinstance(df.schema[c].dataType, (FloatType, DoubleType)) else F.col(c) for c in order_columns(df, keys, seq)]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # An id is its partition's number, 33 bits up, and the row's place in the sorted partition: one shuffle numbers all rows.
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_base"))
    rank = (F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_base")).cast("long")
    return placed.join(F.broadcast(base), part == F.col("_p")).withColumn(RANK, rank).drop("_id", "_p", "_base")


def neighbours(df: DataFrame, columns: dict[str, Column], before: int, after: int, block: int = BLOCK) -> DataFrame:
    """df, which has _rank, with columns computed over a window that reaches ``before`` rows back and ``after`` ahead.

    A column is built by ``back`` and ``ahead``; rows outside the input are null.
    """
    if before < 0 or after < 0:
        raise ValueError("a window reaches back and ahead by 0 rows or more")
    block = max(block, before + after + 1)
    own = F.floor(F.col(RANK) / block).cast("long")
    at = F.col(RANK) % block
    copies = F.array(own, *([F.when(at < after, own - 1)] if after else []), *([F.when(at >= block - before, own + 1)] if before else []))
    spread = df.withColumn("_block", F.explode(F.filter(copies, lambda x: x.isNotNull())))
    done = spread.withColumns(columns)
    return done.where(F.col("_block") == own).drop("_block")


def _inside():
    return Window.partitionBy("_block").orderBy(RANK)


def back(column: str | Column, n: int = 1) -> Column:
    return F.lag(column, n).over(_inside())


def ahead(column: str | Column, n: int = 1) -> Column:
    return F.lead(column, n).over(_inside())


def total_order(column: str) -> Column:
    """Sort key of a float that also puts -0.0 below 0.0; NaN is last."""
    return F.struct(F.col(column), F.when(F.col(column) == 0, ~F.col(column).cast("string").startswith("-")))


def take_until(df: DataFrame, hit: Column, seq: str) -> DataFrame:
    """Rows up to and with the first row, by seq, for which hit holds; all rows if none does."""
    first = df.where(hit).agg(F.min(seq).alias("_stop"))
    return df.join(F.broadcast(first), F.col("_stop").isNull() | (F.col(seq) <= F.col("_stop"))).drop("_stop")
