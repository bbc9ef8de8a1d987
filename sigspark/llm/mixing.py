"""Mixing sources to target weights by a time-varying curriculum (native DataFrame functions only).

Sizes are words. Targets share ``share`` times all words by source weight, held at ``most`` times a source's size;
the excess goes to the others by weight (water-filling). A source's rows follow one another in hash order, the order
repeating for a second epoch; its first ``target`` words are taken. Over training time t in [0, 1] a source's weight
runs linearly from 1 - a to 1 + a (a from the source's rank), so its demand up to t is target * ((1 - a) t + a t^2); a
row's position is the t at which demand reaches the middle of its words.

Prefix sums run over (source, hash block) totals and then inside a block, so one source may hold most rows; there are as
many blocks as keep a block at about ``BLOCK_ROWS`` rows. ``sequence`` knows from the totals where a block begins, so it
sends each text straight to the range of positions it belongs to: texts move once. Inside a range rows are sorted by
position; a block that lies across the border of two ranges stays whole in the first.

Defined results: null source is a source of its own, last; null text has size 0 and is never taken; sizes of 0 give
targets of 0; a null id is ordered by its text; rows that repeat an id are taken each by its own size, in order of size
and text; texts of any length are taken whole; empty tables give empty results; other columns stay. Sources, not rows,
meet in one task where targets are shared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import stage

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_ROWS = 1 << 18
#: Blocks of all sources whose totals are broadcast (about 100 MB); beyond, texts meet them in a shuffle of their own.
MOST_BLOCKS = 1 << 20
#: Words of a range of positions, about 100 MB of text.
PART_WORDS = 1 << 24


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, weight, rank, target) from (source, size)."""
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    # Water level: in order of cap / weight, sources are at their cap until the level that shares what is left by weight is below it.
    cap, weight = F.col("source_size") * F.lit(float(most)), F.col("weight")
    order = Window.partitionBy().orderBy(F.col("cap") / weight, "rank")
    above, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(above), F.lit(0.0))
    sharing = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(above), F.lit(0.0))
    leveled = ranked.withColumn("cap", cap).withColumn("level", left / sharing).withColumn("free", F.col("cap") / weight > F.col("level"))
    leveled = leveled.withColumn("water", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(whole))
    return leveled.select("source", "source_size", "weight", "rank", F.least("cap", F.coalesce(weight * F.col("water"), F.col("cap"))).alias("target"))


def ordering(key: Column, text: Column) -> Column:
    return F.md5(F.coalesce(key.cast("string"), F.concat(F.lit("null "), F.coalesce(text, F.lit("")))))


def position(offset: Column, target: Column, slope: Column) -> Column:
    """The t in [0, 1] at which (1 - a) t + a t^2 reaches offset / target."""
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), offset / target))
    b = F.lit(1.0) - slope
    return F.when(target <= 0, F.lit(None).cast("double")).when(F.abs(slope) < 1e-9, u).otherwise((F.sqrt(F.greatest(F.lit(0.0), b * b + 4 * slope * u)) - b) / (2 * slope))


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """What the order and the sums need of a row: size, source, hash that orders it, hash that settles ties."""
    text = F.col(text_col)
    return {"size": words(text), "source": F.col(source_col), "h": ordering(F.col(id_col), text), "tie": F.xxhash64(text)}


def block_of(h: Column, digits: int) -> Column:
    return F.substring(h, 1, digits)


def blocks(rows: DataFrame, **kw) -> tuple[DataFrame, int]:
    """(source, block, base, source_size, target, slope) for each hash block of each source, staged; digits of a block's hash."""
    digits = max(2, math.ceil(math.log(max(1, rows.count()) / BLOCK_ROWS, 16)))
    totals = stage(rows.groupBy("source", block_of(F.col("h"), digits).alias("block")).agg(F.sum("size").alias("size")), "mix-totals")
    goal = targets(totals.select("source", "size"), **kw)
    slope = F.when(F.col("top") > 0, F.col("rank") / F.col("top") - 0.5).otherwise(F.lit(0.0))
    goal = goal.withColumn("top", F.max("rank").over(Window.partitionBy())).withColumn("slope", slope)
    goal = stage(goal.select(F.col("source").alias("g_source"), "source_size", "target", "slope"), "mix-goal")
    begun = totals.withColumn("base", F.sum("size").over(Window.partitionBy("source").orderBy("block")) - F.col("size"))
    out = begun.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "base", "source_size", "target", "slope")
    return stage(out, "mix-blocks"), digits


def _taken(begin: Column, size: Column, epoch: int | Column) -> Column:
    """Words taken of a row that begins after ``begin`` words of its source, in this epoch."""
    return F.greatest(F.lit(0), F.least(size, F.round(F.col("target")).cast("long") - begin - epoch * F.col("source_size")))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """(id, size, source, source_size, target, taken, first_position, second_position), one row per input row."""
    columns = measured(docs, id_col, text_col, source_col)
    rows = stage(docs.select(F.col(id_col).alias("id"), *(v.alias(k) for k, v in columns.items())), "mix-rows")
    base, digits = blocks(rows, **kw)
    inner = Window.partitionBy("source", "block").orderBy("h", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("block", block_of(F.col("h"), digits)).withColumn("upto", F.sum("size").over(inner))
    # base is staged, so Spark knows its size and broadcasts it only if it is small.
    joined = placed.join(base, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block"))).withColumn("begin", F.col("base") + F.col("upto") - F.col("size"))
    epoch = lambda k: _taken(F.col("begin"), F.col("size"), k)
    where = lambda k: F.when(epoch(k) > 0, position(F.col("begin") + k * F.col("source_size") + epoch(k) / 2, F.col("target"), F.col("slope")))
    return joined.select("id", "size", "source", "source_size", "target", (epoch(0) + epoch(1)).cast("long").alias("taken"), where(0).alias("first_position"), where(1).alias("second_position"))


def sequence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", part_words: int = PART_WORDS, **kw) -> DataFrame:
    """The training sequence: docs' columns, a row for each time a document is taken, cut to the words taken, by position."""
    spark = docs.sparkSession
    columns = measured(docs, id_col, text_col, source_col)
    base, digits = blocks(stage(docs.select(*(columns[k].alias(k) for k in ("size", "source", "h"))), "mix-rows"), **kw)
    # Demand of all sources up to t is linear * t + square * t^2: ranges of equal demand are ranges of equal words.
    sums = base.select("b_source", "target", "slope").distinct().agg(F.sum(F.col("target") * (1 - F.col("slope"))), F.sum(F.col("target") * F.col("slope"))).first()
    linear, square = float(sums[0] or 0), float(sums[1] or 0)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((linear + square) / part_words))
    own = {f"__{k}": v for k, v in columns.items()}
    rows = docs.withColumns(own).withColumn("__block", block_of(F.col("__h"), digits))
    b = base.select(*(F.col(c).alias(f"__{c}") for c in base.columns))
    b = F.broadcast(b) if base.count() <= MOST_BLOCKS else b
    rows = rows.join(b, F.col("__source").eqNullSafe(F.col("__b_source")) & (F.col("__block") == F.col("__b_block")))
    rows = rows.withColumn("__epoch", F.explode(F.expr("filter(array(0, 1), k -> __base + k * __source_size < __target)")))
    offset = F.col("__base") + F.col("__epoch") * F.col("__source_size")
    t = position(offset, F.col("__target"), F.col("__slope"))
    demand = (t * linear + t * t * square) / max(1e-9, linear + square)
    rows = rows.withColumn("__part", F.least(F.lit(parts - 1), F.floor(F.coalesce(demand, F.lit(0.0)) * parts)).cast("int")).repartitionById(parts, "__part")
    inner = Window.partitionBy("__part", "__source", "__block", "__epoch").orderBy("__h", F.col(id_col), "__size", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__begin", F.sum("__size").over(inner) - F.col("__size") + F.col("__base"))
    left = F.round(F.col("__target")).cast("long") - F.col("__begin") - F.col("__epoch") * F.col("__source_size")
    rows = rows.withColumn("__n", F.least("__size", left)).where("__n > 0")
    rows = rows.withColumn("__position", position(F.col("__begin") + F.col("__epoch") * F.col("__source_size") + F.col("__n") / 2, F.col("__target"), F.col("__slope")))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.col("__n").cast("int")), " ")
    cut = F.when(F.col("__n") >= F.col("__size"), F.col(text_col)).otherwise(head)
    return rows.sortWithinPartitions("__position", id_col, "__epoch").select(*[cut.alias(c) if c == text_col else F.col(c) for c in docs.columns])
