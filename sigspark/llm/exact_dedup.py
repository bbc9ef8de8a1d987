"""Exact dedup by two Bloom passes (native DataFrame functions only).

Hashes are cut into ranges, as many as keep a range's Bloom array within ``max_bits``: 8 cells a row, two of them set by
each. Pass 1 counts how many rows set a cell and keeps the cells set twice or more as bitmaps of 4 KB; only cell numbers
are shuffled. Pass 2 probes a range's bitmaps, broadcast (``MAX_BITS`` / 8 bytes = 64 MB at most): a row with a cell that
no other row set is unique and passes straight through; only the rest (copies and about one unique row in twenty, at any
table size) meet in a shuffle on their digest. Ranges are probed one after another; digests lie sorted in the staged
table, so a range reads its own rows only.

``drop_copies`` finds the rows that go and leaves the texts of all rows where they are.

Defined results: a null text is empty; empty texts equal each other; of equal texts the one with most code points,
then the smallest doc_id (null last), then one arbitrary row stays; rows repeated in all columns count as copies; texts
of any length are taken whole; an empty table gives an empty result; columns beyond id and text are ignored by
``decisions`` and kept by ``drop_copies``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import FILE, ROW, bit, located, without
from .workspace import stage

BLANK = r"[\x20\x09-\x0D]+"
MAX_BITS = 1 << 29
BUCKET = 32768


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def thin(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha, n_points, uid, h) of each row, and its place if docs has it, staged in order of h: the one scan of the texts."""
    text = F.col(text_col)
    place = [c for c in (FILE, ROW) if c in docs.columns]
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("sha"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_points"),
        *place,
    )
    return stage(rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("sha")).sortWithinPartitions("h"), "exact-thin")


def ranges(n: int, max_bits: int) -> tuple[int, int]:
    """(ranges of hashes, cells of each) for n rows."""
    count = max(1, -(-8 * n // max_bits))
    return count, min(max_bits, 1 << max(15, math.ceil(math.log2(max(1, 8 * n / count)))))


def possibly_repeated(rows: DataFrame, cells: int) -> DataFrame:
    """rows with ``again``: false only for rows whose digest no other row has."""
    low = F.lit(cells - 1)
    first, second = F.col("h").bitwiseAND(low), F.xxhash64("sha", F.lit(1)).bitwiseAND(low)
    twice = (
        rows.select(F.explode(F.array_distinct(F.array(first, second))).alias("cell"))
        .groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .groupBy(F.expr(f"cell div {BUCKET}").alias("bucket"))
        .agg(F.bitmap_construct_agg((F.col("cell") % BUCKET)).alias("bits"))
    )
    probe = rows.withColumns({"c1": first, "c2": second})
    for c in ("1", "2"):
        side = F.broadcast(twice.select(F.col("bucket").alias(f"b{c}"), F.col("bits").alias(f"bits{c}")))
        probe = probe.join(side, F.expr(f"c{c} div {BUCKET}") == F.col(f"b{c}"), "left").withColumn(f"hit{c}", bit(F.col(f"bits{c}"), F.col(f"c{c}") % BUCKET)).drop(f"b{c}", f"bits{c}", f"c{c}")
    return probe.withColumn("again", F.col("hit1") & F.col("hit2")).drop("hit1", "hit2")


def _decided(rows: DataFrame, cells: int, large: int) -> DataFrame:
    place = [c for c in (FILE, ROW) if c in rows.columns]
    probe = possibly_repeated(rows, cells)
    alone = probe.where("not again").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "uid", "n_points", *place)
    met = probe.where("again").drop("again")
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("id").isNull().alias("no_id"), "id", "uid"))
    groups = met.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    # A group of over a thousandth of all rows is spread by salt; there are a thousand of those at most, so they are broadcast.
    salts = F.when(F.col("group_size") > large, F.ceil(F.col("group_size") / large)).otherwise(F.lit(1)).cast("int")
    hot = groups.where(F.col("group_size") > large).select(F.col("sha").alias("hot_sha"), salts.alias("salts"))
    met = met.join(F.broadcast(hot), F.col("sha") == F.col("hot_sha"), "left").withColumn("salt", F.coalesce(F.pmod(F.col("uid"), F.col("salts")), F.lit(0)).cast("int")).drop("hot_sha", "salts")
    sides = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumnRenamed("sha", "g_sha").withColumnRenamed("salt", "g_salt")
    paired = met.join(sides, (F.col("sha") == F.col("g_sha")) & (F.col("salt") == F.col("g_salt"))).select(
        "id", F.col("best.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "sha", "uid", "n_points", *place
    )
    return alone.unionByName(paired).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, uid, n_points), one row per input row."""
    rows = thin(docs, id_col, text_col)
    n = rows.count()
    count, cells = ranges(n, max_bits)
    large = max(64, n // 1000)
    if count == 1:
        return _decided(rows, cells, large)
    edges = [-(1 << 63) + (i << 64) // count for i in range(count)] + [(1 << 63) - 1]
    within = lambda i: (F.col("h") >= edges[i]) & ((F.col("h") < edges[i + 1]) if i + 1 < count else F.lit(True))
    # One job a range, so that an executor never holds the bitmaps of two ranges.
    return reduce(DataFrame.unionByName, [stage(_decided(rows.where(within(i)), cells, large), "exact-range") for i in range(count)])


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """docs without the copies: all columns, one row of each group of equal texts."""
    rows = located(docs)
    return without(rows, decisions(rows, id_col, text_col, max_bits).where("not kept").select(FILE, ROW))
