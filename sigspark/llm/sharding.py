"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

At each level a row draws -ln(u) / weight for every child, u from a hash of its key and the child's name, and descends
to the smallest draw. A changed weight changes only that child's draws, so rows move only into or out of subtrees
whose weight changes. ``grow`` adds a shard as a region of its own with weight 1: rows move only into the new shard.

Only a key, its size and a shard number are dealt; slots come from counts of (shard, hash block), so that no task
holds a whole shard. A row's place in a shard is by a hash of key and text, so that rows of one key lie in many blocks.
Defined results: a null key is a string of its own; a null text has no bytes; equal keys share a shard and take different
slots, in the same order in each run; texts of any length are taken whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Hash blocks of a shard, 4096 at most; a block's rows are numbered in one task, and shards times BLOCKS counts are broadcast.
BLOCKS = 1024


@dataclass(frozen=True)
class ShardTree:
    """regions: for each region its racks, for each rack the (shard number, weight) of its shards."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @classmethod
    def uniform(cls, regions: int = 2, racks: int = 3, shards: int = 4) -> ShardTree:
        n = iter(range(regions * racks * shards))
        return cls(tuple(tuple(tuple((next(n), 1.0) for _ in range(shards)) for _ in range(racks)) for _ in range(regions)))

    def count(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grow(self) -> ShardTree:
        return ShardTree((*self.regions, (((self.count(), 1.0),),)))

    def reweight(self, shard: int, weight: float) -> ShardTree:
        return ShardTree(tuple(tuple(tuple((s, weight if s == shard else w) for s, w in rack) for rack in region) for region in self.regions))

    def place(self, rows: DataFrame, key: str, into: str) -> DataFrame:
        """rows with the shard of the string column key."""
        weights = lambda level: F.array(*map(F.lit, level))
        sums = [[float(sum(w for _, w in rack)) for rack in region] for region in self.regions]
        tops = F.array(*(F.lit(sum(r)) for r in sums))
        racks = F.array(*map(weights, sums))
        shards = F.array(*(F.array(*(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(float(w)).alias("w")) for s, w in rack)) for rack in region)) for region in self.regions))
        r, k = f"__{into}_r", f"__{into}_k"
        least = lambda draws: F.array_min(draws)["i"]
        rows = rows.withColumn(r, least(F.transform(tops, lambda w, i: _draw(F.concat(F.col(key), F.lit("|r"), i), w, i))))
        rows = rows.withColumn(k, least(F.transform(F.get(racks, F.col(r)), lambda w, i: _draw(F.concat(F.col(key), F.lit("|k"), F.col(r), F.lit("."), i), w, i))))
        leaf = F.transform(F.get(F.get(shards, F.col(r)), F.col(k)), lambda x: _draw(F.concat(F.col(key), F.lit("|s"), x["s"]), x["w"], x["s"]))
        return rows.withColumn(into, least(leaf).cast("int")).drop(r, k)


def _draw(name: Column, weight: Column, child: Column) -> Column:
    """-ln(u) / weight, u from the first 52 bits of a hash of key and child."""
    u = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double")
    return F.struct((-F.log((u + 0.5) / F.lit(float(16**13))) / weight).alias("d"), child.alias("i"))


def key_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("\x00null"))


def shard_rows(docs: DataFrame, tree: ShardTree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard)."""
    key, text = key_of(F.col(id_col)), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), key.alias("key"))
    rows = rows.withColumn("h", F.md5(F.concat("key", F.lit("|"), "text_crc32")))
    rows = tree.grow().place(tree.place(rows, "key", "shard"), "key", "grown_shard")
    return with_slots(rows, "shard", BLOCKS).select(F.col("id").alias(id_col), "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def with_slots(rows: DataFrame, group: str, blocks: int) -> DataFrame:
    """slot: gapless numbers from 0 in each group. rows has h, a hex hash that orders a group's rows, and id, text_crc32 and size for ties."""
    blocked = rows.withColumn("block", F.floor(F.conv(F.substring("h", 1, 3), 16, 10).cast("int") * blocks / 4096).cast("int"))
    counts = blocked.groupBy(group, "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col(group).alias("__g"), F.col("block").alias("__b"), (F.sum("n").over(Window.partitionBy(group).orderBy("block")) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy(group, "block").orderBy("h", "id", "text_crc32", "size"))
    numbered = blocked.withColumn("rank", within)
    return numbered.join(F.broadcast(before), (F.col(group) == F.col("__g")) & (F.col("block") == F.col("__b"))).withColumn("slot", (F.col("base") + F.col("rank") - 1).cast("long"))
