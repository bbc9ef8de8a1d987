"""Rows of a table by place, so that verdicts on rows can be applied where the rows are, without moving them.

A row's place is its file and its number in that file. A set of places is held as one bitmap of 4 KB for each ``GROUP``
rows of a file that has any: one bit a row. Up to ``MAPS`` bitmaps (128 MB, a billion rows) are broadcast, a bound that
is checked on their staged table; beyond it, rows and bitmaps meet by (file, group), keys of at most ``GROUP`` rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import stage

FILE, ROW = "__sig_file", "__sig_row"
GROUP, MAPS = 32768, 1 << 15


def _from_files(docs: DataFrame) -> bool:
    """docs is a scan of files, filtered or projected at most, so that each row has a place of its own."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    names = node.metadataOutput()
    return node.nodeName() == "LogicalRelation" and any(names.apply(i).name() == "_metadata" for i in range(names.size())) and "_metadata" not in docs.columns


def located(docs: DataFrame) -> DataFrame:
    """docs with FILE and ROW. Rows that aren't a plain scan of Parquet files are written to the shared folder first."""
    if not _from_files(docs):
        docs = stage(docs, "rows")
    return docs.withColumns({FILE: F.col("_metadata.file_path"), ROW: F.col("_metadata.row_index")})


def bit(bitmap: Column, at: Column) -> Column:
    """Bit ``at`` of a bitmap as bitmap_construct_agg makes them; false without a bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte, F.lit(0)).bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0


def bitmaps(places: DataFrame) -> DataFrame:
    """The set of these (FILE, ROW)."""
    return stage(places.groupBy(F.col(FILE).alias("m_file"), F.expr(f"{ROW} div {GROUP}").alias("m_group")).agg(F.bitmap_construct_agg(F.col(ROW) % GROUP).alias("m_bits")), "rows-maps")


def marked(rows: DataFrame, maps: DataFrame, into: str, most: int = MAPS) -> DataFrame:
    """Located rows with a boolean: the row is in the set."""
    side = F.broadcast(maps) if maps.count() <= most else maps
    on = (F.col(FILE) == F.col("m_file")) & (F.expr(f"{ROW} div {GROUP}") == F.col("m_group"))
    return rows.join(side, on, "left").withColumn(into, bit(F.col("m_bits"), F.col(ROW) % GROUP)).drop("m_file", "m_group", "m_bits")


def without(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Located rows that aren't at one of these places, without FILE and ROW."""
    return marked(rows, bitmaps(places), "__sig_in").where("not __sig_in").drop("__sig_in", FILE, ROW)
