"""Record sources: text, fixed-width binary, generated, key files, directories, iterables.

A source name is a file or a directory, all of whose files belong to the stream; a directory inside it is an error.
Each row gets ``_seq``, its arrival number: rows of a file in order, files by name.
"""

from __future__ import annotations

import struct as _struct
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEQ = "_seq"
_CODES = {"b": "tinyint", "B": "smallint", "h": "smallint", "H": "int", "i": "int", "I": "bigint", "l": "int", "L": "bigint", "q": "bigint", "Q": "decimal(20,0)", "f": "float", "d": "double", "?": "boolean"}
_ARROW = {"b": pa.int8(), "B": pa.int16(), "h": pa.int16(), "H": pa.int32(), "i": pa.int32(), "I": pa.int64(), "l": pa.int32(), "L": pa.int64(), "q": pa.int64(), "f": pa.float32(), "d": pa.float64(), "?": pa.bool_()}


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The files of a source, by name; markers such as _SUCCESS are none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(at).isDirectory():
        return [path]
    out = []
    for s in fs.listStatus(at):
        if s.getPath().getName().startswith(("_", ".")):
            continue
        if s.isDirectory():
            raise IsADirectoryError(s.getPath().toString())
        out.append(s.getPath().toString())
    return sorted(out)


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with _seq: counts of the pieces (file, block) before, and places inside, so that no task needs a whole file."""
    per = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("n"))
    base = per.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), (F.sum("n").over(Window.orderBy("_file", "_block")) - F.col("n")).alias("_base"))
    inner = F.row_number().over(Window.partitionBy("_file", "_block").orderBy(*order)) - 1
    numbered = rows.withColumn("_in", inner).join(base, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return numbered.withColumn(SEQ, (F.col("_base") + F.col("_in")).cast("long")).drop("_in", "_f", "_b", "_base", "_file", "_block")


def _lines(spark: SparkSession, files: list[str], line_sep: str | None = None) -> DataFrame:
    """(value, _file, _block, _id) of each line, without a final carriage return."""
    reader = spark.read.text(files, lineSep=line_sep) if line_sep else spark.read.text(files)
    lines = reader.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    return lines.withColumn("value", F.regexp_replace("value", "\r$", ""))


def text_source(spark: SparkSession, path: str, translate: Callable[..., dict[str, Column]], keep: Callable[..., Column] | None = None, params: tuple = (), line_sep: str | None = None) -> DataFrame:
    """Records translated from lines by column expressions. Lines with a null in any field not named in ``keep``'s verdict are dropped unless keep is given."""
    files = files_of(spark, path)
    if not files:
        lines = spark.createDataFrame([], "value string")
        return lines.select(*[c.alias(n) for n, c in translate(F.col("value"), *params).items()], F.lit(0).cast("long").alias(SEQ))
    lines = _numbered(_lines(spark, files, line_sep), "_id")
    fields = translate(F.col("value"), *params)
    rows = lines.select(SEQ, "value", *[c.alias(n) for n, c in fields.items()])
    rows = rows.where(keep(F.col("value"), *params)) if keep else rows.dropna(subset=list(fields))
    return rows.drop("value")


def _record_dtype(layout: str, names: list[str]) -> np.dtype:
    """The numpy type of a struct layout, its padding included."""
    codes = re_codes(layout)
    mark = layout[0] if layout[0] in "<>=!@" else "@"
    formats = [f"{'>' if mark in '>!' else '<' if mark == '<' else '='}{'?' if c == '?' else 'f' if c in 'fd' else 'i' if c.islower() else 'u'}{_struct.calcsize(mark + c)}".replace("?1", "?") for c in codes]
    ends, body = [], layout.lstrip("<>=!@")
    import re

    done = mark
    for n, c in re.findall(r"(\d*)([a-zA-Z?])", body):
        for _ in range(int(n or 1)):
            done += c
            if c != "x":
                ends.append(_struct.calcsize(done) - _struct.calcsize(mark + c))
    return np.dtype({"names": names, "formats": formats, "offsets": ends, "itemsize": _struct.calcsize(layout)})


def binary_source(spark: SparkSession, path: str, layout: str, names: list[str], keep: Callable[[DataFrame], Column] | None = None, chunk: int = 1 << 20) -> DataFrame:
    """Fixed-width records by a struct layout such as ``<iiq``; a file whose size is no multiple of the record is an error.

    A file is cut to ranges of ``chunk`` records. Tasks read their ranges on their own and take each as one array, so a file
    of any size is read by many tasks and never held whole.
    """
    width, codes = _struct.calcsize(layout), re_codes(layout)
    schema = ", ".join(f"{n} {_CODES[c]}" for n, c in zip(names, codes, strict=True))
    kind = _record_dtype(layout, names)
    ranges: list[tuple[str, int, int, int]] = []
    seq = 0
    for name in files_of(spark, path):
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
        if size % width:
            raise ValueError(f"{name}: {size} bytes are no multiple of {width}")
        for first in range(0, size, width * chunk):
            n = min(chunk, (size - first) // width)
            ranges.append((name, first, n, seq))
            seq += n
    if not ranges:
        return spark.createDataFrame([], f"{schema}, {SEQ} bigint")

    def read(batches):
        from urllib.parse import unquote

        from pyarrow.fs import FileSystem

        for b in batches:
            for name, first, n, seq in zip(*(c.to_pylist() for c in b.columns)):
                fs, at = FileSystem.from_uri(name if not name.startswith("file:/") or name.startswith("file://") else "file://" + name[5:])
                with fs.open_input_file(unquote(at)) as f:
                    rows = np.frombuffer(f.read_at(n * width, first), kind)
                for a in range(0, n, 1 << 16):
                    part = rows[a : a + (1 << 16)]
                    columns = []
                    for name_, c in zip(names, codes):
                        x = np.ascontiguousarray(part[name_])
                        x = pa.array(x.astype(x.dtype.newbyteorder("=")))
                        columns.append(x.cast(pa.decimal128(20, 0)) if c == "Q" else x.cast(_ARROW[c]))
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(seq + a, seq + a + len(part)))], [*names, SEQ])

    dealt = spark.createDataFrame(ranges, "path string, first bigint, n bigint, seq bigint").repartition(min(len(ranges), max(1, spark.sparkContext.defaultParallelism * 4)), "path", "first")
    rows = dealt.mapInArrow(read, f"{schema}, {SEQ} bigint")
    return rows.where(keep(rows)) if keep else rows


def re_codes(layout: str) -> list[str]:
    """Format codes of a layout, counts spelled out."""
    import re

    return [c for n, c in re.findall(r"(\d*)([a-zA-Z?])", layout) for _ in range(int(n or 1)) if c != "x"]


def generated(spark: SparkSession, count: int, make: Callable[[Column], dict[str, Column]], keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Records 0 .. count - 1 of a generator; keep drops some. A generator's stop is its count."""
    rows = spark.range(count).withColumnRenamed("id", SEQ)
    rows = rows.where(keep(F.col(SEQ))) if keep else rows
    return rows.select(SEQ, *[c.alias(n) for n, c in make(F.col(SEQ)).items()])


def key_source(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Integers of a text file, any number a line, inside [low, high]; other characters are skipped, as are numbers that 64 bits don't hold."""
    files = files_of(spark, path)
    lines = _lines(spark, files) if files else spark.createDataFrame([], "value string, _file string, _block bigint, _id bigint")
    found = lines.select("_file", "_block", "_id", F.posexplode(F.regexp_extract_all("value", F.lit(r"[-+]?[0-9]+"), F.lit(0))).alias("_place", "text"))
    rows = _numbered(found.select("_file", "_block", "_id", "_place", F.col("text").try_cast("bigint").alias("key")).where("key is not null"), "_id", "_place").select(SEQ, "key")
    if low is not None:
        rows = rows.where(F.col("key") >= low)
    return rows.where(F.col("key") <= high) if high is not None else rows


def from_iterable(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Records that the driver holds, such as lines of standard input."""
    kinds = f"{SEQ} bigint, {schema}"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], kinds)


def concatenated(*streams: DataFrame) -> DataFrame:
    """Streams one after the other: _seq of each goes on where the one before ends."""
    out = None
    for s in streams:
        if out is None:
            out = s
            continue
        end = out.agg((F.coalesce(F.max(SEQ), F.lit(-1)) + 1).alias("_end"))
        out = out.unionByName(s.join(F.broadcast(end)).withColumn(SEQ, F.col(SEQ) + F.col("_end")).drop("_end"))
    return out
