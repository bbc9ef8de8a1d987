"""Byte streams under a source: disciplines that change bytes on their way in, and byte codecs.

Disciplines are functions from bytes to bytes that stack in the order given; ``decoded`` applies them to whole files on the
executors and gives the decoded lines as text records. Codecs come as pairs of inverse functions, of bytes or (``coded``)
of a column of records.
"""

from __future__ import annotations

import subprocess
import zlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

Discipline = Callable[[bytes], bytes]
#: All bytes of some records, and where each begins, with the end; the same of what they become.
Records = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def dos(data: bytes) -> bytes:
    """Line ends of carriage return and line feed become line feeds; a final end-of-file mark goes."""
    return data.replace(b"\r\n", b"\n").removesuffix(b"\x1a")


def inflated(data: bytes) -> bytes:
    """Contents of a zlib or gzip stream."""
    return zlib.decompress(data, wbits=47)


def filtered(*command: str) -> Discipline:
    """What a program writes when the bytes are its input."""
    return lambda data: subprocess.run(command, input=data, stdout=subprocess.PIPE, check=True).stdout


def segment(start: int, size: int | None = None) -> Discipline:
    """The bytes from start on, ``size`` of them at most."""
    return lambda data: data[start : None if size is None else start + size]


def tee(sink: Callable[[bytes], None]) -> Discipline:
    """The bytes unchanged; sink sees them too, on the executor."""

    def copy(data: bytes) -> bytes:
        sink(data)
        return data

    return copy


def decoded(spark: SparkSession, files: list[str], *disciplines: Discipline, line_sep: bytes = b"\n") -> DataFrame:
    """(file, line, value): lines of the files after the disciplines. A file is a task's unit: what a discipline does to
    a byte may depend on all bytes before it, so such files can't be split; many files spread over many tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                data = content.as_buffer().to_pybytes()
                for d in disciplines:
                    data = d(data)
                lines = data.split(line_sep)
                if lines[-1] == b"":
                    lines.pop()
                for at in range(0, len(lines), 10_000):
                    part = [x.decode("utf-8", "replace") for x in lines[at : at + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.string())], ["file", "line", "value"])

    rows = spark.read.format("binaryFile").load(files).select("path", "content")
    return rows.repartition(max(1, len(files))).mapInArrow(read, "file string, line bigint, value string")


def codec(records: Records) -> Discipline:
    """A codec of the bytes of one record, from one that takes many at once; ``coded`` applies it to a column."""

    @wraps(records)
    def one(data: bytes) -> bytes:
        return records(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tobytes()

    one.records = records
    return one


def coded(codec: Discipline, rows: pa.Array) -> pa.Array:
    """Each value of a column of bytes through a codec, each on its own, without a step of Python for each; null stays null."""
    if not len(rows):
        return rows.cast(pa.large_binary())
    full = pc.fill_null(rows.cast(pa.large_binary()), b"")
    _, places, data = full.buffers()
    at = np.frombuffer(places, np.int64)[full.offset : full.offset + len(full) + 1]
    x, at = codec.records(np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0])
    out = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(x))])
    return pc.if_else(rows.is_valid(), out, None) if rows.null_count else out


def pieces(rows: pa.Array, size: int = 1 << 20) -> Iterator[pa.Array]:
    """A column in runs of ``size`` bytes at most, or of one value, as codecs need a multiple of its bytes."""
    ends, begin = np.cumsum(pc.fill_null(pc.binary_length(rows), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while begin < len(rows):
        end = max(begin + 1, int(np.searchsorted(ends, size + (ends[begin - 1] if begin else 0), "right")))
        yield rows[begin:end]
        begin = end


@codec
def run_length(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs as pairs of (length 1 to 255, byte)."""
    if not len(x):
        return x, at
    new = np.concatenate(([True], x[1:] != x[:-1]))
    new[at[at < len(x)]] = True
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(x)))
    parts = -(-size // 255)
    last = np.cumsum(parts)
    out = np.empty((int(last[-1]), 2), np.uint8)
    out[:, 0], out[:, 1] = 255, np.repeat(x[begin], parts)
    out[last - 1, 0] = size - 255 * (parts - 1)
    return out.ravel(), 2 * np.append(0, last)[np.searchsorted(begin, at)]


@codec
def from_run_length(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if (at % 2).any():
        raise ValueError("run lengths come in pairs of bytes")
    size = x[::2]
    return np.repeat(x[1::2], size), np.append(0, np.cumsum(size, dtype=np.int64))[at // 2]


def mapped(table: bytes) -> tuple[Discipline, Discipline]:
    """Each byte replaced by its entry of a table of 256 different bytes; and the way back."""
    if sorted(table) != list(range(256)):
        raise ValueError("a byte map needs each byte once")
    there = np.frombuffer(table, np.uint8)
    back = np.argsort(there).astype(np.uint8)
    return codec(lambda x, at: (there[x], at)), codec(lambda x, at: (back[x], at))


@codec
def delta(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences of neighbouring bytes, modulo 256."""
    out = np.diff(x, prepend=np.uint8(0))
    first = at[at < len(x)]
    out[first] = x[first]
    return out, at


@codec
def from_delta(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.cumsum(x, dtype=np.uint8)
    return total - np.repeat(np.append(np.uint8(0), total)[at[:-1]], np.diff(at)), at
