"""Token counts by a map-side two-tier lookup.

The first tier is a compact hash table, broadcast: sorted 64-bit hashes and token counts of frequent chunks. Which chunks
are in it changes the speed and never a result, so it is fitted on a sample: the first ``SAMPLE_ROWS`` rows of at most
``SAMPLE_BYTES`` bytes (16 MB in all, the bound of what reaches the driver) give up to ``TIER_ONE`` chunks. Every text is
then scanned once: frequent chunks are looked up in the table, others in a bounded cache in each Python worker that the
tokenizer fills. No chunk is shuffled. Equal hashes are taken for equal chunks.

Defined results: a null or blank text has 0 tokens; a null text 0 bytes; texts of any length are taken whole; rows repeat
as given; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import WordIds, encode_chunks, split
from .textnp import slices, words_of

TIER_ONE = 20_000
SAMPLE_ROWS, SAMPLE_BYTES = 1_000, 16 << 10
_tiers: dict = {}


def frequent(docs: DataFrame, text_col: str = "text", most: int = TIER_ONE, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> list[bytes]:
    """The most frequent chunks of the sample."""
    text = F.col(text_col)
    seen: Counter = Counter()
    for r in docs.where(F.octet_length(text) <= size).select(text).take(rows):
        seen.update(split(r[0].encode()))
    return [k for k, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if len(k) < 200][:most]


class Tiers:
    """Token counts of chunks by hash: the first tier's table, then a worker's cache."""

    def __init__(self, path: str, chunks: list[bytes], counts: np.ndarray):
        w = words_of(np.frombuffer(b" ".join(chunks), np.uint8), np.array([0, sum(map(len, chunks)) + max(0, len(chunks) - 1)]))
        order = np.argsort(w.hashes)
        self.hashes, self.counts, self.rest = w.hashes[order], counts[order].astype(np.int64), WordIds(path)

    def counted(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        out = [np.zeros(0, np.int64)]
        for at, to, data, offsets in slices(column, 4 << 20):
            w = words_of(data, offsets, lower=True)
            order = np.argsort(w.hashes)
            h = w.hashes[order]
            new = np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1]))
            word = np.empty(len(h), np.int64)
            word[order] = np.cumsum(new) - 1
            h, some = h[new], order[new]
            size = np.zeros(len(h), np.int64)
            where = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
            known = self.hashes[where] == h if len(self.hashes) else np.zeros(len(h), bool)
            size[known] = self.counts[where[known]]
            miss = np.flatnonzero(~known)
            if len(miss):
                size[miss] = self.rest.places(h[miss], w.data, w.starts[some[miss]], w.ends[some[miss]])[1]
            upto = np.concatenate(([0], np.cumsum(size[word])))
            n = np.diff(upto[w.first])
            text = data.tobytes()
            if b"|>" in text:  # such texts keep their case, or they could turn into special strings
                for i in range(to - at):
                    if b"|>" in (t := text[offsets[i] : offsets[i + 1]]):
                        n[i] = sum(map(len, self.rest.other.values([split(t)])[0])) // 4
            out.append(n)
        return np.concatenate(out)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row."""
    top = frequent(docs, text_col)
    counts = np.array([len(x) // 4 for x in encode_chunks(path, top)], np.uint16)
    table = docs.sparkSession.sparkContext.broadcast((top, counts))

    def count(batches):
        key = (path, hash(tuple(table.value[0])))
        if key not in _tiers:
            _tiers.clear()
            _tiers[key] = Tiers(path, *table.value)
        for b in batches:
            n = _tiers[key].counted(b.column(1))
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
