"""Packing by lexical retrieval: a sharded BM25 index supplies unused neighbours that fill each seed's window.

Shards are runs of lexically close documents: a document's keys are the least hashes of its words (min-hashes), so two
documents meet under a key with odds of their share of common words. Documents are dealt to partitions by ranges of the
first key, sorted by all keys, and a partition is cut into shards of ``SHARD_ROWS`` rows or ``SHARD_BYTES`` bytes as it is
read. The ranges come from the quantiles of all documents' keys; a key that fills several ranges (copies) is spread over
them by a hash of id and text. Only a seed's own shard is searched.

With ``ordered`` the rows' order is a training order that windows keep: partitions are runs of that order of about
``PART_BYTES`` (at least twelve runs), lexically sorted and searched inside only, and sequence_id rises from run to run. The
order is that of the files and of the rows in a file, as a sorted table is written.

A shard indexes all words of its documents. BM25 weighs words by the whole corpus' document counts and mean length; counts
are held by ``CELLS`` cells of word hashes, a table of fixed size that can overstate rare words' counts, never understate.
A partition's token stream grows greedily: a seed opens a window, its unused neighbours follow in score order, the one
that crosses the window's end is cut and seeds the next; without neighbours left the first unused document goes on. The
query of a seed is all its words; a row with the seed's id is no neighbour. The stream goes on from shard to shard, so
only a partition's last window is padded.

Defined results: a null or blank text is the end id alone; repeated rows are packed each; a null id stays null; texts of
any length are taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .codec import WordIds, split
from .rows import FILE, ROW, located
from .textnp import U, Words, give_back, mix, slices, words_of
from .workspace import stage

WINDOW, END_ID = 2048, 1
SHARD_ROWS, SHARD_BYTES = 1024, 16 << 20
#: Bytes of text that are turned into words, or words into ids, at a time.
SURVEY_BYTES = 4 << 20
CELL_BITS = 20
CELLS = 1 << CELL_BITS
CELL_RUN = 1 << 14
#: Bytes of text of a partition.
PART_BYTES = 32 << 20
#: Files whose places in the order are broadcast (about 50 MB); beyond, rows meet them in a shuffle.
MOST_FILES = 1 << 18
SALTS = (0x1234567, 0x89ABCDEF01)
K1, B = 1.2, 0.75
#: Words in more than one of ``COMMON`` documents of a shard are scored by matrix products, ``BLOCK`` words at a time, in
#: shards of ``DENSE_ROWS`` rows at most.
COMMON, BLOCK, DENSE_ROWS = 8, 512, 4096
#: Weights are multiples of this and more than 0, so sums of them are exact in any order and no shared word is lost.
GRAIN = 2.0**-32
_caches: dict[str, WordIds] = {}


class Index:
    """BM25 over the documents of a shard; words that only one of them has can't find another and are left out.

    ``corpus``: number of documents, mean words of one, and document counts by cell of a larger corpus; without it the
    shard is the corpus.
    """

    def __init__(self, parts: list[Words], k1: float = K1, b: float = B, corpus: tuple[int, float, np.ndarray] | None = None):
        self.n = sum(len(w.first) - 1 for w in parts)
        # One sort of (word, document): words keep the bits that the document's number leaves.
        bits = U(max(1, self.n.bit_length()))
        keys, sizes, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for w in parts:
            n = np.diff(w.first)
            sizes.append(n)
            keys.append((w.hashes >> bits << bits) | np.repeat(np.arange(at, at + len(n), dtype=np.uint64), n))
            at += len(n)
        size, key = np.concatenate(sizes), np.sort(np.concatenate(keys))
        at = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        tf = np.diff(np.append(at, len(key)))
        key = key[at]
        same = (key[1:] >> bits) == (key[:-1] >> bits)
        shared = np.zeros(len(key), bool)
        shared[1:] |= same
        shared[:-1] |= same
        key, tf = key[shared], tf[shared]
        term, owner = key >> bits, (key & ((U(1) << bits) - U(1))).astype(np.int64)
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(term)), bool), term[1:] != term[:-1])))
        df = np.diff(np.append(first, len(term)))
        n, mean, count = self.n, max(1.0, float(size.mean())) if len(size) else 1.0, df
        if corpus:
            n, mean, counts = corpus
            count = np.maximum(df, counts[((key[first] >> U(64 - CELL_BITS))).astype(np.int64)])
        self.idf = np.log(1 + (n - count + 0.5) / (count + 0.5))
        weights = np.repeat(self.idf, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[owner] / mean))
        weights = np.maximum(np.round(weights / GRAIN), 1) * GRAIN
        common = (df * COMMON > self.n) & (self.n <= DENSE_ROWS)
        self.by_common = self._products(owner, weights, first, df, np.flatnonzero(common))
        rare = np.repeat(~common, df)
        owner, df = owner[rare], df[~common]
        self.docs, self.weights = owner.astype(np.int32), weights[rare]
        self.begin = np.concatenate(([0], np.cumsum(df)))
        by_doc = np.argsort(owner, kind="stable")
        self.entry = np.repeat(np.arange(len(df)), df)[by_doc]
        self.doc_begin = np.searchsorted(owner[by_doc], np.arange(self.n + 1))

    def _products(self, owner: np.ndarray, weights: np.ndarray, first: np.ndarray, df: np.ndarray, common: np.ndarray) -> np.ndarray | None:
        """Scores of each document (column) for these words of each (row)."""
        if not len(common):
            return None
        out = np.zeros((self.n, self.n))
        for at in range(0, len(common), BLOCK):
            some = common[at : at + BLOCK]
            n = df[some]
            row = np.repeat(np.arange(len(some)), n)
            place = np.arange(len(row)) + np.repeat(first[some] - np.cumsum(n) + n, n)
            table = np.zeros((len(some), self.n))
            table[row, owner[place]] = weights[place]
            out += (table > 0).T.astype(np.float64) @ table
        return out

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of each document for the words of this one."""
        e = self.entry[self.doc_begin[doc] : self.doc_begin[doc + 1]]
        size = self.begin[e + 1] - self.begin[e]
        upto = np.cumsum(size)
        at = np.repeat(self.begin[e] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)
        rest = np.bincount(self.docs[at], self.weights[at], self.n)
        return rest if self.by_common is None else rest + self.by_common[doc]

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a word, best first."""
        score = self.scores(doc) * unused
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def words_in(texts: pa.Array) -> list[Words]:
    """Lower-case words of these texts, in parts of bounded size."""
    return list(words_by(texts, SHARD_BYTES))


def words_by(texts: pa.Array, size: int = SURVEY_BYTES) -> Iterator[Words]:
    """The same, a part at a time: whole texts of about ``size`` bytes."""
    for _, _, data, offsets in slices(texts, size):
        yield words_of(data, offsets, lower=True)


def documents_by_cell(w: Words) -> np.ndarray:
    """How many of these documents have a word of each cell."""
    key = ((w.hashes >> U(64 - CELL_BITS)) << U(40)) | np.repeat(np.arange(len(w.first) - 1, dtype=np.uint64), np.diff(w.first))
    key.sort()
    new = np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
    return np.bincount((key[new] >> U(40)).astype(np.int64), minlength=CELLS)


def ids_of(w: Words, raw: pa.Array, words: WordIds, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a part's texts end to end, each with the end id, and where each begins (one more).

    Each different word of the part is looked up once; equal 64-bit hashes are taken for equal words.
    """
    order = np.argsort(w.hashes)
    h = w.hashes[order]
    new = np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1]))
    word = np.empty(len(h), np.int64)
    word[order] = np.cumsum(new) - 1
    some = order[new]
    at, size = words.places(h[new], w.data, w.starts[some], w.ends[some])
    pool = words.flat()
    took = size[word]
    upto = np.concatenate(([0], np.cumsum(took)))
    ids = pool[np.repeat(at[word] - upto[:-1], took) + np.arange(upto[-1])]
    # The end id goes behind each text's last word.
    begins = upto[w.first]
    flat = np.insert(ids, begins[1:], np.uint32(end_id))
    offsets = begins + np.arange(len(begins))
    text = w.data.tobytes()
    if b"|>" in text:  # such texts keep their case, or they could turn into special strings
        rows = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        end = np.array([end_id], "<u4").tobytes()
        for i, t in enumerate(raw):
            if b"|>" in (t := t.as_buffer().to_pybytes()):
                rows[i] = np.frombuffer(b"".join(words.other.values([split(t)])[0]) + end, "<u4")
        flat, offsets = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    return flat, offsets


def order_of(index: Index, lengths: list[int], window: int, at: int = 0, names: np.ndarray | None = None) -> list[int]:
    """The order in which a shard's documents follow one another after ``at`` tokens; rows of one name aren't neighbours."""
    unused = np.ones(index.n, bool)
    order: list[int] = []
    lowest, queue = 0, iter(())
    for _ in range(index.n):
        pick = next((int(d) for d in queue if unused[d]), None)
        if pick is None:
            while not unused[lowest]:
                lowest += 1
            pick = lowest
            queue = None
        unused[pick] = False
        order.append(pick)
        before, at = at // window, at + lengths[pick]
        if queue is None or at // window != before:
            queue = iter(index.neighbours(pick, unused if names is None else unused & (names != names[pick])))
    return order


def keys_of(w: Words, salts: tuple[int, ...] = SALTS) -> list[np.ndarray]:
    """Min-hashes of each document's words, of 52 bits as quantiles are computed in doubles; the greatest number without words."""
    has = np.flatnonzero(np.diff(w.first))
    out = []
    for salt in salts:
        key = np.full(len(w.first) - 1, (1 << 52) - 1, np.uint64)
        if len(has):
            key[has] = np.minimum.reduceat(mix(w.hashes ^ U(salt)), w.first[:-1][has]) >> U(12)
        out.append(key.view(np.int64))
    return out


def surveyed(texts: DataFrame) -> DataFrame:
    """(part, counts, n, key) of all texts, staged: with part -1 each text's words and first key; else documents by cell of
    their words, one row for a task and ``CELL_RUN`` cells, as 32-bit numbers."""

    def survey(batches):
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for w in words_by(b.column(0)):
                total += documents_by_cell(w)
                sizes = np.diff(w.first)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), -1, np.int32)), pa.nulls(len(sizes), pa.binary()), pa.array(sizes), pa.array(keys_of(w, SALTS[:1])[0])], ["part", "counts", "n", "key"])
        runs = total.astype(np.uint32).reshape(-1, CELL_RUN)
        has = np.flatnonzero(runs.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array([runs[i].tobytes() for i in has], pa.binary()), pa.nulls(len(has), pa.int64()), pa.nulls(len(has), pa.int64())], ["part", "counts", "n", "key"])
        give_back()

    return stage(texts.mapInArrow(survey, "part int, counts binary, n bigint, key bigint"), "packing-survey")


def cell_counts(found: DataFrame) -> np.ndarray:
    """Documents by cell over all tasks."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CELL_RUN, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.uint32)
        return pa.table({"part": table.column("part").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((CELLS // CELL_RUN, CELL_RUN), np.int64)
    for r in found.where("part >= 0").groupBy("part").applyInArrow(add, "part int, total binary").collect():
        out[r.part] = np.frombuffer(r.total, np.int64)
    return out.ravel()


def runs_of(rows: DataFrame, parts: int) -> DataFrame:
    """Located rows with ``to``: which of ``parts`` equal runs of the order of files, then rows in a file, they are in.

    Files of a sorted table are numbered by partition; the number may outgrow its leading zeros.
    """
    number = F.regexp_extract("p_file", r"part-(\d+)", 1).try_cast("bigint")
    sizes = rows.groupBy(F.col(FILE).alias("p_file")).agg((F.max(ROW) + 1).alias("size"))
    upto = F.sum("size").over(Window.orderBy(number, "p_file"))
    files = stage(sizes.select("p_file", (upto - F.col("size")).alias("base"), F.sum("size").over(Window.partitionBy()).alias("all")), "packing-files")
    side = F.broadcast(files) if files.count() <= MOST_FILES else files
    return rows.join(side, F.col(FILE) == F.col("p_file")).withColumn("to", F.expr(f"(base + {ROW}) * {parts} div all"))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES, ordered: bool = False) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    spark = docs.sparkSession
    rows = (located(docs) if ordered else docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([FILE, ROW] if ordered else []))
    found = surveyed(rows.select("text"))
    own = found.where("part < 0")
    n, words = own.agg(F.count(F.lit(1)), F.sum("n")).first()
    # About seven bytes a word; the number of partitions needs no more.
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")), (words or 0) * 7 // PART_BYTES)
    shares = [i / parts for i in range(1, parts)]
    bounds = [] if ordered else own.agg(F.percentile_approx("key", shares, max(10_000, 20 * parts))).first()[0] or []
    counts = cell_counts(found)
    shared = spark.sparkContext.broadcast((np.array(bounds, np.int64), counts, n, max(1.0, (words or 0) / max(1, n))))

    def deal(batches):
        limits = shared.value[0]
        for b in batches:
            keys = [np.concatenate(k) for k in zip(*map(keys_of, words_by(b.column(1))))] if b.num_rows else [np.zeros(0, np.int64)] * len(SALTS)
            part = b.column(2).to_numpy()
            if not ordered:
                low, high = np.searchsorted(limits, keys[0]), np.searchsorted(limits, keys[0], "right")
                part = low + part % (high - low + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part.astype(np.int32)), *map(pa.array, keys)], ["id", "text", "part", "k1", "k2"])
        give_back()

    def shards(batches):
        """Runs of rows of a partition that make a shard."""
        held, size = [], 0
        for b in batches:
            at = 0
            ends = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False))
            while at < b.num_rows:
                rows = sum(h.num_rows for h in held)
                done = int(ends[at - 1]) if at else 0
                to = min(at + shard_rows - rows, max(at + (not held), int(np.searchsorted(ends, done + shard_bytes - size, "right"))), b.num_rows)
                if to > at:
                    held.append(b.slice(at, to - at))
                    size += int(ends[to - 1]) - done
                if to < b.num_rows or rows + to - at >= shard_rows:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                at = to
        if held:
            yield pa.Table.from_batches(held)

    def fill(batches):
        at, batch = 0, None
        for table in shards(batches):
            batch, at = filled(table, at)
            table = None
            yield batch
        batch = None
        give_back()

    def filled(table: pa.Table, at: int) -> tuple[pa.RecordBatch, int]:
        """Pieces of a shard whose stream begins after ``at`` tokens of its partition, and where it ends."""
        cache = _caches.setdefault(path, WordIds(path))
        corpus = (shared.value[2], shared.value[3], shared.value[1])
        first = TaskContext.get().partitionId() << 32
        texts = table.column("text").cast(pa.large_string()).combine_chunks()
        names = table.column("id").combine_chunks()
        parts, raw, ids = [], texts.cast(pa.large_binary()), []
        for w in words_by(texts):
            flat, begins = ids_of(w, raw[len(ids) : len(ids) + len(w.first) - 1], cache, end_id)
            ids += [flat[a:b] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]
            parts.append(replace(w, data=None, starts=None, ends=None))  # the index needs hashes only
        w = None
        lengths = [len(x) for x in ids]
        doc, start, length, crc, sequence, offset = [], [], [], [], [], []
        code = names.dictionary_encode()
        code = np.where(names.is_null().to_numpy(zero_copy_only=False), -1 - np.arange(len(names)), code.indices.fill_null(0).to_numpy(zero_copy_only=False))
        for d in order_of(Index(parts, corpus=corpus), lengths, window, at, code):
            done, own = 0, ids[d]
            while done < lengths[d]:
                take = min(window - at % window, lengths[d] - done)
                doc.append(d)
                start.append(done)
                length.append(take)
                crc.append(zlib.crc32(own[done : done + take]))
                sequence.append(first | (at // window))
                offset.append(at % window)
                done, at = done + take, at + take
        took = pa.array(doc, pa.int64())
        tokens = pa.array(np.array(lengths, np.int64)[np.array(doc, np.int64)], pa.int64())
        columns = [names.take(took), *(pa.array(x, pa.int64()) for x in (start, length, crc)), tokens, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]), at

    kind = docs.schema[id_col].dataType.simpleString()
    if ordered:
        rows = runs_of(rows, parts)
    else:
        rows = rows.withColumn("to", F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 31) - 1)))
    dealt = rows.select("id", "text", "to").mapInArrow(deal, f"id {kind}, text string, part int, k1 bigint, k2 bigint")
    close = dealt.repartitionById(parts, "part").sortWithinPartitions("k1", "k2", F.xxhash64("id", "text"), "id").select("id", "text")
    return close.mapInArrow(fill, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint").withColumnRenamed("id", id_col)
