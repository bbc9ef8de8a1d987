"""Substring dedup by prefix-partitioned suffix trees over words.

Every word position starts a suffix. Suffixes are dealt to memory-sized groups by a prefix of 1, 2, 4, 8 or all
``window`` words: the shortest whose count, over all documents, fits a group. Counts come from a sketch of fixed size
(levels x ``CELLS``, so what reaches the driver and the workers never grows) that can only overstate, which
lengthens a prefix and changes no result. A group's subtree is cut at depth ``window``: it is the sorted array of its
suffixes' window hashes, its internal nodes at that depth are the runs of equal hashes, and runs of deep nodes at
consecutive positions are the maximal repeats. Suffixes travel in bulk: one row for a group and about ``FLUSH`` bytes
of text, which holds the suffixes' 64-bit window hashes and word positions. Two windows are taken for equal if their
hashes and their groups agree; the group comes from a hash of the prefix, or of the whole window's words hashed anew, so
a false match within a group of a million suffixes has odds of about 1e12 / 2^65, and their number grows with that of the groups.

A window that would overfill a group alone is a heavy leaf. The counting pass finds those: every batch of text reports
the windows it holds ``REPORT`` times or more, so a window's sum is short by less than that for each batch. Heavy are
sums of ``group`` / 16 and of 1 / 2^``SHARE`` of all windows or more; there are 2^``SHARE`` of those at most, so their
hashes and least documents (2 MB) reach the driver and the workers. Of a heavy window a batch sends one suffix, that of
its least document; the other suffixes never travel and are found again where the words are removed.

Defined results: null text has no words; a null id ranks after all ids; rows that share an id never count as earlier
than one another; texts of any length are taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnp import U, mix, slices, window_hashes, window_starts, words_of
from .workspace import stage

WINDOW = 13
LEVELS = (1, 2, 4, 8)
CELLS = 1 << 14
GROUP = 1 << 20
FLUSH = 16 << 20
REPORT, SHARE = 8, 17
LAST = np.int64(2**63 - 1)


def whole_keys(hashes: np.ndarray, window: int) -> np.ndarray:
    """A second hash of each window, whose collisions aren't those of ``window_hashes``: words are hashed anew first."""
    return window_hashes(mix(hashes ^ U(0xA5A5A5A5A5A5A5A5)), window)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of the same rank together: small numbers then compress well."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() if len(x) else b""


def _from_planes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).reshape(-1) if b else np.zeros(0, kind)


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x[:1] * 0)


def levels_of(window: int) -> tuple[int, ...]:
    """Prefix lengths shorter than the window; the window itself if there are none."""
    return tuple(p for p in LEVELS if p < window) or (window,)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(LAST)).to_numpy(zero_copy_only=False)


def _among(h: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Mask of h: is in the sorted array some."""
    return some[np.minimum(np.searchsorted(some, h), len(some) - 1)] == h if len(some) else np.zeros(len(h), bool)


def prefix_counts(docs: DataFrame, text_col: str, window: int, group: int, report: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketch of prefix counts over all windows of all documents, number of levels x CELLS; sorted hashes of heavy windows."""
    levels = levels_of(window)

    def count(batches):
        def often(held):
            h = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            n = np.diff(np.append(first, len(h)))
            h, n = h[first][n >= report], n[n >= report]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), -1, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], ["cell", "h", "n"])

        total, held, size = np.zeros((len(levels), CELLS), np.int64), [], 0
        for b in batches:
            for _, _, data, offsets in slices(b.column(0)):
                w = words_of(data, offsets)
                at = np.flatnonzero(window_starts(w.first, window))
                if len(at):
                    for k, p in enumerate(levels):
                        total[k] += np.bincount((window_hashes(w.hashes, p)[at] >> U(50)).astype(np.int64), minlength=CELLS)
                    held.append(window_hashes(w.hashes, window)[at])
                    size += len(data)
                if size > FLUSH:
                    yield often(held)
                    held, size = [], 0
        if held:
            yield often(held)
        flat = total.ravel()
        cells = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(np.zeros(len(cells), np.int64)), pa.array(flat[cells])], ["cell", "h", "n"])

    out = np.zeros(len(levels) * CELLS, np.int64)
    rows = stage(docs.select(text_col).mapInArrow(count, "cell int, h bigint, n bigint").groupBy("cell", "h").agg(F.sum("n").alias("n")).where((F.col("cell") >= 0) | (F.col("n") >= group // 16)), "substring-counts")
    for r in rows.where("cell >= 0").collect():
        out[r.cell] = r.n
    sketch = out.reshape(len(levels), CELLS)
    heavy = rows.where((F.col("cell") < 0) & (F.col("n") >= int(sketch[0].sum()) >> SHARE)).select("h").collect()
    return sketch, np.sort(np.array([r.h for r in heavy], np.int64).view(np.uint64))


def earlier_windows(docs: DataFrame, window: int = WINDOW, group: int = GROUP, parts: int | None = None, report: int = REPORT) -> tuple[DataFrame, int, tuple[np.ndarray, np.ndarray]]:
    """(part, ids, at): the windows of (id, uid, text) that also start in a document with a smaller id, in bulk by part = uid mod parts.

    Of heavy windows some at least are among these; all of them follow from the hashes and least ids that are returned last.
    """
    spark, levels = docs.sparkSession, levels_of(window)
    sketch, heavy = prefix_counts(docs, "text", window, group, report)
    n = int(sketch[0].sum())
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-n // group), min(-(-n // (group // 16)), 2 * shuffles))
    parts = parts or max(1, groups)
    own_uid = "uid" in docs.columns
    fits, rare = spark.sparkContext.broadcast(sketch <= max(1, group // 2)), spark.sparkContext.broadcast(heavy)

    def deal(batches):
        def flush(held):
            if not held:
                return None
            h, at, key, first, ids, uids = (np.concatenate(x) for x in zip(*held))
            bucket = (key % U(groups)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            rows: list[list] = [[], [], [], [], [], []]
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)]):
                sel = order[a:b]
                w = at[sel]
                doc = np.searchsorted(first, w, "right") - 1
                has = np.unique(doc)
                for r, v in zip(rows, (int(bucket[a]), h[sel].tobytes(), _planes(_deltas(w).astype(np.uint32)), _planes(_deltas(ids[has])), _planes(_deltas(first[has]).astype(np.uint32)), _planes(_deltas(uids[has])) if own_uid else b"")):
                    r.append(v)
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], ["bucket", "h", "at", "ids", "first", "uids"])

        held, size, words = [], 0, 0
        for b in batches:
            ids = _ids(b.column(0))
            uids = b.column(2).to_numpy(zero_copy_only=False) if own_uid else ids
            for a, z, data, offsets in slices(b.column(1)):
                w = words_of(data, offsets)
                at = np.flatnonzero(window_starts(w.first, window))
                if len(at):
                    h = window_hashes(w.hashes, window)[at]
                    if (often := _among(h, rare.value)).any():
                        which = np.flatnonzero(often)
                        which = which[np.lexsort((ids[a:z][np.searchsorted(w.first, at[which], "right") - 1], h[which]))]
                        stay = ~often
                        stay[which[np.concatenate(([True], h[which[1:]] != h[which[:-1]]))]] = True
                        at, h = at[stay], h[stay]
                    whole = whole_keys(w.hashes, window)[at]
                    key = whole
                    for k in range(len(levels) - 1, -1, -1):
                        p = window_hashes(w.hashes, levels[k])[at]
                        ok = fits.value[k][(p >> U(50)).astype(np.int64)]
                        key = np.where(ok, mix(p + U(levels[k])) if levels[k] < window else whole, key)
                    has = np.flatnonzero(np.diff(w.first) >= window)
                    held.append((h, at + words, key, w.first[has] + words, ids[a:z][has], uids[a:z][has]))
                    words += int(w.first[-1])
                    size += len(data)
                if size > FLUSH:
                    yield flush(held)
                    held, size, words = [], 0, 0
        if held:
            yield flush(held)

    def match(table: pa.Table) -> pa.Table:
        hs, ds, us, ps = [], [], [], []
        for h, at, ids, first, uids in zip(*(table.column(c) for c in ("h", "at", "ids", "first", "uids"))):
            w = np.cumsum(_from_planes(at.as_py(), np.uint32).astype(np.int64))
            f = np.cumsum(_from_planes(first.as_py(), np.uint32).astype(np.int64))
            d = np.cumsum(_from_planes(ids.as_py(), np.int64))
            doc = np.searchsorted(f, w, "right") - 1
            hs.append(np.frombuffer(h.as_py(), np.uint64))
            ds.append(d[doc])
            us.append(np.cumsum(_from_planes(uids.as_py(), np.int64))[doc] if own_uid else ds[-1])
            ps.append((w - f[doc]).astype(np.uint32))
        h, d, u, p = (np.concatenate(x) for x in (hs, ds, us, ps))
        order = np.argsort(h, kind="stable")
        h = h[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        begin = np.flatnonzero(new)
        d = d[order]
        least = np.minimum.reduceat(d, begin)[np.cumsum(new) - 1]
        often = np.flatnonzero(_among(h[begin], rare.value))
        late = order[d > least]
        known = (_planes(h[begin][often]), _planes(least[begin][often]))
        u, p = u[late], p[late]
        part = np.mod(u, parts)
        by = np.lexsort((p, u, part))
        u, p, part = u[by], p[by], part[by]
        cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(part)), bool), part[1:] != part[:-1])))
        ends = [*cut[1:].tolist(), len(part)]
        rows = [(int(part[a]), _planes(_deltas(u[a:b])), _planes(p[a:b])) for a, b in zip(cut.tolist(), ends)] + [(-1, *known)] * bool(len(often))
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "uids", "at"])

    columns = ["id", "text", "uid"] if own_uid else ["id", "text"]
    dealt = docs.select(*columns).mapInArrow(deal, "bucket int, h binary, at binary, ids binary, first binary, uids binary")
    found = dealt.groupBy("bucket").applyInArrow(match, "part bigint, uids binary, at binary")
    out = stage(found, "substring-windows")
    told = out.where("part < 0").select("uids", "at").collect() if len(heavy) else []
    h = np.concatenate([np.zeros(0, np.uint64), *(_from_planes(bytes(r.uids), np.uint64) for r in told)])
    least = np.concatenate([np.zeros(0, np.int64), *(_from_planes(bytes(r.at), np.int64) for r in told)])
    order = np.argsort(h)
    return out.where("part >= 0"), parts, (h[order], least[order])


def spans_of(at: np.ndarray, window: int) -> np.ndarray:
    """Maximal repeats: (first word, word after the last) of the runs that these windows cover; at is sorted."""
    if not len(at):
        return np.zeros((0, 2), np.int64)
    at = np.unique(at).astype(np.int64)
    new = np.concatenate(([True], at[1:] > at[:-1] + window))
    begin = np.flatnonzero(new)
    end = np.concatenate((begin[1:] - 1, [len(at) - 1]))
    return np.stack([at[begin], at[end] + window], 1)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group: int = GROUP, with_text: bool = False, report: int = REPORT) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, n_repeats), and with ``with_text`` kept_text and spans (word ranges removed)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = stage(rows.withColumn("uid", F.monotonically_increasing_id()), "substring-rows")
    found, parts, heavy = earlier_windows(rows, window, group, report=report)
    heavy = docs.sparkSession.sparkContext.broadcast(heavy)
    uid = F.col("uid") if "uid" in rows.columns else F.coalesce(F.col("id"), F.lit(int(LAST)))
    sides = rows.select(F.pmod(uid, F.lit(parts)).alias("part"), "id", uid.alias("uid"), "text")
    extra = ", kept_text string, spans array<array<bigint>>" if with_text else ""

    def heavy_windows(table: pa.Table):
        """(uids, first words) of heavy windows of these texts that start in an earlier document too."""
        h, least = heavy.value
        ids, uids = _ids(table.column("id").combine_chunks()), table.column("uid").to_numpy()
        for a, z, data, offsets in slices(table.column("text")) if len(h) else ():
            w = words_of(data, offsets)
            at = np.flatnonzero(window_starts(w.first, window))
            if len(at):
                own = window_hashes(w.hashes, window)[at]
                which = np.flatnonzero(_among(own, h))
                doc = np.searchsorted(w.first, at[which], "right") - 1
                late = least[np.searchsorted(h, own[which])] < ids[a:z][doc]
                yield uids[a:z][doc[late]], (at[which] - w.first[doc])[late].astype(np.uint32)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        u = np.concatenate([np.cumsum(_from_planes(x.as_py(), np.int64)) for x in right.column("uids")] or [np.zeros(0, np.int64)])
        p = np.concatenate([_from_planes(x.as_py(), np.uint32) for x in right.column("at")] or [np.zeros(0, np.uint32)])
        more = list(heavy_windows(left))
        u, p = np.concatenate([u, *(x[0] for x in more)]), np.concatenate([p, *(x[1] for x in more)])
        order = np.lexsort((p, u))
        u, p = u[order], p[order]
        uids = left.column("uid").to_numpy()
        a, b = np.searchsorted(u, uids), np.searchsorted(u, uids, "right")
        out: list[list] = [[] for _ in range(6)]
        for i, text in enumerate(left.column("text").cast(pa.large_binary())):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            spans = spans_of(p[a[i] : b[i]], window)
            kept, at = [], 0
            for x, y in spans.tolist():
                kept += words[at:x]
                at = y
            kept = b" ".join(kept + words[at:])
            gone = int((spans[:, 1] - spans[:, 0]).sum())
            for o, v in zip(out, (len(words), gone, hashlib.sha256(kept).hexdigest(), len(spans), kept.decode() if with_text else None, spans.tolist() if with_text else None)):
                o.append(v)
        columns = [left.column("id").combine_chunks(), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())]
        names = ["id", "n_words", "n_removed", "kept_sha256", "n_repeats"]
        if with_text:
            columns += [pa.array(out[4], pa.string()), pa.array(out[5], pa.list_(pa.list_(pa.int64())))]
            names += ["kept_text", "spans"]
        return pa.Table.from_arrays(columns, names)

    done = sides.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(remove, "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, n_repeats bigint" + extra)
    return done.withColumnRenamed("id", id_col)
