"""Toxicity by a string-kernel support vector machine with Nystroem landmarks.

The kernel counts shared subsequences of ``ORDER`` = 3 characters inside a word, gaps allowed: a subsequence that spans
n characters weighs LAMBDA^n, up to ``SPAN`` characters, so inserted characters dim a match and don't remove it. A
word's vector is scaled by the norm of a word of its length. Words are lower-cased and lose their ASCII marks; words of over ``PIECE``
bytes are taken in overlapping pieces.

Training uses at most ``most`` labelled rows of each label (the first by a hash of the id), the documented bound on what
reaches the driver. Documents are labelled, words are not: words that label-1 documents hold far more often than label-0
documents start as positives, then each label-1 document's best word does, in rounds, with the hardest words of label-0
documents as negatives. Landmarks are positives and negatives; features are k(x, L) K_LL^-1/2; a squared-hinge linear
machine is fitted on them. As k is an inner product over character triples, the machine's sum over landmarks folds into
one weight per triple, exactly, and that table (1 MB) is broadcast. A document's score is a logistic function, fitted
on the training rows, of the values of its ``BEST`` best different words: a single word may look like an insult by chance.

Defined results: a null or blank text scores as the lowest value; without rows of both labels every score is 0; labels
of null and rows whose id has no document teach nothing; rows repeat as given; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textnp import slices, words_of

ORDER, SPAN, LAMBDA = 3, 7, 0.75
PIECE, STEP = 24, 12
MOST = 2000
LANDMARKS = 192
ROUNDS = 5
BEST, LOWEST, HIGHEST = 3, -2.0, 1.5
SURE = 8.0

MARK = 27
SYMBOL = np.full(256, MARK, np.int64)
SYMBOL[97:123] = np.arange(26) + 1
SYMBOL[48:58] = 28
SYMBOL[128:192] = 30 + np.arange(64) % 32
SYMBOL[192:] = 29
MARKS = bytes(np.flatnonzero(SYMBOL == MARK).astype(np.uint8))
CELLS = 64**3
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]


def _norms() -> np.ndarray:
    n = np.arange(PIECE + STEP + 1)
    total = sum(np.maximum(0, n - a - b) * LAMBDA ** (2 * (a + b + 1)) for a, b in GAPS)
    return np.sqrt(np.maximum(total, LAMBDA**6))


NORM = _norms()


def pieces(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Borders of the words cut to PIECE bytes or little more, and the word of each piece."""
    n = np.maximum(1, -(-(ends - starts - PIECE) // STEP) + 1)
    n = np.where(ends - starts <= PIECE, 1, n)
    word = np.repeat(np.arange(len(starts)), n)
    k = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    s = starts[word] + k * STEP
    return s, np.minimum(s + PIECE, ends[word]), word


def cut(word: bytes) -> list[bytes]:
    """The pieces of one word."""
    s, e, _ = pieces(np.array([0]), np.array([len(word)])) if len(word) > PIECE else ([0], [len(word)], None)
    return [word[a:b] for a, b in zip(s, e)]


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of these byte ranges end to end, without marks, and where each begins (one more)."""
    size = ends - starts
    begins = np.concatenate(([0], np.cumsum(size)))
    symbols = SYMBOL[data[np.repeat(starts - begins[:-1], size) + np.arange(begins[-1])]]
    stay = symbols != MARK
    return symbols[stay], np.concatenate(([0], np.cumsum(stay)))[begins]


def triples(symbols: np.ndarray, begins: np.ndarray):
    """(first positions, triples, weight) for each pair of gaps."""
    room = np.repeat(begins[1:], np.diff(begins)) - np.arange(len(symbols))
    for a, b in GAPS:
        at = np.flatnonzero(room > a + b)
        yield at, (symbols[at] << 12) | (symbols[at + a] << 6) | symbols[at + a + b], LAMBDA ** (a + b + 1)


def values(table: np.ndarray, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """<table, vector of the range> for each range."""
    total = np.zeros(len(symbols) + 1)
    for at, cell, weight in triples(symbols, begins):
        total[at] += table[cell] * weight
    sums = np.concatenate(([0.0], np.cumsum(total)))
    return (sums[begins[1:]] - sums[begins[:-1]]) / NORM[np.diff(begins)]


@dataclass
class Model:
    table: np.ndarray
    bias: float
    slopes: np.ndarray
    shift: float

    def probability(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.minimum(best, HIGHEST) @ self.slopes + self.shift, -40, 40)))


def best_words(table: np.ndarray, bias: float, column: pa.Array):
    """Values of the BEST best different words of each row, in falling order; LOWEST where there are fewer."""
    for at, to, data, offsets in slices(column, 1 << 22):
        out = np.full((to - at, BEST), LOWEST)
        w = words_of(data, offsets, lower=True)
        if len(w.starts):
            _, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
            s, e, word = pieces(w.starts[first], w.ends[first])
            value = np.full(len(first), -np.inf)
            np.maximum.at(value, word, values(table, *gathered(w.data, s, e)))
            value += bias
            found = np.flatnonzero(value[back] > LOWEST)
            doc = np.searchsorted(w.first, found, "right") - 1
            pair = np.unique(doc * len(first) + back[found])
            doc, v = pair // len(first), value[pair % len(first)]
            order = np.lexsort((-v, doc))
            doc, v = doc[order], v[order]
            rank = np.arange(len(doc)) - np.searchsorted(doc, doc, "left")
            out[doc[rank < BEST], rank[rank < BEST]] = v[rank < BEST]
        yield out


def _matrix(words: list[bytes], columns: dict | None = None):
    """Rows of (cell, value) of each word, scaled."""
    sizes = np.array([len(w) for w in words], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    symbols = SYMBOL[np.frombuffer(b"".join(words), np.uint8)] if len(words) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    rows, cells, weights = [], [], []
    for at, cell, weight in triples(symbols, begins):
        rows.append(owner[at])
        cells.append(cell)
        weights.append(np.full(len(at), weight))
    r, c, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cells, weights))
    return r, c, v / NORM[sizes[r]] if len(r) else v


def kernel(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    lr, lc, lv = _matrix(landmarks)
    used, at = np.unique(lc, return_inverse=True)
    dense = np.zeros((len(used), len(landmarks)), np.float32)
    np.add.at(dense, (at, lr), lv)
    out = np.zeros((len(words), len(landmarks)))
    for a in range(0, len(words), 2000):
        r, c, v = _matrix(words[a : a + 2000])
        pos = np.searchsorted(used, c)
        ok = (pos < len(used)) & (used[np.minimum(pos, len(used) - 1)] == c)
        r, pos, v = r[ok], pos[ok], v[ok]
        order = np.argsort(r, kind="stable")
        r, pos, v = r[order], pos[order], v[order]
        for i in range(0, len(r), 200_000):
            part = dense[pos[i : i + 200_000]] * v[i : i + 200_000, None].astype(np.float32)
            rr = r[i : i + 200_000]
            cut = np.flatnonzero(np.concatenate(([True], rr[1:] != rr[:-1])))
            np.add.at(out, a + rr[cut], np.add.reduceat(part, cut, axis=0))
    return out


def _machine(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        on = y * (x @ w) < 1
        xs = x[on] * c[on, None]
        new = np.linalg.solve(np.eye(x.shape[1]) * 1e-2 + xs.T @ x[on], xs.T @ y[on])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def train(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model | None:
    """A model of these labelled texts; None without both labels."""
    bags = [{p.translate(None, MARKS) for w in t.encode().lower().split() for p in cut(w)} for t in texts]
    yes, no = [b for b, t in zip(bags, toxic) if t], [b for b, t in zip(bags, toxic) if not t]
    if not yes or not no:
        return None
    seen, other = Counter(w for b in yes for w in b), Counter(w for b in no for w in b)
    # Labels may err, so a word of label-0 documents may still be a positive, if it is far rarer there.
    telling = {w for w, n in seen.items() if len(w) > 2 and n * len(no) >= 12 * (other[w] + 0.2) * len(yes)}
    rank = lambda w: (-seen[w], w)
    core = {w for w in telling if surprise(seen[w], other[w], len(yes) / len(bags)) >= SURE}
    clean = {w for w in other if w not in telling or seen[w] < 3}
    positive = sorted(core or telling, key=rank)[: 8 * landmarks if core else landmarks]
    if not positive:
        return None
    negatives = sorted(clean, key=lambda w: (hash_of(w), w))
    pool = _Pool(negatives)
    # A document with a frequent positive is explained by it; in others a rare word may be an altered insult.
    inside = [_Pool(sorted(b & core or b & telling)) for b in yes]
    marks = [*positive[: landmarks // 2], *negatives[: landmarks - min(len(positive), landmarks // 2)]]
    k = kernel(marks, marks)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    keep = value > 1e-4 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    hard = negatives[: 4 * landmarks]
    table, bias = np.zeros(CELLS), 0.0
    for turn in range(rounds):
        words = [*positive, *hard]
        y = np.concatenate((np.ones(len(positive)), -np.ones(len(hard))))
        x = np.hstack((kernel(words, marks) @ root, np.ones((len(words), 1))))
        c = np.where(y > 0, len(hard) / max(1, len(positive)), 1.0) * 2
        w = _machine(x, y, c)
        coefficients, bias = root @ w[:-1], float(w[-1])
        r, cell, v = _matrix(marks)
        table = np.zeros(CELLS)
        np.add.at(table, cell, v * coefficients[r])
        if turn == rounds - 1:
            break
        hard = list(dict.fromkeys([*hard, *pool.best(table, 4 * landmarks)]))
        chosen = {w for p in inside for w in p.best(table, 1, 0.3 - bias)}
        positive = sorted({*chosen, *positive[: landmarks // 2]}, key=rank)[: 8 * landmarks]
    best = np.concatenate([*best_words(table, bias, pa.array(texts, pa.large_string()))])
    return Model(table.astype(np.float32), bias, *_logistic(np.minimum(best, HIGHEST), np.array(toxic, float)))


def surprise(n: int, m: int, share: float) -> float:
    """Log likelihood ratio of n label-1 and m label-0 documents against the share of label-1 documents."""
    return n * np.log(n / ((n + m) * share)) + (m * np.log(m / ((n + m) * (1 - share))) if m else 0.0)


def hash_of(word: bytes) -> int:
    import zlib

    return zlib.crc32(word)


class _Pool:
    """Words whose values can be asked for again and again."""

    def __init__(self, words: list[bytes]):
        self.words = words
        sizes = [len(w) for w in words]
        self.begins = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.symbols = SYMBOL[np.frombuffer(b"".join(words), np.uint8)]

    def best(self, table: np.ndarray, n: int, least: float = -np.inf) -> list[bytes]:
        if not self.words:
            return []
        v = values(table, self.symbols, self.begins)
        n = min(n, len(v))
        return [self.words[i] for i in np.argpartition(-v, n - 1)[:n].tolist() if v[i] >= least]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of a ridge-held logistic fit."""
    z = np.hstack((x, np.ones((len(x), 1))))
    w, ridge = np.zeros(z.shape[1]), 1e-2 * np.eye(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``most`` rows of each label, never held-out ones."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("l_id")).agg(F.max(label_col).alias("y"))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(id_col).alias("d_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = texts.join(F.broadcast(picked), texts["d_id"] == picked["l_id"]).select("l_id", "y", "t").dropDuplicates(["l_id"])
    got = sorted(rows.collect(), key=lambda r: r.l_id)
    return [r.t for r in got], [int(r.y) for r in got]


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            if m is None:
                s = np.zeros(b.num_rows)
            else:
                s = m.probability(np.concatenate([np.zeros((0, BEST)), *best_words(m.table, m.bias, b.column(1))]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """Train on the labelled rows that aren't held out and score every row."""
    return score(docs, train(*training_rows(docs, labels, **kw)))
