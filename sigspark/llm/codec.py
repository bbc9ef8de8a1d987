"""Token ids of white-space separated chunks by a public tokenizer, cached in each Python worker.

The tokenizer's pre-token pattern never crosses white space and its special strings hold none, so a text's ids are the
ids of its chunks in order. Chunks are cut at ASCII white space; other white space stays inside a chunk, where the
tokenizer itself handles it.
"""

from __future__ import annotations

import gc
import json
import os
import re

import numpy as np

CACHED = 1_200_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = ".,;:!?"
#: A word of lower-case letters below U+0180, and a mark or none.
WORD = re.compile("([a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f]+)([.,;:!?]?)")
_tokenizers: dict = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def _plain(path: str):
    """(encoder of already normal words split at spaces, as ``_spelled`` writes them, which ids end a word), or None if the
    tokenizer isn't of that kind."""
    key = (path, "plain")
    if key not in _tokenizers:
        full = json.loads(tokenizer(path).to_str())
        pre, model = full.get("pre_tokenizer") or {}, full.get("model") or {}
        if model.get("end_of_word_suffix") != "</w>" or [p["type"] for p in pre.get("pretokenizers", [])] != ["Split", "ByteLevel"] or pre["pretokenizers"][0]["pattern"].get("Regex") != PATTERN:
            _tokenizers[key] = None
        else:
            from tokenizers import Tokenizer
            from tokenizers.models import BPE

            full["normalizer"] = None
            full["pre_tokenizer"] = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
            vocabulary = tokenizer(path).get_vocab(with_added_tokens=False)
            ends = np.zeros(max(vocabulary.values()) + 3, bool)
            ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
            encoder = Tokenizer.from_str(json.dumps(full))
            encoder.model = BPE(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], cache_capacity=0, end_of_word_suffix="</w>")
            _tokenizers[key] = encoder, ends
    return _tokenizers[key]


def _byte_table() -> np.ndarray:
    """The character that byte-level vocabularies write for each byte; the space, at which words are split, stays."""
    out = np.arange(256, dtype="<u4")
    odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    out[odd] = 256 + np.arange(len(odd))
    out[32] = 32
    return out


BYTE_CHARS = _byte_table()


def _spelled(words: np.ndarray) -> str:
    """Bytes of words joined by spaces as the vocabulary writes them: what its ByteLevel step would do, in one go."""
    return BYTE_CHARS[words].tobytes().decode("utf-32-le")


def _pieces(ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    raw, at = ids.astype("<u4").tobytes(), [0, *(4 * cuts).tolist(), 4 * len(ids)]
    return [raw[a:b] for a, b in zip(at, at[1:])]


def _by_offsets(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each chunk: one call on the joined chunks, dealt back by offsets."""
    got = tokenizer(path).encode(" ".join(texts), add_special_tokens=False)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    at = np.array([o[0] for o in got.offsets], np.int64)
    return _pieces(np.array(got.ids, np.uint32), np.searchsorted(at, begins[1:]))


def _words(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each word, all of plain lower-case letters: each is one pre-token, so an id that ends a word ends a chunk."""
    encoder, ends = _plain(path)
    ids = np.array(encoder.encode_batch_fast([_spelled(np.frombuffer(" ".join(texts).encode(), np.uint8))], add_special_tokens=False)[0].ids, np.uint32)
    cuts = np.flatnonzero(ends[ids]) + 1
    return _pieces(ids, cuts[:-1]) if len(cuts) == len(texts) else _by_offsets(path, texts)


def encode_chunks(path: str, chunks: list[bytes]) -> list[bytes]:
    """Ids of each chunk, as little-endian 32-bit numbers. Words of letters below U+0180, which normalisation only
    lower-cases, take a shorter way; so do those before one of ``.,;:!?``, a pre-token of its own there."""
    if not chunks:
        return []
    texts = b"\n".join(chunks).decode("utf-8", "replace").split("\n")
    if _plain(path) is None:
        return _by_offsets(path, texts)
    if (path, "marks") not in _tokenizers:
        _tokenizers[path, "marks"] = dict(zip(MARKS, _by_offsets(path, [*MARKS]))) | {"": b""}
    marks = _tokenizers[path, "marks"]
    found = [*map(WORD.fullmatch, "\n".join(texts).lower().split("\n"))]
    parts = [m and m.groups() for m in found]
    words = list({p[0]: None for p in parts if p})
    ids = dict(zip(words, _words(path, words))) if words else {}
    other = [t for t, p in zip(texts, parts) if not p]
    rest = iter(_by_offsets(path, other) if other else ())
    return [ids[p[0]] + marks[p[1]] if p else next(rest) for p in parts]


class ChunkCache:
    """chunk -> value over a fixed first tier (never dropped) and a bounded second tier of misses."""

    def __init__(self, path: str, first: dict | None = None, as_ids: bool = False, most: int = CACHED):
        self.path, self.first, self.as_ids, self.most = path, first or {}, as_ids, most
        self.known = dict(self.first)
        self.marks: dict = {}

    def values(self, rows: list[list[bytes]]) -> list[list]:
        """The value of each chunk of each row. No object here is part of a cycle, so the collector rests meanwhile."""
        was = gc.isenabled()
        gc.disable()
        try:
            found = [[*map(self.known.get, r)] for r in rows]
            gaps = [[i for i, x in enumerate(v) if x is None] for v in found]
            self._fill({r[i] for r, g in zip(rows, gaps) for i in g}, rows)
            for r, v, g in zip(rows, found, gaps):
                for i in g:
                    v[i] = self.known[r[i]]
            return found
        finally:
            if was:
                gc.enable()

    def _fill(self, words: set[bytes], rows: list[list[bytes]]) -> None:
        """Encode these chunks, none of them known."""
        missing = list(words)
        if not missing:
            return
        if len(self.known) + len(missing) > self.most:
            # The chunks in use now stay: common ones are among them.
            known, self.known = self.known, dict(self.first)
            self.known.update((w, known[w]) for r in rows for w in r if w in known)
        if _plain(self.path) is not None:
            missing = self._marked(missing)
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            ids = encode_chunks(self.path, part)
            self.known.update(zip(part, ids if self.as_ids else [len(x) // 4 for x in ids]))


    def _marked(self, missing: list[bytes]) -> list[bytes]:
        """Known words before a mark need no encoding: the mark is a pre-token of its own after a letter."""
        known, left = self.known, []
        if not self.marks:
            self.marks = {m.encode(): v if self.as_ids else len(v) // 4 for m, v in zip(MARKS, encode_chunks(self.path, [m.encode() for m in MARKS]))}
        marks = self.marks
        for c in missing:
            mark = marks.get(c[-1:])
            base = known.get(c[:-1]) if mark is not None and 97 <= c[-2 if len(c) > 1 else -1] <= 122 else None
            if base is None:
                left.append(c)
            else:
                known[c] = base + mark
        return left


def lowered(text: bytes) -> bytes:
    """ASCII letters in lower case, as the tokenizer makes them, unless that could turn a text into a special string."""
    return text if b"|>" in text else text.lower()


def split(text: bytes) -> list[bytes]:
    return lowered(text).split()


def _class_table() -> np.ndarray:
    """Of each byte: 1 a to z, 2 the first byte of U+00C0 to U+00FF, 4 a second byte of U+00DF to U+00FF but U+00F7, 8 a mark."""
    out = np.zeros(256, np.uint8)
    out[97:123] = 1
    out[0xC3] = 2
    out[0x9F:0xC0] = 4
    out[0xB7] = 0
    out[list(MARKS.encode())] = 8
    return out


CLASS = _class_table()


def plain_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of these words are lower-case letters below U+0100 and at most one mark behind them; which have the mark."""
    kind = CLASS[data]
    lead = kind == 2
    second = (kind == 4) & np.concatenate((np.zeros(min(1, len(data)), bool), lead[:-1]))
    letter = (kind == 1) | second | (lead & np.concatenate((second[1:], np.zeros(min(1, len(data)), bool))))
    upto = np.concatenate(([0], np.cumsum(letter)))
    marked = (kind[ends - 1] == 8) & (ends - starts > 1)
    inner = ends - marked
    return upto[inner] - upto[starts] == inner - starts, marked


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """These words alone, a space behind each: bytes, first bytes and ends."""
    size = ends - starts
    upto = np.cumsum(size + 1)
    begins = upto - size - 1
    out = np.full(int(upto[-1]) if len(upto) else 0, 32, np.uint8)
    before = np.cumsum(size) - size
    at = np.arange(int(size.sum()))
    out[np.repeat(begins - before, size) + at] = data[np.repeat(starts - before, size) + at]
    return out, begins, begins + size


class WordIds:
    """Ids of words by hash, as arrays: no object is made for a plain word. At most ``most`` words are held, or the words
    of one call; where they overflow, those stay that were asked for again since they came or since the last overflow."""

    def __init__(self, path: str, most: int = CACHED):
        self.path, self.most, self.other = path, most, ChunkCache(path, as_ids=True)
        self._keep(np.zeros(0, np.int64))

    def _keep(self, some: np.ndarray) -> None:
        """Hold these of the words only."""
        if not len(some):
            self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.pool = [np.zeros(0, np.uint32)]
        else:
            self.hashes, at, self.size = self.hashes[some], self.at[some], self.size[some]
            self.at = np.cumsum(self.size) - self.size
            self.pool = [self.flat()[np.repeat(at - self.at, self.size) + np.arange(int(self.size.sum()))]]
        self.again = np.zeros(len(some), bool)
        self.used = len(self.pool[0])

    def flat(self) -> np.ndarray:
        if len(self.pool) > 1:
            self.pool = [np.concatenate(self.pool)]
        return self.pool[0]

    def places(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place in flat(), number of ids) of each of these words, whose hashes are sorted and differ."""
        if len(self.hashes) + len(hashes) > self.most:
            some = np.flatnonzero(self.again)
            self._keep(some if len(some) + len(hashes) <= self.most else some[:0])
        where = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[where] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        self.again[where[known]] = True
        missing = np.flatnonzero(~known)
        if len(missing):
            ids, size = self._encoded(*_joined(data, starts[missing], ends[missing]))
            at = self.used + np.cumsum(size) - size
            self.pool.append(ids)
            self.used += len(ids)
            into = np.searchsorted(self.hashes, hashes[missing])
            self.hashes, self.at, self.size, self.again = (np.insert(a, into, b) for a, b in ((self.hashes, hashes[missing]), (self.at, at), (self.size, size), (self.again, False)))
            where = np.searchsorted(self.hashes, hashes)
        return self.at[where], self.size[where]

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these words end to end, and how many each has."""
        plain, marked = plain_words(data, starts, ends) if _plain(self.path) is not None else (np.zeros(len(starts), bool), np.zeros(len(starts), bool))
        odd = np.flatnonzero(~plain)
        parts: list = []
        text = data.tobytes() if len(odd) else b""
        values = self.other.values([[text[a:b] for a, b in zip(starts[odd].tolist(), ends[odd].tolist())]])[0] if len(odd) else []
        sizes = np.zeros(len(starts), np.int64)
        sizes[odd] = np.fromiter(map(len, values), np.int64, len(values)) // 4
        some = np.flatnonzero(plain)
        for a in range(0, len(some), 50_000):
            part = some[a : a + 50_000]
            got = self._plain_ids(data, starts[part], (ends - marked)[part])
            if got is None:
                got = [np.frombuffer(x, "<u4") for x in self.other.values([[data[i:j].tobytes() for i, j in zip(starts[part].tolist(), (ends - marked)[part].tolist())]])[0]]
                got = np.concatenate(got), np.array([len(x) for x in got])
            parts.append((part, *got))
            sizes[part] = got[1]
        mark_ids = {m: np.frombuffer(v, "<u4") for m, v in zip(MARKS.encode(), self.other.values([[bytes([m]) for m in MARKS.encode()]])[0])} if marked[some].any() else {}
        width = np.zeros(256, np.int64)
        for m, v in mark_ids.items():
            width[m] = len(v)
        with_mark = some[marked[some]]
        last = data[ends[with_mark] - 1]
        total = sizes.copy()
        total[with_mark] += width[last]
        begin = np.cumsum(total) - total
        out = np.empty(int(total.sum()), np.uint32)

        def put(ids: np.ndarray, n: np.ndarray, at: np.ndarray) -> None:
            upto = np.cumsum(n)
            out[np.repeat(at - upto + n, n) + np.arange(len(ids))] = ids

        if len(odd):
            put(np.frombuffer(b"".join(values), "<u4"), sizes[odd], begin[odd])
        for part, ids, n in parts:
            put(ids, n, begin[part])
        for m, v in mark_ids.items():
            at = begin[with_mark[last == m]] + sizes[with_mark[last == m]]
            put(np.tile(v, len(at)), np.full(len(at), len(v)), at)
        return out, total

    def _plain_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their numbers of plain words without marks; None if an id that ends a word doesn't end each of them."""
        encoder, closes = _plain(self.path)
        joined = _joined(data, starts, ends)[0]
        ids = np.array(encoder.encode_batch_fast([_spelled(joined[:-1])], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(closes[ids]) + 1
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(starts) and cuts[-1] == len(ids) else None
