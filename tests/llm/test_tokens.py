"""Token counts, packing and toxicity."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from sigspark.llm.codec import ChunkCache, WordIds, split, tokenizer  # noqa: E402
from sigspark.llm.packing import CELL_BITS, CELLS, Index, cell_counts, ids_of as packed_ids, order_of, pack, surveyed, words_in  # noqa: E402
from sigspark.llm.queries import tokenizer_path  # noqa: E402
from sigspark.llm.token_counts import token_counts  # noqa: E402
from sigspark.llm.toxicity import best_words, held_out, toxicity, train  # noqa: E402

from .conftest import table  # noqa: E402

PATH = tokenizer_path()


def ids_of(text):
    return tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n.,'!<|endoftxsarENDOF>éÉßİΣſKﬁ12³½\x1c\x85\xa0́​"))))
def test_chunks_equal_whole_text(text):
    c = ChunkCache(PATH, as_ids=True)
    chunks = split(text.encode())
    assert b"".join(c.values([chunks])[0]) == np.array(ids_of(text), "<u4").tobytes()


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|ENDOFTEXT|> <|endoftext|>", "it's I'LL don't we'd've", "word., w..! ?!,", "ª º µ ŉ ſ K ǅ", "日本語 12a3,4 ...,,", "é. é. ́ x"])
def test_known_difficult_texts(text):
    test_chunks_equal_whole_text.hypothesis.inner_test(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("  abcdefghéßü÷ÀÉ.,;:!?.,\t\n|>'1"))), max_size=8))
def test_ids_by_hash_equal_whole_texts(texts):
    import pyarrow as pa

    cache = WordIds(PATH, most=200)
    for _ in range(2):
        column = pa.array(texts, pa.large_string())
        raw, got = column.cast(pa.large_binary()), []
        for w in words_in(column):
            flat, begins = packed_ids(w, raw[len(got) : len(got) + len(w.first) - 1], cache, 1)
            got += [flat[a:b].tolist() for a, b in zip(begins[:-1], begins[1:])]
        assert got == [[*ids_of(t), 1] for t in texts]


def test_cache_stays_bounded():
    c = ChunkCache(PATH, {b"the": 1}, most=100)
    for k in range(20):
        assert None not in c.values([[b"w%d" % i for i in range(k * 30, k * 30 + 30)]])[0]
        assert len(c.known) <= 131 and c.known[b"the"] == 1


def test_words_that_come_again_outlive_an_overflow(monkeypatch):
    """Words that were asked for again aren't encoded anew when a flood of others fills the cache; ids stay right."""
    import pyarrow as pa

    asked: list = []
    encoded = WordIds._encoded
    monkeypatch.setattr(WordIds, "_encoded", lambda self, data, starts, ends: asked.extend(bytes(data[a:b]) for a, b in zip(starts, ends)) or encoded(self, data, starts, ends))
    cache, common = WordIds(PATH, most=100), ["the", "größe,", "it's", "日本語", "year"]
    for k in range(20):
        text = " ".join([*common, *("x" + "abcdefghij"[k % 10] * (k // 10 + 1) + chr(97 + i) + "é" * (i % 2) for i in range(20))])
        [w] = words_in(pa.array([text]))
        flat, begins = packed_ids(w, pa.array([text.encode()], pa.large_binary()), cache, 1)
        assert flat[begins[0] : begins[1]].tolist() == [*ids_of(text), 1]
        assert len(cache.hashes) <= 100
    assert all(asked.count(w.encode()) == 1 for w in common)


def test_counts(clashing, rows, odd, nothing):
    got = token_counts(clashing, PATH, limit=100)
    assert table(got) == sorted(((i, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 100) for i, t, *_ in rows), key=repr)
    assert token_counts(nothing, PATH).count() == 0
    assert token_counts(odd, PATH).agg(F.sum("n_tokens")).first()[0] == sum(len(ids_of(r.text)) for r in odd.collect())


@pytest.mark.parametrize("window,shard", [(2048, 2048), (64, 16)])
def test_pack(clashing, rows, window, shard):
    got = pack(clashing, PATH, window=window, shard_rows=shard).collect()
    ids = {i: [*ids_of(t), 1] for i, t, *_ in rows}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, p in by_doc.items():
        at = 0
        for r in sorted(p, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start : at], "<u4").tobytes())
        assert at == len(ids[i])
    for p in by_sequence.values():
        at = 0
        for r in sorted(p, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    full = sum(sum(r.length for r in p) == window for p in by_sequence.values())
    assert len(by_sequence) - full <= len({s >> 32 for s in by_sequence})


def test_pack_odd_and_empty(odd, nothing):
    assert pack(nothing, PATH).count() == 0
    assert pack(odd, PATH).agg(F.sum("length")).first()[0] == sum(len(ids_of(r.text)) + 1 for r in odd.collect())


def test_retrieval_follows_topics():
    import pyarrow as pa

    r = random.Random(1)
    topics = [[f"t{k}x{i}" for i in range(40)] for k in range(4)]
    common = [f"c{i}" for i in range(30)]
    texts = [" ".join(r.choice(topics[i % 4]) if r.random() < 0.4 else r.choice(common) for _ in range(60)) for i in range(40)]
    index = Index(words_in(pa.array(texts)))
    order = order_of(index, [60] * 40, 100_000)
    assert sorted(order) == list(range(40))
    same = sum(a % 4 == b % 4 for a, b in zip(order[:10], order[1:10]))
    assert same >= 8
    best = index.neighbours(0, np.ones(40, bool))
    assert best[0] == 0 and all(d % 4 == 0 for d in best[:8])


def test_query_has_all_words():
    """Two documents share only their lightest words, after 30 heavier ones that each has with others."""
    import pyarrow as pa

    heavy = [[f"h{k}x{i}" for i in range(30)] for k in range(2)]
    light = [f"l{i}" for i in range(10)]
    texts = [" ".join(heavy[0] + light), " ".join(heavy[1] + light), *(" ".join(h) for h in heavy), *(" ".join(light) for _ in range(6))]
    found = Index(words_in(pa.array(texts))).neighbours(0, np.ones(len(texts), bool))
    assert set(found.tolist()) == {0, 1, 2, *range(4, 10)}


def brute_bm25(texts, n, df, mean, seed, k1=1.2, b=0.75):
    """Scores of all texts for the words of one, word by word."""
    words = [t.split() for t in texts]
    out = np.zeros(len(texts))
    for w in set(words[seed]):
        if sum(w in x for x in words) < 2:
            continue
        idf = np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
        for i, x in enumerate(words):
            tf = x.count(w)
            out[i] += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(x) / mean))
    return out


def test_bm25_against_brute_force():
    import pyarrow as pa

    r = random.Random(4)
    texts = [" ".join(r.choice([f"w{j}" for j in range(40)]) for _ in range(r.randrange(1, 30))) for _ in range(60)] + ["", "alone"]
    parts = words_in(pa.array(texts))
    df = {w: sum(w in t.split() for t in texts) for t in texts for w in t.split()}
    mean = sum(len(t.split()) for t in texts) / len(texts)
    index = Index(parts)
    more = {w: 3 * c + len(w) for w, c in df.items()}
    counts = np.zeros(CELLS, np.int64)
    hashes = dict(zip([w for t in texts for w in t.split()], np.concatenate([p.hashes for p in parts]).tolist()))
    for w, h in hashes.items():
        counts[h >> (64 - CELL_BITS)] += more[w]
    larger = Index(parts, corpus=(1000, 20.0, counts))
    for seed in range(len(texts)):
        assert np.allclose(index.scores(seed), brute_bm25(texts, len(texts), df, mean, seed))
        assert np.allclose(larger.scores(seed), brute_bm25(texts, 1000, more, 20.0, seed))


def test_common_words_by_products_score_exactly_the_same(monkeypatch):
    """Matrix products over several blocks give the bits that posting lists give, so copies tie exactly."""
    import pyarrow as pa

    from sigspark.llm import packing

    r = random.Random(6)
    texts = [" ".join(r.choice([f"w{int(r.paretovariate(0.4)) % 90}", f"v{r.randrange(400)}"]) for _ in range(r.randrange(0, 80))) for _ in range(150)]
    parts = words_in(pa.array(texts + texts[:30]))
    monkeypatch.setattr(packing, "BLOCK", 7)
    some = Index(parts)
    monkeypatch.setattr(packing, "DENSE_ROWS", 0)
    none = Index(parts)
    assert some.by_common is not None and none.by_common is None and 0 < len(some.docs) < len(none.docs)
    for seed in range(180):
        score = some.scores(seed)
        assert (score == none.scores(seed)).all() and (score[:30] == score[150:]).all()


def test_order_is_greedy():
    """The best unused neighbour of the window's seed follows; the document that crosses a window's end seeds the next."""
    import pyarrow as pa

    r = random.Random(8)
    texts = [" ".join(r.choice([f"w{j}" for j in range(50)]) for _ in range(r.randrange(1, 12))) for _ in range(40)]
    index, lengths, window = Index(words_in(pa.array(texts))), [len(t.split()) for t in texts], 30
    names = np.array([i // 2 for i in range(40)])
    order, at, seed, used = order_of(index, lengths, window, 7, names), 7, None, set()
    for d in order:
        if seed is not None:
            score = index.scores(seed)
            left = [x for x in range(40) if x not in used and names[x] != names[seed] and score[x] > 0]
            if left:
                assert score[d] == max(score[x] for x in left)
            else:
                assert d == min(x for x in range(40) if x not in used)
                seed = None
        used.add(d)
        before, at = at // window, at + lengths[d]
        if seed is None or at // window != before:
            seed = d
    assert sorted(order) == list(range(40))


def test_corpus_counts_and_close_documents_meet(spark):
    import pyarrow as pa

    r = random.Random(9)
    topics = [[f"T{k}x{i}" for i in range(30)] for k in range(20)]
    rows = [(i, " ".join(r.choice(topics[i % 20]) for _ in range(40))) for i in range(400)] + [(400, None), (401, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = surveyed(df.select("text"))
    own = found.where("part < 0").collect()
    assert sum(x.n for x in own) == 400 * 40 and len(own) == 402
    cell = lambda t: {h >> (64 - CELL_BITS) for p in words_in(pa.array([t or ""])) for h in p.hashes.tolist()}
    assert cell_counts(found).sum() == sum(len(cell(t)) for _, t in rows)
    got = pack(df, PATH, window=512, shard_rows=40).collect()
    by: dict = {}
    for x in got:
        if x.doc_id < 400:
            by.setdefault(x.sequence_id, set()).add(x.doc_id % 20)
    # 20 topics dealt by chance would fill nearly every window with several.
    assert sum(len(t) for t in by.values()) / len(by) < 2.2


def test_pack_of_a_hot_key_is_spread(spark):
    """Copies that hold most rows go to several partitions, and sequences stay whole."""
    df = spark.createDataFrame([(i, "the same words here" if i % 3 else f"own{i} text") for i in range(900)], "doc_id bigint, text string")
    got = pack(df, PATH, window=64).collect()
    assert len(got) >= 900 and len({x.doc_id for x in got}) == 900
    copies = Counter(x.sequence_id >> 32 for x in got if x.doc_id % 3)
    assert len(copies) >= 6 and max(copies.values()) < 300


def test_ordered_pack_keeps_the_training_order(spark, odd, nothing, tmp_path):
    """Runs of the order follow one another in sequence_id, whatever the ids and the sizes of files are; tokens stay whole."""
    r = random.Random(2)
    ids = list(range(1200))
    r.shuffle(ids)
    text = {i: " ".join(r.choice(["tea", "cup", "sea", "sky"]) for _ in range(r.randrange(1, 40))) for i in ids}
    at = 0
    for file, n in ((9, 50), (99999, 700), (100000, 450)):
        folder = str(tmp_path / str(file))
        spark.createDataFrame([(i, text[i]) for i in ids[at : at + n]], "doc_id bigint, text string").coalesce(1).write.parquet(folder)
        source = next((tmp_path / str(file)).glob("part-*.parquet"))
        (tmp_path / "all").mkdir(exist_ok=True)
        source.rename(tmp_path / "all" / source.name.replace("part-00000", f"part-{file:05d}"))
        at += n
    got = pack(spark.read.parquet(str(tmp_path / "all")), PATH, window=64, ordered=True).collect()
    assert sum(x.length for x in got) == sum(len(ids_of(t)) + 1 for t in text.values())
    place = {i: k for k, i in enumerate(ids)}
    runs: dict = {}
    for x in got:
        runs.setdefault(x.sequence_id >> 32, set()).add(place[x.doc_id])
    in_order = [runs[k] for k in sorted(runs)]
    assert len(in_order) >= 10 and all(max(a) < min(b) for a, b in zip(in_order, in_order[1:]))
    assert pack(nothing, PATH, ordered=True).count() == 0
    assert pack(odd, PATH, ordered=True).agg(F.sum("length")).first()[0] == sum(len(ids_of(x.text)) + 1 for x in odd.collect())


def labelled(n=900, seed=5):
    r = random.Random(seed)
    syllables = "ba ko ti ren sol mar vin del tor pas".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    insults = ["idiot", "moron", "scumbag", "worthless"]
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randrange(3, 60))]
        y = int(i % 4 == 0)
        if y:
            x = r.choice(insults)
            x = [x, x + "###", x[:2] + "*" + x[2:], x.upper()][i // 4 % 4]
            w.insert(r.randrange(len(w)), x)
        docs.append((i, " ".join(w), None, None, 0))
        labels.append((i, 1, y))
    return docs, labels


def test_toxicity_on_held_out_rows(spark, nothing):
    docs, labels = labelled()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame([*docs, (5000, None, None, None, 0), (None, "x", None, None, 0)], schema).withColumns({c: F.lit("extra") for c in ("id", "y", "score", "l_id", "t")})
    lf = spark.createDataFrame([*labels, (None, 1, 1), (77777, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity(df, lf).collect()}
    assert len(got) == len(docs) + 2
    y = {i: t for i, _, t in labels}
    held = [r for i, r in got.items() if i in y and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    assert sum(r.predicted == y[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[5000].predicted == 0
    assert toxicity(nothing, lf).count() == 0
    assert {r.score for r in toxicity(df, lf.where("toxic = 0")).collect()} == {0.0}


def test_held_out_labels_teach_nothing(spark):
    docs, labels = labelled(300)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    lf = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    other = lf.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert table(toxicity(df, lf)) == table(toxicity(df, other))


def test_kernel_against_brute_force():
    """Shared subsequences of three characters over at most seven, each weighed by its span on either side."""
    from sigspark.llm.toxicity import LAMBDA, NORM, ORDER, SPAN, cut, kernel

    def vector(w):
        out = {}
        for a in range(len(w)):
            for b in range(a + 1, len(w)):
                for c in range(b + 1, min(len(w), a + SPAN)):
                    k = (w[a], w[b], w[c])
                    out[k] = out.get(k, 0) + LAMBDA ** (c - a + 1) / NORM[len(w)]
        return out

    words = [b"moron", b"mo1ron", b"aaaaaaaaaa", b"ab", b"abcdefghijklm", b"gfedcba", b"nom"]
    v = [vector(w.decode()) for w in words]
    want = [[sum(x * b.get(k, 0) for k, x in a.items()) for b in v] for a in v]
    assert ORDER == 3 and np.allclose(kernel(words, words), want, rtol=1e-4)
    long = bytes(range(97, 123)) * 3
    assert cut(b"short") == [b"short"] and set(b"".join(cut(long))) == set(long) and cut(long)[-1].endswith(long[-5:])


def test_gaps_are_tolerated():
    import pyarrow as pa

    docs, labels = labelled()
    m = train([d[1] for d in docs], [y for *_, y in labels])
    p = lambda w: float(m.probability(np.concatenate(list(best_words(m.table, m.bias, pa.array([w])))))[0])
    assert min(map(p, ["moron", "m.o.r.o.n", "mo*ron", "MORON", "worthxless", "x" * 5000 + " idiot"])) > 0.5
    assert max(map(p, ["solmar", "marvin", "tor", "ba", "pasdel"])) < 0.3
