"""Substring, near and exact dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm import near_dedup
from sigspark.llm.components import components
from sigspark.llm.exact_dedup import decisions, drop_copies, possibly_repeated, ranges
from sigspark.llm.near_dedup import drop_near_copies, near_duplicates
from sigspark.llm.rows import FILE, ROW, bitmaps, located, marked
from sigspark.llm.substring_dedup import earlier_windows, spans_of, substring_dedup, whole_keys
from sigspark.llm.textnp import window_hashes, words_of

from .conftest import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substring(rows, k):
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    least: dict = {}
    for i, w in words.items():
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            least[g] = min(least.get(g, i), i)
    out = []
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - k + 1):
            if least[tuple(w[j : j + k])] < i:
                gone |= set(range(j, j + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,group", [(13, 1 << 20), (13, 64), (4, 500), (1, 100)])
def test_substring(spark, clashing, rows, window, group):
    got = substring_dedup(clashing, window=window, group=group).drop("n_repeats")
    assert table(got) == brute_substring(rows, window)


@pytest.mark.parametrize("window,group", [(13, 64), (1, 100)])
def test_substring_with_heavy_windows(docs, rows, window, group):
    """Windows that one batch of text holds twice count as heavy here, so that both ways are taken."""
    _, _, (heavy, least) = earlier_windows(docs.selectExpr("doc_id as id", "text"), window, group, report=2)
    assert len(heavy) == len(least) > 20
    assert table(substring_dedup(docs, window=window, group=group, report=2).drop("n_repeats")) == brute_substring(rows, window)


def test_whole_window_keys_are_independent():
    """Different windows of one window hash: their keys differ, those of equal windows don't."""
    import numpy as np

    from sigspark.llm.textnp import BASE, window_hashes

    x, y = 0x1234567, 0xABCDEF01
    h = np.array([x, y, x + BASE, y - 1, x, y], np.uint64)
    same, keys = window_hashes(h, 2)[::2], whole_keys(h, 2)[::2]
    assert same[0] == same[1] == same[2]
    assert keys[0] != keys[1] and keys[0] == keys[2]


def test_substring_text_and_spans(docs, rows):
    for r in substring_dedup(docs, with_text=True).collect():
        w = WORD.findall(dict((x[0], x[1]) for x in rows)[r.doc_id] or "")
        inside = {j for a, b in r.spans for j in range(a, b)}
        assert len(inside) == r.n_removed and r.n_repeats == len(r.spans)
        assert r.kept_text == " ".join(x for j, x in enumerate(w) if j not in inside)


def test_substring_odd_and_empty(odd, nothing):
    assert substring_dedup(nothing).count() == 0
    got = table(substring_dedup(odd, window=2).select("doc_id", "n_words", "n_removed"))
    # ids 5 share a rank, so neither removes from the other; the null id comes last and loses "x y"
    assert got == sorted([(None, 0, 0), (None, 2, 2), (5, 2, 0), (5, 2, 0), (5, 2, 0), (2, 1, 0), (1, 0, 0)], key=repr)


def test_spans():
    assert spans_of(np.array([3, 4, 5, 20, 33, 60]), 13).tolist() == [[3, 18], [20, 46], [60, 73]]
    assert spans_of(np.array([], np.int64), 13).tolist() == []


def test_window_hashes_tell_windows_apart():
    data = np.frombuffer(("a b a b c " * 500 + "b a").encode(), np.uint8)
    w = words_of(data, np.array([0, len(data)]))
    words = bytes(data).split()
    seen: dict = {}
    for i, h in enumerate(window_hashes(w.hashes, 3).tolist()):
        assert seen.setdefault(tuple(words[i : i + 3]), h) == h
    assert len(set(seen.values())) == len(seen)


def brute_near(rows, percent):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return sorted(((i, len(sets[i]), find(i), find(i) == i) for i in ids), key=repr)


@pytest.mark.parametrize("percent,block", [(85, 1024), (80, 2), (60, 3)])
def test_near(clashing, rows, percent, block):
    matches = 1 if percent < 80 else None
    got = near_duplicates(clashing, percent=percent, matches=matches, block=block)
    assert table(got) == brute_near(rows, percent)


def test_near_group_that_links_only_in_part(spark):
    """A chain of edits: neighbours link, far ones don't; one component all the same."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        words[5 * i % 200] = f"new{i}"
        rows.append((100 - i, " ".join(words), None, None, 0))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert table(near_duplicates(df, block=8)) == brute_near(rows, 85)


def test_near_long_chain(spark):
    """20,000 documents, each an edit of the one before: one component by links of neighbours only."""
    n = 20_000
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(79)), lambda i: F.concat(F.lit("w"), i.cast("string"), F.lit("x"), F.floor((F.col("id") + i * 7) / 80).cast("string"))), " ")
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("doc_id"), text.alias("text"))
    got = near_duplicates(df).groupBy("component_id").count().collect()
    assert [tuple(r) for r in got] == [(0, n)]


def test_near_large_group_of_different_copies_sends_rows_in_proportion(spark):
    """n different near copies of one another send n star rows, and nothing is left for pairs of blocks."""
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[: i % 118], f"own{i}", *words[i % 118 :]])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    staged = {}
    real = near_dedup.stage

    def spy(d, name):
        out = real(d, name)
        staged[name] = staged.get(name, 0) + out.count()
        return out

    near_dedup.stage = spy
    try:
        got = near_duplicates(df).groupBy("component_id").count().collect()
    finally:
        near_dedup.stage = real
    assert [tuple(r) for r in got] == [(0, 3000)]
    assert staged["near-stars"] < 8 * 3000 and staged.get("near-met", 0) < 3000


def test_near_rows_that_repeat_an_id_with_other_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b), (7, b + " more"), (3, "own text"), (3, "own text")], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()} == {(1, 1), (5, 1), (9, 1), (7, 1), (3, 3)}
    assert sorted(r.doc_id for r in drop_near_copies(df).collect()) == [1, 3]


def test_lists_merge_and_skip():
    r = np.random.default_rng(1)
    posts = r.integers(0, 4, (60, 9))
    posts = posts * 9 + np.arange(9)
    lists = near_dedup.Lists(posts)
    for p in range(60):
        want = [q for q in range(p + 1, 60) if (posts[p] == posts[q]).sum() >= 3]
        assert lists.partners(p, 3).tolist() == want


def test_near_odd_and_empty(odd, nothing, docs):
    assert near_duplicates(nothing).count() == 0
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(odd).collect()}
    assert got == {(None, 0, None), (None, 1, None), (5, 1, 5), (2, 1, 2), (1, 0, 1)}
    left = drop_near_copies(docs)
    assert left.columns == docs.columns and left.count() == near_duplicates(docs).where("kept").count()


def test_components(spark):
    e = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (5, 5)]
    got = dict(table(components(spark.createDataFrame(e, "u bigint, v bigint"))))
    assert got == {i: 0 for i in range(1, 31)} | {150: 100, 200: 100}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def brute_exact(rows):
    group: dict = {}
    for i, t, *_ in rows:
        group.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []).append((-len(t or ""), i))
    out = []
    for s, g in group.items():
        keep = min(g)[1]
        out += [(i, keep, len(g), i == keep, hashlib.sha256(s.encode()).hexdigest()) for _, i in g]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [1 << 29, 1 << 8])
def test_exact(clashing, rows, bits):
    got = decisions(clashing, max_bits=bits).select("id", "keep_id", "group_size", "kept", "text_sha256")
    assert table(got) == brute_exact(rows)


@pytest.mark.parametrize("bits", [1 << 29, 1 << 12])
def test_exact_small_filters_let_few_unique_rows_meet(spark, bits):
    """However small a range's filter is, about one unique row in twenty goes into the shuffle."""
    rows = spark.range(2000).selectExpr("id", "unhex(sha2(cast(id % 1990 as string), 256)) as sha").selectExpr("*", "xxhash64(sha) as h")
    count, cells = ranges(2000, bits)
    assert cells <= max(bits, 1 << 15) and count == (1 if bits > 16000 else 4)
    met = 0
    for i in range(count):
        part = rows.where(F.pmod(F.shiftright("h", 40), F.lit(count)) == i)
        met += possibly_repeated(part, cells).where("again").count()
    assert 20 <= met <= 20 + 200


def test_drop_copies_of_rows_read_from_files(spark, docs, rows, tmp_path):
    """Texts stay where they are: no exchange on the texts' side, the same rows as without files."""
    docs.withColumn("_extra", F.lit(1)).write.parquet(str(tmp_path / "d"))
    left = drop_copies(spark.read.parquet(str(tmp_path / "d")).where("doc_id is not null"))
    assert sorted(r.doc_id for r in left.collect()) == sorted(r[0] for r in brute_exact(rows) if r[3])
    assert "Exchange hashpartitioning" not in left._jdf.queryExecution().toString()


def test_marks_beyond_the_bound_of_a_broadcast(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    d = located(spark.read.parquet(str(tmp_path / "d")))
    maps = bitmaps(d.where("doc_id % 3 = 0").select(FILE, ROW))
    for most in (0, 10):
        assert marked(d, maps, "hit", most).where("hit <> (doc_id % 3 = 0)").count() == 0


def test_exact_large_group(spark):
    rows = [(i, f"same {'' if i % 2 else ' '}text" if i % 3 else f"own {i}", None, None, 0) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert table(decisions(df).select("id", "keep_id", "group_size", "kept", "text_sha256")) == brute_exact(rows)


def test_exact_odd_and_empty(odd, nothing, docs, rows):
    assert decisions(nothing).count() == 0 and drop_copies(nothing).count() == 0
    got = decisions(odd)
    assert got.agg(F.count_if("kept")).first()[0] == 3 and got.count() == 7
    left = drop_copies(odd)
    assert left.columns == odd.columns and left.count() == 3
    assert sorted(r.doc_id for r in drop_copies(docs).select("doc_id").collect()) == sorted(r[0] for r in brute_exact(rows) if r[3])
