"""The pipeline, stage by stage, against brute force; every query runs on the smallest tables."""

import hashlib
import os
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sigspark.llm import queries  # noqa: E402

from .conftest import table  # noqa: E402
from .test_dedup import brute_exact, brute_near  # noqa: E402
from sigspark.llm.codec import tokenizer  # noqa: E402

from .test_native import WORD, brute_quality, brute_targets  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark, docs, rows):
    step = {name: f for name, f in corpus_pipeline.STAGES}
    assert len(step) == 5
    q = step["quality_rules"](spark, docs, "").cache()
    kept = {r[0] for r in brute_quality(rows, 50, 0.1, 0.3) if r[-1]}
    assert {r.doc_id for r in q.collect()} == kept and q.columns == corpus_pipeline.COLUMNS
    rest = [tuple(r) for r in q.collect()]
    e = step["exact_dedup"](spark, q, "").cache()
    assert {r.doc_id for r in e.collect()} == {r[0] for r in brute_exact(rest) if r[3]}
    rest = [tuple(r) for r in e.collect()]
    n = step["near_dedup"](spark, e, "").cache()
    assert {r.doc_id for r in n.collect()} == {r[0] for r in brute_near(rest, 80) if r[3]} and n.columns == corpus_pipeline.COLUMNS
    m = step["source_mix"](spark, n, "").cache()
    assert m.columns == corpus_pipeline.COLUMNS and m.where("n_chars <> length(text)").count() == 0
    mixed = [tuple(r) for r in m.collect()]
    assert sorted(brute_mix([tuple(r) for r in n.collect()]), key=repr) == sorted(((r[0], r[1]) for r in mixed), key=repr)
    # Packing: the pieces of a document are its ids, in order, once for each time that it is in the mix.
    pieces = Counter()
    for r in step["packing"](spark, m, "").collect():
        pieces[r.doc_id, r.doc_tokens] += r.length
    want = Counter()
    for i, t, *_ in mixed:
        k = len(tokenizer(corpus_pipeline.tokenizer_path()).encode(t or "", add_special_tokens=False).ids) + 1
        want[i, k] += k
    assert pieces == want


def brute_mix(rows):
    """(id, text) of each time a document is taken: sources in hash order, twice over, until the target is met."""
    size, target = brute_targets(rows)
    out = []
    for s in size:
        left = round(target[s])
        own = sorted((hashlib.md5(str(r[0]).encode()).hexdigest(), r[0], r[1] or "") for r in rows if r[3] == s)
        for _ in range(2):
            for _, i, t in own:
                w = WORD.findall(t)
                n = min(len(w), left)
                left -= n
                if n:
                    out.append((i, t if n == len(w) else " ".join(w[:n])))
    return out


def test_pipeline_on_nothing(spark, nothing):
    df = nothing
    for _, step in corpus_pipeline.STAGES:
        df = step(spark, df, "")
    assert df.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = queries.queries()[name](spark, DATA)
    if name not in queries.oracle_sql():
        assert got.count() > 0
        return
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    want = c.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda v: None if v is None else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    at = [want.columns.index(c) for c in columns]
    a = sorted((tuple(map(plain, r)) for r in table(got.select(*columns))), key=repr)
    assert a == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
