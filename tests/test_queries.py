"""Every engine query against its SQL on the smallest tables; the entry point; what the engine may not import."""

import os
import re
from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]

from sigspark.plans import queries as engine  # noqa: E402


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    return c


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query(spark, duck, name):
    got = engine.queries()[name](spark, DATA)
    if name not in engine.oracle_sql():
        assert got.count() > 0
        return
    want = duck.sql(engine.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


def test_iterable_has_all_types(spark, tmp_path):
    spark.range(1500).selectExpr("id as event_id", "printf('t%04d', id) as event_type").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in engine.queries()["src05_iterable"](spark, str(tmp_path)).select("_seq", "event_type", "n").collect())
    assert got == [(i, f"t{i:04d}", 1) for i in range(1500)]


def _codec_check(monkeypatch, spark):
    """What scl08_byte_codecs runs on the executors."""
    from unittest.mock import MagicMock

    from sigspark.plans import more_queries

    table = MagicMock()
    monkeypatch.setattr(more_queries, "_events", lambda *a: table)
    more_queries.scl08_byte_codecs(spark, DATA)
    return table.mapInArrow.call_args.args[0]


def test_byte_codecs_take_no_step_a_row(spark, monkeypatch):
    import sys

    import pyarrow as pa

    check = _codec_check(monkeypatch, spark)

    def calls(n):
        batch, seen = pa.RecordBatch.from_arrays([pa.array([f"type{i % 7}" for i in range(n)])], ["event_type"]), []
        sys.setprofile(lambda frame, event, arg: seen.append(1) if event in ("call", "c_call") else None)
        try:
            list(check(iter([batch])))
        finally:
            sys.setprofile(None)
        return len(seen)

    calls(10)
    assert calls(10_000) < 2 * calls(100)


def test_byte_codecs_see_one_bad_row(spark, monkeypatch):
    import pyarrow as pa

    from sigspark.plans import more_queries

    monkeypatch.setattr(more_queries, "from_delta", more_queries.delta)
    check = _codec_check(monkeypatch, spark)
    found = [r for b in check(iter([pa.RecordBatch.from_arrays([pa.array(["", "click"])], ["event_type"])])) for r in b.to_pylist()]
    assert {r["codec"] for r in found if not r["same"]} == {"delta"}


@pytest.mark.parametrize("values", [[], [None], ["view", None, "", "é", "a" * 700, "aab", "b"]])
def test_byte_codecs_odd_rows(spark, tmp_path, values):
    spark.createDataFrame([(v,) for v in values], "event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = engine.queries()["scl08_byte_codecs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("delta", True), ("map", True), ("run length", True)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_needs_the_training_data_operators():
    for f in [*(ROOT / "sigspark").rglob("*.py")]:
        if "llm" not in f.parts:
            assert not re.search(r"\bllm\b", f.read_text()), f
