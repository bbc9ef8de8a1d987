"""Maps, stores, sources, programs, scalars, views, streaming."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from sigspark.functions.scalars import char_literal, field, formatted, key_join, key_parts, octets, quotient
from sigspark.functions.views import Range, View
from sigspark.operators import aggregate as A
from sigspark.operators.ordering import total_order
from sigspark.operators.pmap import DomainError, MapSpec, PMap, all_of, any_of
from sigspark.plans.program import Param, UsageError, bind
from sigspark.sources.records import binary_source, concatenated, from_iterable, generated, key_source, text_source
from sigspark.sources.store import Catalog
from sigspark.streaming.live import upsert_stream

SPEC = MapSpec((("k", 0, 99),), ("v",), {"v": 7}, split=(10, 5))


def made(spark, pairs, spec=SPEC):
    return PMap.empty(spark, spec, {"v": "bigint"}).put(spark.createDataFrame(pairs, "k bigint, v bigint"))


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_get_put_member_remove(spark):
    m = made(spark, [(0, 7), (99, 5), (50, 1)])
    keys = spark.createDataFrame([(0,), (1,), (99,)], "k bigint")
    assert sorted(pairs(m.get(keys))) == [(0, 7), (1, 7), (99, 5)]
    # a stored default is present, an absent key is not
    assert sorted(pairs(m.member(keys))) == [(0, True), (1, False), (99, True)]
    assert pairs(m.remove(spark.createDataFrame([(50,), (2,)], "k bigint")).scan()) == [(0, 7), (99, 5)]
    assert sorted(pairs(m.put(spark.createDataFrame([(0, 8)], "k bigint, v bigint")).get(keys)))[0] == (0, 8)
    assert pairs(m.scan(0, 50)) == [(0, 7), (50, 1)]


def test_domain(spark):
    m = made(spark, [])
    with pytest.raises(DomainError):
        m.put(spark.createDataFrame([(100, 1)], "k bigint, v bigint"))
    with pytest.raises(DomainError):
        m.get(spark.createDataFrame([(-1,)], "k bigint"))
    assert pairs(m.get(spark.createDataFrame([(-1,)], "k bigint"), errors="null")) == [(-1, None)]
    assert sorted(pairs(m.test(spark.createDataFrame([(0,), (99,), (100,), (None,)], "k bigint"))), key=repr) == [(0, True), (100, False), (99, True), (None, False)]
    with pytest.raises(ValueError):
        MapSpec((("k", 2, 1),), ("v",))
    with pytest.raises(ValueError):
        MapSpec((), ("v",))
    with pytest.raises(ValueError):
        MapSpec((("k", 0, 1),), ("v",), encode=lambda v: v)


def test_defaults_codecs_copies_const(spark):
    spec = MapSpec((("k", 0, 99),), ("v",), lambda k, a: {"v": k * a}, params=(3,))
    assert pairs(made(spark, [], spec).get(spark.createDataFrame([(5,)], "k bigint"))) == [(5, 15)]
    lossy = MapSpec((("k", 0, 99),), ("v",), encode=lambda v: {"v": quotient(v["v"], 10)}, decode=lambda v: {"v": v["v"] * 10})
    assert pairs(made(spark, [(1, 37)], lossy).scan()) == [(1, 30)]
    m = made(spark, [(1, 2)])
    copy = m.copy_to(made(spark, []))
    assert pairs(copy.scan()) == [(1, 2)]
    with pytest.raises(ValueError):
        m.copy_to(copy)
    with pytest.raises(TypeError):
        m.copy_to(PMap.empty(spark, MapSpec((("j", 0, 9),), ("v",)), {"v": "bigint"}))
    with pytest.raises(PermissionError):
        PMap(SPEC, m.table, const=True).put(m.table)
    block, stripe, entry = SPEC.split_columns()
    assert tuple(spark.createDataFrame([(99,)], "k bigint").select(block, stripe, entry).first()) == (9, 1, 4)


def test_fold_and_merges(spark):
    a, b, c = made(spark, [(1, 1), (2, 2), (3, 3)]), made(spark, [(2, 5), (3, 5)]), made(spark, [(3, 1), (9, 9)])
    assert pairs(a.fold(b.table, lambda old, new: old + new).scan()) == [(1, 1), (2, 7), (3, 8)]
    assert pairs(a.fold(c.table, lambda old, new: old + new).scan())[-1] == (9, 16)
    assert pairs(any_of(a, b, c)) == [(1,), (2,), (3,), (9,)]
    assert pairs(all_of(a, b)) == [(2,), (3,)]
    assert pairs(all_of(a, b, c)) == [(3,)]
    assert pairs(any_of(a, c, low=2, high=8)) == [(2,), (3,)]


def test_aggregates(spark):
    df = spark.createDataFrame([(i, "u", x) for i, x in enumerate("aabbbcd")], "s bigint, u string, x string")
    assert sorted(pairs(A.top_n(df, ["u"], "x", 2)), key=repr) == [("u", 1, "b", 3), ("u", 2, "a", 2), ("u", 3, None, 2)]
    assert sorted(pairs(A.top_n_lossy(df, ["u"], "x", "s", 2)), key=repr) == [("u", "c", 1), ("u", "d", 1), ("u", None, 5)]
    assert pairs(A.last_per_key(df, ["u"], "x", ["s"])) == [("u", "d")]
    assert A.hierarchy(df, ["u", "x"], n=F.count(F.lit(1))).where("level = 0").first().n == 7
    r = spark.range(1).select(A.blend(F.lit(10.0), F.lit(None), 0.2), A.age(F.lit(10.0), 0.5), A.capped(F.lit(50), 39)).first()
    assert tuple(r) == (8.0, 5.0, 39)


def test_stores(spark, tmp_path):
    at = f"{tmp_path}/m"
    cat = Catalog(spark)
    with pytest.raises(FileNotFoundError):
        cat.map(at, SPEC, {"v": "bigint"}, mode="exists")
    with pytest.raises(FileNotFoundError):
        cat.map(at, SPEC, {"v": "bigint"}, const=True)
    store = cat.map(at, SPEC, {"v": "bigint"}, mode="new")
    assert cat.map(at, SPEC, {"v": "bigint"}) is store
    with pytest.raises(TypeError):
        cat.map(at, const=True)
    store.save(store.map.put(spark.createDataFrame([(3, 4)], "k bigint, v bigint")))
    store.save(store.map.fold(spark.createDataFrame([(3, 1), (4, 1)], "k bigint, v bigint"), lambda o, n: o + n))
    again = Catalog(spark).map(at, const=True)
    assert pairs(again.map.scan()) == [(3, 5), (4, 8)] and again.map.spec.split == (10, 5)
    with pytest.raises(PermissionError):
        again.save(again.map)
    with pytest.raises(FileExistsError):
        Catalog(spark).map(at, SPEC, {"v": "bigint"}, mode="new")
    with pytest.raises(TypeError):
        Catalog(spark).map(at, MapSpec((("k", 0, 5),), ("v",)))


def test_directories_and_pickles(spark, tmp_path):
    import json

    load, dump = (lambda t: json.loads(t) if t else {}), json.dumps
    fields = {"n": 3, "s": {"x": [1, 2], "y": "a"}, "m": (SPEC, {"v": "bigint"}), "p": (load, dump), "derived": lambda f: f["n"] + 1, "sub": {"_directory": True, "z": 0.5}}
    d = Catalog(spark).directory(f"{tmp_path}/d", fields, mode="new")
    d["n"] = 8
    d["p"].value["w"] = 1
    d["m"].save(d["m"].map.put(spark.createDataFrame([(1, 1)], "k bigint, v bigint")))
    d["sub"]["z"] = 2.5
    d.save()
    e = Catalog(spark).directory(f"{tmp_path}/d", fields, mode="exists", const=True)
    assert (e["n"], e["s"], e["p"].value, e["derived"], e["sub"]["z"]) == (8, {"x": [1, 2], "y": "a"}, {"w": 1}, 4, 2.5)
    assert pairs(e["m"].map.scan()) == [(1, 1)]
    with pytest.raises(PermissionError):
        e["n"] = 1
    f = Catalog(spark).directory(f"{tmp_path}/f", fields)
    e.copy_to(f)
    g = Catalog(spark).directory(f"{tmp_path}/f", fields)
    assert g["n"] == 8 and pairs(g["m"].map.scan()) == [(1, 1)] and g["p"].value == {"w": 1}
    with pytest.raises(KeyError):
        g["nope"] = 1


def test_text_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b").write_text("3|x|\r\n|y|\nbad\n")
    (tmp_path / "in" / "a").write_text("1|p|\n2||\n")
    got = text_source(spark, str(tmp_path / "in"), lambda v: {"n": field(v, 0, "bigint"), "s": field(v, 1)}, keep=lambda v: field(v, 0, "bigint").isNotNull())
    assert [tuple(r) for r in got.orderBy("_seq").select("n", "s").collect()] == [(1, "p"), (2, None), (3, "x")]
    (tmp_path / "in" / "sub").mkdir()
    with pytest.raises(IsADirectoryError):
        key_source(spark, str(tmp_path / "in"))
    (tmp_path / "none").mkdir()
    assert key_source(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "keys").write_text("5\n junk 7\nzz\n-3\n900\n")
    assert [r.key for r in key_source(spark, str(tmp_path / "keys"), -5, 100).orderBy("_seq").collect()] == [5, 7, -3]
    with pytest.raises(FileNotFoundError):
        key_source(spark, str(tmp_path / "missing"))


def test_binary_and_other_sources(spark, tmp_path):
    (tmp_path / "r").write_bytes(b"".join(struct.pack("<iq", i, -i) for i in range(10)))
    got = binary_source(spark, str(tmp_path / "r"), "<iq", ["a", "b"], keep=lambda d: d["a"] % 2 == 0)
    assert [tuple(r) for r in got.orderBy("_seq").collect()] == [(i, -i, i) for i in range(0, 10, 2)]
    (tmp_path / "r").write_bytes(b"123")
    with pytest.raises(Exception, match="no multiple"):
        binary_source(spark, str(tmp_path / "r"), "<iq", ["a", "b"]).collect()
    g = generated(spark, 10, lambda i: {"v": i * i}, lambda i: i % 2 == 0)
    assert [r.v for r in g.orderBy("_seq").collect()] == [0, 4, 16, 36, 64]
    both = concatenated(from_iterable(spark, [(1,), (2,)], "v bigint"), from_iterable(spark, [(3,)], "v bigint"))
    assert [tuple(r) for r in both.orderBy("_seq").collect()] == [(0, 1), (1, 2), (2, 3)]


def test_scalars_views_ranges(spark):
    df = spark.createDataFrame([(7325551234, "10.0.0.255"), (-7, "1.2.3.256"), (0, "x")], "k bigint, a string")
    parts = key_parts(F.col("k"), 1000, 10000)
    r = df.select(*parts, key_join(parts, 1000, 10000), octets(F.col("a")), quotient(F.col("k"), 2)).collect()
    assert tuple(r[0]) == (732, 555, 1234, 7325551234, 10 + 255 * 256**3, 3662775617)
    assert r[1][4] is None and r[1][5] == -3 and r[2][4] is None
    assert [char_literal(x) for x in ("a", r"\n", r"'\x41'", r"\101", r"\\", " ")] == [97, 10, 65, 65, 92, 32]
    for bad in ("", "ab", r"\777", r"\q"):
        with pytest.raises(ValueError):
            char_literal(bad)
    assert df.select(formatted("%05lld|%s", F.col("k") % 100, F.col("a"))).first()[0] == "00034|10.0.0.255"
    v = View.record(a=View(lambda c: c + 1, lambda c: c - 1), b=View(lambda c: c * 2, lambda c: c / 2).array()).then(View.same())
    s = spark.createDataFrame([((1, [1.0, 2.0]),)], "r struct<a:int,b:array<double>>")
    assert s.select(v.to_physical(F.col("r")).alias("p")).first().p == (2, [2.0, 4.0])
    assert s.select(v.to_logical(v.to_physical(F.col("r"))).alias("p")).first().p == (1, [1.0, 2.0])
    with pytest.raises(ValueError):
        Range(2, 1)
    with pytest.raises(Exception, match="outside"):
        df.select(Range(0, 5).checked(F.col("k"))).collect()
    f = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (-1.0,)], "x double")
    assert [str(r.x) for r in f.orderBy(total_order("x")).collect()] == ["-1.0", "-0.0", "0.0", "nan"]


def test_programs():
    params = [Param("prog"), Param("n", "short", "n", default=5), Param("v", "flag", "v"), Param("c", "char", "c", default=0), Param("x", "double"), Param("m", lambda t, mode: (t, mode), "m", default=None, mode="new")]
    assert bind(params, ["me", "-n", "12", "2.5", "-v", "-mpath"]) == {"prog": "me", "n": 12, "v": True, "c": 0, "x": 2.5, "m": ("path", "new")}
    assert bind(params, ["me", "-c", r"\t", " -4 "])["c"] == 9
    for bad in (["me"], ["me", "1", "2"], ["me", "-n", "40000", "1"], ["me", "-n"], ["me", "-z", "1"], ["me", "--"], ["me", "-n1", "-n2", "1"], ["me", "abc"], ["me", "-v", "-v", "1"]):
        with pytest.raises(UsageError):
            bind(params, bad)
    with pytest.raises(UsageError):
        bind([Param("f", "float", "f")], ["me", "-f", "1e300"])


def test_streaming(spark, tmp_path):
    from sigspark.streaming.live import live_counts, sessions, upsert_stream, windowed

    src = tmp_path / "events"
    data = [(i, i % 3, f"2024-01-01 00:{i:02d}:00") for i in range(30)]
    df = spark.createDataFrame(data, "event_id bigint, k bigint, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(src))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(src))
    store = Catalog(spark).map(f"{tmp_path}/m", SPEC.__class__((("k", 0, 99),), ("n",), {"n": 0}), {"n": "bigint"})
    for _ in range(2):  # the second run finds nothing new
        q = upsert_stream(stream(), store, {"n": F.count(F.lit(1))}, lambda o, n: o + n, f"{tmp_path}/cp")
        q.awaitTermination(60)
    assert pairs(store.map.scan()) == [(0, 10), (1, 10), (2, 10)]
    for name, out, mode in (("a", live_counts(stream(), "k"), "update"), ("b", windowed(stream(), "ts", ["k"], "10 minutes", "0 seconds", {"n": F.count(F.lit(1))}), "complete"), ("c", sessions(stream(), "ts", ["k"], "5 minutes", "0 seconds", {"n": F.count(F.lit(1))}), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert q.exception() is None
    assert sorted(r.n for r in spark.table("a").collect()) == [10, 10, 10]
    assert spark.table("b").agg(F.sum("n")).first()[0] == 30 and spark.table("c").count() == 3


def test_put_keeps_the_last_or_fails(spark):
    spec = MapSpec((("k", 0, 100),), ("v",), {"v": 0})
    rows = spark.createDataFrame([(1, 10, 0), (1, 20, 1), (2, 5, 2)], "k bigint, v bigint, _seq bigint")
    m = PMap.empty(spark, spec, {"v": "bigint"})
    assert [tuple(r) for r in m.put(rows).scan().collect()] == [(1, 20), (2, 5)]
    assert [tuple(r) for r in m.put(rows.drop("_seq").withColumn("at", -F.col("v")), order="at").scan().collect()] == [(1, 10), (2, 5)]
    with pytest.raises(Exception, match="put twice"):
        m.put(rows.drop("_seq")).scan().collect()


def test_binary_source_is_split_and_padded(spark, tmp_path):
    rows = [(i % 100, -i, i * 0.5) for i in range(5000)]
    for layout in ("@bid", ">bid", "<bid"):
        at = tmp_path / f"f{ord(layout[0])} x"
        at.write_bytes(b"".join(struct.pack(layout, *r) for r in rows))
        got = binary_source(spark, str(at), layout, ["a", "b", "c"], chunk=700)
        assert got.rdd.getNumPartitions() > 1
        assert [tuple(r) for r in got.orderBy("_seq").drop("_seq").collect()] == rows
    with pytest.raises(ValueError):
        binary_source(spark, str(at), "<qqq", ["a", "b", "c"])


def test_keys_between_other_characters(spark, tmp_path):
    (tmp_path / "k").write_text("12 13 14\nx7y8\n\n-5+6 99999999999999999999 1")
    got = key_source(spark, str(tmp_path / "k")).orderBy("_seq").collect()
    assert [tuple(r) for r in got] == list(enumerate([12, 13, 14, 7, 8, -5, 6, 1]))


def test_a_crash_after_the_pointer_does_not_fold_twice(spark, tmp_path):
    """The batch number is part of the pointer: whatever stops the writer, a batch is in the map once."""
    spec = MapSpec((("k", 0, 100),), ("n",), {"n": 0})
    events = spark.createDataFrame([(1,), (1,), (2,)], "k bigint")
    events.write.parquet(str(tmp_path / "in"))

    def run(crash):
        store = Catalog(spark).map(str(tmp_path / "map"), spec, {"n": "bigint"})
        real = type(store).save

        class Crashing(type(store)):
            def save(self, new, partitions=None, note=""):
                if crash == "before":
                    raise OSError("lost")
                real(self, new, partitions, note)
                if crash == "after":
                    raise OSError("lost")

        store.__class__ = Crashing
        stream = spark.readStream.schema("k bigint").parquet(str(tmp_path / "in"))
        q = upsert_stream(stream, store, {"n": F.count(F.lit(1))}, lambda a, b: a + b, str(tmp_path / "check"))
        try:
            q.awaitTermination()
        except Exception as e:
            assert "lost" in str(e)

    for crash in ("before", "after", None, None):
        run(crash)
    assert [tuple(r) for r in Catalog(spark).map(str(tmp_path / "map"), mode="exists").map.scan().collect()] == [(1, 2), (2, 1)]


def test_two_writers_share_no_version(spark, tmp_path):
    spec = MapSpec((("k", 0, 100),), ("n",), {"n": 0})
    one = Catalog(spark).map(str(tmp_path / "m"), spec, {"n": "bigint"})
    two = Catalog(spark).map(str(tmp_path / "m"), mode="exists")
    rows = lambda n: spark.createDataFrame([(1, n)], "k bigint, n bigint")
    one.save(one.map.put(rows(5)))
    two.save(two.map.put(rows(6)))
    assert (one.version, two.version) == (1, 2) and one.map.scan().first().n == 5 and two.map.scan().first().n == 6


def test_a_copied_directory_shares_nothing(spark, tmp_path):
    load = lambda t: json.loads(t) if t else []
    fields = {"list": [1], "state": (load, json.dumps)}
    c = Catalog(spark)
    one, two = c.directory(str(tmp_path / "a"), fields), c.directory(str(tmp_path / "b"), {"list": [], "state": (load, json.dumps)})
    one["state"].value.append(1)
    one.copy_to(two)
    two["list"].append(2)
    two["state"].value.append(2)
    assert one["list"] == [1] and one["state"].value == [1]


def test_byte_streams(spark, tmp_path):
    import gzip

    from sigspark.sources import bytestreams as B

    for data in (b"", b"a", b"aaab" * 300, b"x" * 1000, bytes(range(256)) * 2):
        assert B.from_run_length(B.run_length(data)) == data and B.from_delta(B.delta(data)) == data
        there, back = B.mapped(bytes(reversed(range(256))))
        assert back(there(data)) == data
    with pytest.raises(ValueError):
        B.mapped(bytes(256))
    (tmp_path / "z").write_bytes(gzip.compress(b"one\r\ntwo\r\nthree\r\n\x1a"))
    seen = []
    assert B.tee(seen.append)(b"q") == b"q" and seen == [b"q"]
    got = B.decoded(spark, [str(tmp_path / "z")], B.inflated, B.dos, B.segment(4), B.filtered("tr", "a-z", "A-Z"))
    assert [(r.line, r.value) for r in got.orderBy("line").collect()] == [(0, "TWO"), (1, "THREE")]


def test_coded_columns():
    import pyarrow as pa

    from sigspark.sources import bytestreams as B

    values = [b"", b"a", None, b"aa", b"a" * 255, b"a" * 256, b"ab" * 3, b"", b"b" * 1000, b"\x00", b"\xff\x00", None]
    column = pa.array([b"before", *values, b"after"])[1:-1]
    table = bytes(range(1, 256)) + b"\x00"
    want = [b"", b"\x01a", None, b"\x02a", b"\xffa", b"\xffa\x01a", b"\x01a\x01b" * 3, b"", b"\xffb" * 3 + b"\xebb", b"\x01\x00", b"\x01\xff\x01\x00", None]
    assert B.coded(B.run_length, column).to_pylist() == want  # no run goes on in the next record
    for to, fro in ((B.run_length, B.from_run_length), (B.delta, B.from_delta), B.mapped(table)):
        there = B.coded(to, column)
        assert there.to_pylist() == [None if v is None else to(v) for v in values]
        assert B.coded(fro, there).to_pylist() == values
        assert B.coded(to, column[:0]).to_pylist() == []
    with pytest.raises(ValueError):
        B.coded(B.from_run_length, pa.array([b"abc", b"d"]))
    for size in (1, 300, 1 << 20):
        parts = [p.to_pylist() for p in B.pieces(column, size)]
        assert sum(parts, []) == values and all(len(p) == 1 or sum(len(v or b"") for v in p) <= size for p in parts)
