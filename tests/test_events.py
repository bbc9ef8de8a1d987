"""Streams, windows, boundaries, multi-unions."""

import pytest
from pyspark.sql import functions as F

from sigspark.operators.boundary import prefix_flags, run_flags
from sigspark.operators.ordering import RANK, ahead, back, neighbours, ranked, take_until
from sigspark.plans.munion import Munion
from sigspark.plans.stream import Stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [4, 1 << 16])
@pytest.mark.parametrize("n", [0, 1, 3, 57])
def test_neighbours_equal_plain_lists(spark, n, block):
    data = [(i, (i * 7) % 5) for i in range(n)]
    df = spark.createDataFrame(data, "i bigint, k bigint")
    order = sorted(data, key=lambda r: (r[1], r[0]))
    got = neighbours(ranked(df, ["k"], "i", partitions=3), {"b": back("i", 2), "a": ahead("i", 1)}, 2, 1, block=block).orderBy(RANK).select("i", "b", "a", RANK).collect()
    want = [(r[0], order[j - 2][0] if j >= 2 else None, order[j + 1][0] if j + 1 < n else None, j) for j, r in enumerate(order)]
    assert [tuple(r) for r in got] == want


def test_sorts_are_stable_and_nested_keys_work(spark):
    df = spark.createDataFrame([(0, (2, -1)), (1, (-3, 9)), (2, (2, -1)), (3, (2, -7))], "s bigint, k struct<a:int,b:int>")
    assert [r.s for r in ranked(df, ["k"], "s").orderBy(RANK).collect()] == [1, 3, 0, 2]
    with pytest.raises(ValueError):
        ranked(df, ["nope"], "s")


def test_sorted_whole_record(spark):
    df = spark.createDataFrame([(3, 1, "b"), (4, 1, "a"), (5, 0, "z")], "s bigint, x int, y string")
    assert [r.s for r in Stream(df, "s").sorted().ordered().orderBy(RANK).collect()] == [5, 4, 3]


def test_begin_and_end_counts_equal_keys(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(20)], "s bigint, a bigint, b bigint")
    f = prefix_flags(df, ["a", "b"], "s").agg(*[F.count_if(c).alias(c) for c in ("begin_0", "end_0", "begin_1", "end_1")]).first()
    assert tuple(f) == (3, 3, 6, 6)
    g = run_flags(df, ["a", "b"], "s", [["a"], ["a", "b"]]).agg(*[F.count_if(c).alias(c) for c in ("begin_0", "end_0", "begin_1", "end_1")]).first()
    assert tuple(f) == tuple(g)
    with pytest.raises(ValueError):
        prefix_flags(df, ["a", "b"], "s", [["b"]])


def test_key_change_at_every_row_and_one_key_only(spark):
    each = spark.createDataFrame([(i, i) for i in range(5)], "s bigint, k bigint")
    one = spark.createDataFrame([(i, 7) for i in range(5)], "s bigint, k bigint")
    assert run_flags(each, ["k"], "s", [["k"]]).where("begin_0 and end_0").count() == 5
    assert run_flags(one, ["k"], "s", [["k"]]).agg(F.count_if("begin_0"), F.count_if("end_0")).first() == (1, 1)


def test_filter_and_sort_commute(spark):
    df = spark.createDataFrame([(i, (i * 5) % 7) for i in range(30)], "s bigint, v bigint")
    a = Stream(df, "s").filtered(F.col("v") > 2).sorted_by("v").ordered()
    b = Stream(df, "s").sorted_by("v").filtered(lambda d: d["v"] > 2).ordered()
    assert rows(a) == rows(b)


def test_window_slots_and_checks(spark):
    df = spark.createDataFrame([(0, 5), (1, 6)], "s bigint, v bigint")
    m = Munion({"e": "bigint"})
    with pytest.raises(ValueError):
        Stream(df, "s").detect(m, lambda w: None, size=2, offset=2)
    with pytest.raises(IndexError):
        Stream(df, "s").sorted_by("s").detect(m, lambda w: w[3]["v"], size=3, offset=1).events()
    e = Stream(df, "s").sorted_by("s").detect(m, lambda w: m.build(e=w[0]["v"] + w[2]["v"]), size=3, offset=1).events()
    assert [m for (m,) in e.select("event.e.on").collect()] == [False, False]


def test_handlers_run_in_listing_order_and_unlisted_events_are_ignored(spark):
    df = spark.createDataFrame([(0, 1), (1, 2)], "s bigint, v bigint")
    m = Munion({"a": "bigint", "b": "bigint", "c": None})
    s = Stream(df, "s").sorted_by("s").detect(m, lambda w: m.build(a=w[0]["v"], b=w[0]["v"] * 10, c=F.lit(True)))
    got = s.on(("b", lambda x: x), ("a", lambda x: -x)).orderBy(RANK, "step").collect()
    assert [(r[RANK], r.name, r.out) for r in got] == [(0, "b", 10), (0, "a", -1), (1, "b", 20), (1, "a", -2)]
    with pytest.raises(ValueError):
        s.on(("a", lambda x: x), ("a", lambda x: x))


def test_munion_algebra(spark):
    inner = Munion({"p": "int", "q": None})
    m = Munion({"x": "int", "n": inner})
    df = spark.range(1)
    a = m.build(x=F.lit(1), n=inner.build(p=F.lit(2)))
    b = m.build(n=inner.build(p=F.lit(9), q=True))

    def show(c):
        df2 = df.select(c.alias("c"))
        return tuple(df2.select(*[m.has(F.col("c"), p) for p in ("x", "n.p", "n.q", "n")], m.read(F.col("c"), "x"), m.read(F.col("c"), "n.p")).first())

    assert show(m.empty()) == (False, False, False, False, None, None)
    assert show(m.union(a, b)) == (True, True, True, True, 1, 9)
    assert show(m.union(b, a)) == (True, True, True, True, 1, 2)
    assert show(m.difference(a, b))[:4] == (True, False, False, False)
    assert show(m.remove(a, "n"))[:4] == (True, False, False, False)
    assert show(m.remove(a, "x"))[0] is False
    assert show(m.write(m.empty(), "n.p", F.lit(4))) == (False, True, False, True, None, 4)
    # a written member with a null value is present
    assert show(m.write(m.empty(), "x", F.lit(None)))[0] is True
    left = m.union(m.union(a, b), m.empty())
    assert show(left) == show(m.union(a, m.union(b, m.empty())))
    with pytest.raises(KeyError):
        m.has(a, "zz")
    with pytest.raises(TypeError):
        m.build(x=True)


def test_take_until(spark):
    df = spark.createDataFrame([(i, i) for i in range(10)], "s bigint, v bigint")
    assert take_until(df, F.col("v") % 4 == 3, "s").count() == 4
    assert take_until(df, F.col("v") > 99, "s").count() == 10
