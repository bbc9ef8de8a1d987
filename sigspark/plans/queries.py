"""One query per engine operator over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import field, formatted, key_join, key_parts, octets, quotient
from ..functions.views import Range, View
from ..operators import aggregate as A
from ..operators.boundary import prefix_flags, run_flags
from ..operators.ordering import RANK, ahead, back, neighbours, ranked, take_until
from ..operators.pmap import MapSpec, PMap, all_of, any_of
from ..operators.rangejoin import range_join
from ..sources.records import generated
from .munion import Munion
from .stream import Stream

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import more_queries, source_queries  # noqa: F401  add their own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    df = _table(spark, d, "events")
    return df.select(*columns) if columns else df


USERS = MapSpec((("user_id", 0, 1_000_000_000),), ("n",), {"n": 0}, split=(10_000, 1_000))


def _counts(spark: SparkSession, d: str, event_type: str | None = None, low: int = 0, high: int | None = None) -> PMap:
    """Map of events per user."""
    e = _events(spark, d, "event_id", "user_id", "event_type").where(F.col("event_id") >= low)
    e = e.where(F.col("event_id") < high) if high is not None else e
    e = e.where(F.col("event_type") == event_type) if event_type else e
    rows = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return PMap.empty(spark, USERS, {"n": "bigint"}).put(rows, checked=False)


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))


@query("""select user_id, count(*)::BIGINT as n from events where event_type = 'purchase' group by user_id""")
def slice_count_to_map(spark, d):
    """The flagship program: filter, sort by key, begin / end of a key, count between them, put into a map, scan it."""
    m = Munion({"begin": "bigint", "call": None, "end": "bigint"})

    def detect(w):
        here = w[1]["user_id"]
        new = ~w[0]["user_id"].eqNullSafe(here)
        last = ~w[2]["user_id"].eqNullSafe(here)
        return m.build(begin=F.when(new, here), call=F.lit(True), end=F.when(last, here))

    s = Stream(_events(spark, d, "event_id", "user_id", "event_type"), "event_id").filtered(F.col("event_type") == "purchase").sorted_by("user_id").detect(m, detect, 3, 1)
    e = s.events().select("user_id", "event")
    rows = e.groupBy("user_id").agg(F.count_if(m.has(F.col("event"), "call")).alias("n"), F.count_if(m.has(F.col("event"), "end")).alias("ends")).where("ends = 1").drop("ends")
    return PMap.empty(spark, USERS, {"n": "bigint"}).put(rows, checked=False).scan()


@query("select count(*)::BIGINT as n from events where event_type = 'purchase'")
def flt02_count(spark, d):
    return Stream(_events(spark, d, "event_id", "event_type"), "event_id").filtered(F.col("event_type") == "purchase").records().agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, user_id from events where value > 100 and event_type = 'click'")
def flt01_function(spark, d):
    return Stream(_events(spark, d, "event_id", "user_id", "value", "event_type"), "event_id").filtered(lambda df: df["value"] > 100).filtered(lambda df: df["event_type"] == "click").records().select("event_id", "user_id")


@query("select user_id, count(*)::BIGINT as n from events where user_id % 7 = 3 group by user_id")
def flt03_map_keys(spark, d):
    return Stream(_counts(spark, d).scan(), "user_id").filtered(F.col("user_id") % 7 == 3).records()


@query("""select event_id, user_id from events where user_id in (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def flt04_semi_filter(spark, d):
    members = _table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return _events(spark, d, "event_id", "user_id").join(members, "user_id", "left_semi").select("event_id", "user_id")


@query("select event_id, event_type from events where event_id <= (select min(event_id) from events where value > 200 and event_type = 'purchase')")
def flt06_take_until(spark, d):
    return take_until(_events(spark, d, "event_id", "event_type", "value"), (F.col("value") > 200) & (F.col("event_type") == "purchase"), "event_id").select("event_id", "event_type")


@query("""select event_id, user_id, round(value * 100)::BIGINT as cents, (extract(hour from ts))::INTEGER as hour from events where value >= 1""")
def prj01_translate(spark, d):
    return _events(spark, d, "event_id", "user_id", "value", "ts").where("value >= 1").select("event_id", "user_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.hour("ts").alias("hour"))


@query("select user_id, user_id // 10 as area, user_id % 10 as line, user_id as back from (select distinct user_id from events)")
def prj02_view(spark, d):
    v = View(lambda c: F.struct(quotient(c, 10).alias("area"), (c % 10).alias("line")), lambda c: c["area"] * 10 + c["line"])
    e = _events(spark, d, "user_id").distinct().withColumn("v", v.to_physical(F.col("user_id")))
    return e.select("user_id", "v.area", "v.line", v.to_logical(F.col("v")).alias("back"))


@query("select area * 10 + line as user_id, area, line, coalesce(n, 0)::BIGINT as n from (select user_id, user_id // 10 as area, user_id % 10 as line from (select distinct user_id from events)) left join (select user_id as u, count(*) as n from events where event_type = 'error' group by 1) on u = user_id")
def prj03_view_index(spark, d):
    keys = _events(spark, d, "user_id").distinct().select(quotient(F.col("user_id"), 10).alias("area"), (F.col("user_id") % 10).alias("line"))
    rows = keys.withColumn("user_id", key_join([F.col("area"), F.col("line")], 10))
    return _counts(spark, d, "error").get(rows, errors="null").select("user_id", "area", "line", "n")


@query("""select c_custkey as user_id, coalesce(n, 0)::BIGINT as n from customer left join (select user_id, count(*) as n from events where event_type = 'signup' group by 1) on user_id = c_custkey""")
def map02_get_default(spark, d):
    return _counts(spark, d, "signup").get(_customers(spark, d), errors="null")


@query("""select coalesce(a.user_id, b.user_id) as user_id, (coalesce(a.n, 0) + coalesce(b.n, 0))::BIGINT as n from (select user_id, count(*) as n from events where event_id < 600 group by 1) a full join (select user_id, count(*) as n from events where event_id >= 600 group by 1) b on a.user_id = b.user_id""")
def map03_upsert(spark, d):
    today = _counts(spark, d, low=600).table
    return _counts(spark, d, high=600).fold(today, lambda old, new: old + new, checked=False).scan()


@query("""select c_custkey as user_id, exists (select 1 from events where user_id = c_custkey and event_type = 'signup' and value > 150) as present from customer""")
def map04_member(spark, d):
    e = _events(spark, d, "user_id", "event_type", "value").where("event_type = 'signup' and value > 150").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return PMap.empty(spark, USERS, {"n": "bigint"}).put(e, checked=False).member(_customers(spark, d))


@query("select c_custkey as user_id, c_custkey between 20 and 119 as in_domain from customer")
def map05_domain(spark, d):
    return PMap.empty(spark, MapSpec((("user_id", 20, 119),), ("n",)), {"n": "bigint"}).test(_customers(spark, d))


@query("""select user_id, count(*)::BIGINT as n from events where user_id not in (select c_custkey from customer where c_mktsegment = 'MACHINERY') group by user_id""")
def map06_remove(spark, d):
    gone = _table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id"))
    return _counts(spark, d).remove(gone).scan()


@query("""select c_custkey as user_id, coalesce(n, c_custkey * 2 + 5)::BIGINT as n from customer left join (select user_id, count(*) as n from events where event_type = 'click' and value > 120 group by 1) on user_id = c_custkey""")
def map09_param_default(spark, d):
    spec = MapSpec((("user_id", 0, 1_000_000_000),), ("n",), lambda k, a, b: {"n": k * a + b}, params=(2, 5))
    rows = _events(spark, d, "user_id", "event_type", "value").where("event_type = 'click' and value > 120").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return PMap.empty(spark, spec, {"n": "bigint"}).put(rows, checked=False).get(_customers(spark, d), errors="null")


@query("""select user_id, case when user_id % 3 = 0 then -1 else n end::BIGINT as n, n::BIGINT as snapshot from (select user_id, count(*) as n from events group by 1)""")
def map11_copy_on_write(spark, d):
    m = _counts(spark, d)
    snapshot = m.copy_to(PMap.empty(spark, USERS, {"n": "bigint"}))
    changed = m.put(m.table.where("user_id % 3 = 0").withColumn("n", F.lit(-1).cast("bigint")), checked=False)
    return changed.table.join(snapshot.table.withColumnRenamed("n", "snapshot"), "user_id")


@query("select user_id, (count(*) // 4 * 4)::BIGINT as n from events group by user_id")
def map13_lossy_codec(spark, d):
    spec = MapSpec(USERS.keys, ("n",), {"n": 0}, encode=lambda v: {"n": quotient(v["n"], 4)}, decode=lambda v: {"n": v["n"] * 4})
    rows = _events(spark, d, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return PMap.empty(spark, spec, {"n": "bigint"}).put(rows, checked=False).scan()


@query("""select user_id // 10 as area, user_id % 10 as line, count(*)::BIGINT as n from events where user_id // 10 between 3 and 6 and user_id % 10 between 2 and 8 group by all""")
def map14_struct_key(spark, d):
    spec = MapSpec((("area", 0, 99_999), ("line", 0, 9)), ("n",))
    e = _events(spark, d, "user_id").select(quotient(F.col("user_id"), 10).alias("area"), (F.col("user_id") % 10).alias("line"))
    rows = e.groupBy("area", "line").agg(F.count(F.lit(1)).alias("n"))
    return PMap.empty(spark, spec, {"n": "bigint"}).put(rows, checked=False).scan((3, 2), (6, 8))


@query("select o_orderkey as user_id, o_orderkey // 100 as block, o_orderkey % 100 // 7 as stripe, o_orderkey % 100 % 7 as entry from orders")
def map15_split(spark, d):
    block, stripe, entry = MapSpec((("user_id", 0, 10**9),), ("n",), split=(100, 7)).split_columns()
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("user_id")).select("user_id", block.alias("block"), stripe.alias("stripe"), entry.alias("entry"))


@query("select user_id, count(*)::BIGINT as n, (row_number() over (order by user_id) - 1)::BIGINT as place from events group by user_id")
def src07_map_scan(spark, d):
    return ranked(_counts(spark, d).scan(), ["user_id"], "user_id").withColumnRenamed(RANK, "place")


@query("select user_id, count(*)::BIGINT as n from events where user_id between 17 and 93 group by user_id")
def src08_map_range(spark, d):
    return _counts(spark, d).scan(17, 93)


@query("select (range * 2)::BIGINT as i, (range * 4)::BIGINT as v from range(5000)")
def src03_generate(spark, d):
    return generated(spark, 10_000, lambda i: {"i": i, "v": i * 2}, lambda i: i % 2 == 0).select("i", "v")


@query("""select event_id, user_id, n::BIGINT as n from (select event_id, user_id, event_type from events where event_type = 'error') left join (select user_id as u, count(*) as n from events group by 1) on u = user_id""")
def jon01_lookup(spark, d):
    rows = _events(spark, d, "event_id", "user_id", "event_type").where("event_type = 'error'").select("event_id", "user_id")
    return _counts(spark, d).get(rows, errors="null").select("event_id", "user_id", "n")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal < 2000) or l_partkey in (select p_partkey from part where p_size < 5)""")
def jon02_semi_or(spark, d):
    li = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    s = _table(spark, d, "supplier").where("s_acctbal < 2000").select(F.col("s_suppkey").alias("l_suppkey")).distinct().withColumn("_a", F.lit(True))
    p = _table(spark, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("l_partkey")).distinct().withColumn("_b", F.lit(True))
    return li.join(s, "l_suppkey", "left").join(p, "l_partkey", "left").where("_a or _b").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""select c_custkey as user_id from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)""")
def jon03_anti(spark, d):
    big = _table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("user_id"))
    return _customers(spark, d).join(big, "user_id", "left_anti")


@query("""select n_nationkey, user_id, n::BIGINT as n from nation join (select user_id, count(*) as n from events group by 1) on user_id between n_nationkey * 10 and n_nationkey * 10 + 4""")
def jon07_range(spark, d):
    ranges = _table(spark, d, "nation").select(F.col("n_nationkey").cast("int"), (F.col("n_nationkey") * 10).cast("bigint").alias("lo"), (F.col("n_nationkey") * 10 + 4).cast("bigint").alias("hi"))
    return range_join(ranges, "lo", "hi", _counts(spark, d).table, "user_id").select("n_nationkey", "user_id", "n")


@query("select count(*)::BIGINT as n, count(*) filter (where event_type = 'click')::BIGINT as clicks from events")
def agg01_global(spark, d):
    return _events(spark, d, "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"))


@query("select user_id, count(*)::BIGINT as n, round(sum(value), 4) as total from events group by user_id")
def agg02_group(spark, d):
    return A.per_key(_events(spark, d, "user_id", "value"), ["user_id"], n=F.count(F.lit(1)), total=F.round(F.sum("value"), 4))


@query("""select n_regionkey, c_nationkey, c_custkey, count(*)::BIGINT as n, (3 - grouping(n_regionkey) - grouping(c_nationkey) - grouping(c_custkey))::INTEGER as level from customer join nation on n_nationkey = c_nationkey join orders on o_custkey = c_custkey group by rollup (n_regionkey, c_nationkey, c_custkey)""")
def agg03_hierarchy(spark, d):
    c = _table(spark, d, "customer").select("c_custkey", "c_nationkey").join(_table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    o = _table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return A.hierarchy(o.join(c, "c_custkey"), ["n_regionkey", "c_nationkey", "c_custkey"], n=F.count(F.lit(1)))


@query("""select coalesce(a.user_id, b.user_id) as user_id, round(0.15 * coalesce(b.v, 0) + 0.85 * coalesce(a.v, 0), 6) as v from (select user_id, sum(value) as v from events where event_id < 500 group by 1) a full join (select user_id, sum(value) as v from events where event_id >= 500 and event_type = 'view' group by 1) b on a.user_id = b.user_id""")
def agg05_blend(spark, d):
    e = _events(spark, d, "event_id", "user_id", "value", "event_type")
    a = e.where("event_id < 500").groupBy("user_id").agg(F.sum("value").alias("old"))
    b = e.where("event_id >= 500 and event_type = 'view'").groupBy("user_id").agg(F.sum("value").alias("new"))
    return a.join(b, "user_id", "full").select("user_id", F.round(A.blend(F.col("old"), F.col("new"), 0.15), 6).alias("v"))


@query("select user_id, round(sum(value) * 0.85, 6) as v from events group by user_id")
def agg05_age(spark, d):
    return _events(spark, d, "user_id", "value").groupBy("user_id").agg(F.round(A.age(F.sum("value"), 0.15), 6).alias("v"))


@query("""with c as (select user_id, event_type, count(*) as n from events group by all), r as (select *, least(row_number() over (partition by user_id order by n desc, event_type), 3) as rank from c)
select user_id, rank::INTEGER as rank, case when rank <= 2 then max(event_type) end as event_type, sum(n)::BIGINT as count from r group by user_id, rank""")
def agg06_top_n(spark, d):
    return A.top_n(_events(spark, d, "user_id", "event_type"), ["user_id"], "event_type", 2)


@query()
def agg06_top_n_lossy(spark, d):
    return A.top_n_lossy(_events(spark, d, "event_id", "user_id", "event_type"), ["user_id"], "event_type", "event_id", 3)


@query("select user_id, least(count(*), 39)::TINYINT as n from events group by user_id")
def agg07_capped(spark, d):
    return _events(spark, d, "user_id").groupBy("user_id").agg(A.capped(F.count(F.lit(1)), 39).alias("n"))


@query("select user_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def agg09_last(spark, d):
    return A.last_per_key(_events(spark, d, "event_id", "user_id", "event_type"), ["user_id"], "event_type", ["event_id"])


_LINE = "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem"


def _window(spark, d, before: int, after: int) -> DataFrame:
    # Line numbers may repeat in an order, so part and supplier make the order total.
    rows = ranked(_table(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id")
    cols = {f"b{i}": back("event_id", i) for i in range(1, before + 1)} | {f"a{i}": ahead("event_id", i) for i in range(1, after + 1)}
    return neighbours(rows, cols, before, after).select("event_id", *cols)


@query("select event_id, lag(event_id) over w as b1, lead(event_id) over w as a1 from events window w as (order by user_id, event_id)")
def win01_w3_1(spark, d):
    return _window(spark, d, 1, 1)


@query("select event_id, lag(event_id, 1) over w as b1, lag(event_id, 2) over w as b2, lead(event_id, 1) over w as a1, lead(event_id, 2) over w as a2 from events window w as (order by user_id, event_id)")
def win02_w5_2(spark, d):
    return _window(spark, d, 2, 2)


@query("select event_id, lead(event_id, 1) over w as a1, lead(event_id, 2) over w as a2, lead(event_id, 3) over w as a3 from events window w as (order by user_id, event_id)")
def win03_w4_0(spark, d):
    return _window(spark, d, 0, 3)


@query("""select event_id, round(value - lag(value) over (order by event_id), 6) as change from events""")
def jon08_previous(spark, d):
    rows = ranked(_events(spark, d, "event_id", "value"), [], "event_id")
    return neighbours(rows, {"change": F.round(F.col("value") - back("value"), 6)}, 1, 0).select("event_id", "change")


@query("""select event_id, row_number() over (partition by user_id order by event_id) = 1 as begin_0, lead(1) over (partition by user_id order by event_id) is null as end_0 from events""")
def evt06_begin_end(spark, d):
    return prefix_flags(_events(spark, d, "event_id", "user_id"), ["user_id"], "event_id").select("event_id", "begin_0", "end_0")


_HIER = """select o_orderkey, n_regionkey, c_nationkey, c_custkey from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey"""


@query(f"""select o_orderkey, row_number() over (partition by n_regionkey order by c_nationkey, c_custkey, o_orderkey) = 1 as begin_0, row_number() over (partition by n_regionkey, c_nationkey order by c_custkey, o_orderkey) = 1 as begin_1, row_number() over (partition by n_regionkey, c_nationkey, c_custkey order by o_orderkey) = 1 as begin_2,
lead(1) over (partition by n_regionkey order by c_nationkey, c_custkey, o_orderkey) is null as end_0, lead(1) over (partition by n_regionkey, c_nationkey order by c_custkey, o_orderkey) is null as end_1, lead(1) over (partition by n_regionkey, c_nationkey, c_custkey order by o_orderkey) is null as end_2 from ({_HIER})""")
def evt06_hierarchy(spark, d):
    n = _table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = _table(spark, d, "customer").select(F.col("c_custkey"), "c_nationkey").join(n, "c_nationkey")
    o = _table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(c, "c_custkey")
    flags = prefix_flags(o, ["n_regionkey", "c_nationkey", "c_custkey"], "o_orderkey")
    return flags.select("o_orderkey", *[f"{k}_{i}" for i in range(3) for k in ("begin", "end")])


@query("""select event_id, coalesce(lag(user_id) over w <> user_id, true) as begin_0, coalesce(lead(user_id) over w <> user_id, true) as end_0, coalesce(lag(event_type) over w <> event_type, true) as begin_1, coalesce(lead(event_type) over w <> event_type, true) as end_1 from events window w as (order by user_id, event_id)""")
def evt07_runs(spark, d):
    return run_flags(_events(spark, d, "event_id", "user_id", "event_type"), ["user_id"], "event_id", [["user_id"], ["event_type"]]).select("event_id", "begin_0", "end_0", "begin_1", "end_1")


@query("select event_id, user_id from events where event_type = 'view'")
def evt03_default_event(spark, d):
    s = Stream(_events(spark, d, "event_id", "user_id", "event_type"), "event_id").filtered(F.col("event_type") == "view").sorted_by("user_id")
    return s.on(("record", lambda r: F.struct(r["event_id"].alias("event_id"), r["user_id"].alias("user_id")))).select("out.event_id", "out.user_id")


@query("""with r as (select event_id, (row_number() over (order by user_id, event_id) - 1)::BIGINT as place, user_id, value, lag(user_id) over (order by user_id, event_id) as p from events)
select place, 0 as step, 'start' as name, user_id as out from r where p is distinct from user_id union all select place, 1, 'large', (value * 100)::BIGINT from r where value > 120""")
def evt04_dispatch(spark, d):
    m = Munion({"large": "bigint", "start": "bigint", "ignored": None})
    s = Stream(_events(spark, d, "event_id", "user_id", "value"), "event_id").sorted_by("user_id").detect(
        m, lambda w: m.build(start=F.when(~w[0]["user_id"].eqNullSafe(w[1]["user_id"]), w[1]["user_id"]), large=F.when(w[1]["value"] > 120, F.round(w[1]["value"] * 100)), ignored=F.lit(True)), 2, 1
    )
    return s.on(("start", lambda x: x), ("large", lambda x: x)).withColumnRenamed(RANK, "place")


@query("""select event_id, 'o.call' as name, user_id as out from events where event_type = 'click' union all select event_id, 't.call', user_id from events where value > 50""")
def evt05_nested_events(spark, d):
    side = Munion({"call": "bigint"})
    m = Munion({"o": side, "t": side})
    detect = lambda w: m.build(o=side.build(call=F.when(w[0]["event_type"] == "click", w[0]["user_id"])), t=side.build(call=F.when(w[0]["value"] > 50, w[0]["user_id"])))
    s = Stream(_events(spark, d, "event_id", "user_id", "event_type", "value"), "event_id").sorted_by("event_id").detect(m, detect)
    return s.on(("o.call", lambda x: x), ("t.call", lambda x: x), keep=("event_id",)).select("event_id", "name", "out")


_PAIR = Munion({"x": "bigint", "y": "double"})


def _munions(spark, d):
    a = _PAIR.build(x=F.when(F.col("event_id") % 2 == 0, F.col("event_id")), y=F.when(F.col("event_id") % 3 == 0, F.col("value")))
    b = _PAIR.build(x=F.when(F.col("event_id") % 5 == 0, -F.col("event_id")), y=F.when(F.col("event_id") % 2 == 1, -F.col("value")))
    return _events(spark, d, "event_id", "value").select("event_id", a.alias("a"), b.alias("b"))


def _flat(df: DataFrame, c) -> DataFrame:
    return df.select("event_id", c.alias("c")).select("event_id", _PAIR.read(F.col("c"), "x").alias("x"), _PAIR.read(F.col("c"), "y").alias("y"))


_MU = """(select event_id, case when event_id % 2 = 0 then event_id end as ax, case when event_id % 3 = 0 then value end as ay, case when event_id % 5 = 0 then -event_id end as bx, case when event_id % 2 = 1 then -value end as by_ from events)"""


@query(f"select event_id, coalesce(bx, ax) as x, coalesce(by_, ay) as y from {_MU}")
def mun03_union(spark, d):
    return _flat(_munions(spark, d), _PAIR.union(F.col("a"), F.col("b")))


@query(f"select event_id, case when bx is null then ax end as x, case when by_ is null then ay end as y from {_MU}")
def mun04_difference(spark, d):
    return _flat(_munions(spark, d), _PAIR.difference(F.col("a"), F.col("b")))


@query(f"select event_id, null::BIGINT as x, ay as y from {_MU}")
def mun05_remove(spark, d):
    return _flat(_munions(spark, d), _PAIR.remove(F.col("a"), "x"))


@query(f"select event_id, ax is not null as has_x, ay is not null as has_y from {_MU}")
def mun06_member(spark, d):
    return _munions(spark, d).select("event_id", _PAIR.has(F.col("a"), "x").alias("has_x"), _PAIR.has(F.col("a"), "y").alias("has_y"))


@query(f"select event_id, ax as x, 7.0::DOUBLE as y from {_MU}")
def mun08_write(spark, d):
    return _flat(_munions(spark, d), _PAIR.write(F.col("a"), "y", F.lit(7.0)))


@query("select event_id, (row_number() over (order by event_type, user_id, event_id) - 1)::BIGINT as place from events")
def srt01_multi(spark, d):
    return Stream(_events(spark, d, "event_id", "event_type", "user_id"), "event_id").sorted_by("event_type", "user_id").ordered().select("event_id", F.col(RANK).alias("place"))


@query("select event_id, (row_number() over (order by user_id, event_type, value, event_id) - 1)::BIGINT as place from events")
def srt02_whole(spark, d):
    return Stream(_events(spark, d, "user_id", "event_type", "value", "event_id"), "event_id").sorted().ordered().select("event_id", F.col(RANK).alias("place"))


@query("select event_id, (row_number() over (order by user_id % 10, user_id // 10, event_id) - 1)::BIGINT as place from events")
def srt03_struct(spark, d):
    e = _events(spark, d, "event_id", "user_id").select("event_id", F.struct((F.col("user_id") % 10).alias("a"), quotient(F.col("user_id"), 10).alias("b")).alias("k"))
    return Stream(e, "event_id").sorted_by("k").ordered().select("event_id", F.col(RANK).alias("place"))


@query("select event_id, (row_number() over (order by event_type, event_id) - 1)::BIGINT as place from events")
def srt04_stable(spark, d):
    return Stream(_events(spark, d, "event_id", "event_type"), "event_id").sorted_by("event_type").ordered().select("event_id", F.col(RANK).alias("place"))


def _three(spark, d) -> list[PMap]:
    e = _events(spark, d, "user_id", "event_type", "value").where("value > 90")
    out = []
    for t in ("click", "view", "purchase"):
        rows = e.where(F.col("event_type") == t).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        out.append(PMap.empty(spark, USERS, {"n": "bigint"}).put(rows, checked=False))
    return out


_K = "select user_id from events where value > 90 and event_type = '{}'"
_A, _B, _C = (_K.format(t) for t in ("click", "view", "purchase"))


@query(f"{_A} union {_B}")
def set01_or2(spark, d):
    return any_of(*_three(spark, d)[:2])


@query(f"select user_id from ({_A} union {_B} union {_C}) where user_id between 10 and 90")
def set01_or3_range(spark, d):
    return any_of(*_three(spark, d), low=10, high=90)


@query(f"{_A} intersect {_B}")
def set02_and2(spark, d):
    return all_of(*_three(spark, d)[:2])


@query(f"{_A} intersect {_B} intersect {_C}")
def set02_and3(spark, d):
    return all_of(*_three(spark, d))


@query("select o_orderkey, o_orderkey // 100 as area, o_orderkey % 100 // 10 as exchange, o_orderkey % 10 as line, -(o_orderkey // 7) as quot, -(o_orderkey % 7) as rem from orders")
def scl02_key_parts(spark, d):
    k = F.col("o_orderkey")
    area, exchange, line = key_parts(k, 10, 10)
    return _table(spark, d, "orders").select(k, area.alias("area"), exchange.alias("exchange"), line.alias("line"), quotient(-k, 7).alias("quot"), (-k % 7).alias("rem"))


@query("""select event_id, (user_id % 256 + 256 * (event_id % 256) + 65536 * 3 + 16777216 * 4)::BIGINT as packed from events""")
def scl03_octets(spark, d):
    e = _events(spark, d, "event_id", "user_id")
    text = F.concat_ws(".", (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 256).cast("string"), F.lit("3"), F.lit("4"))
    return e.select("event_id", octets(text).alias("packed"))


@query("""select event_id, json_extract_string(props, '$.k')::BIGINT as k from events""")
def scl04_parse(spark, d):
    line = F.concat_ws("|", F.col("event_id").cast("string"), F.get_json_object("props", "$.k"), F.lit("x"))
    e = _events(spark, d, "event_id", "props").select(line.alias("line"))
    return e.select(field(F.col("line"), 0, "bigint").alias("event_id"), field(F.col("line"), 1, "bigint").alias("k")).dropna()


@query("""select event_id, printf('%05d %s', user_id, event_type) as line from events""")
def scl07_format(spark, d):
    return _events(spark, d, "event_id", "user_id", "event_type").select("event_id", formatted("%05ld %s", F.col("user_id"), F.col("event_type")).alias("line"))


@query("select c_custkey from customer where c_custkey between 5 and 77")
def rng01_range(spark, d):
    r = Range(5, 77)
    return _table(spark, d, "customer").select("c_custkey").where(r.holds(F.col("c_custkey"))).select(r.checked(F.col("c_custkey"), "key").alias("c_custkey"))


@query("""select user_id, event_id // 1000 as block, string_agg(event_id::VARCHAR, ',' order by event_id) as ids from events group by all""")
def vew02_array_view(spark, d):
    """Arrays hold a user's events of a block of ids, so that a user with very many has many arrays."""
    v = View(lambda c: c + 1, lambda c: c - 1).array()
    e = _events(spark, d, "event_id", "user_id").groupBy("user_id", quotient(F.col("event_id"), 1000).alias("block")).agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return e.select("user_id", "block", F.array_join(v.to_logical(v.to_physical(F.col("ids"))), ",").alias("ids"))


@query("""select hash_id, event_type from (select distinct event_type, dense_rank() over (order by event_type)::BIGINT as hash_id from events)""")
def pkl03_dictionary(spark, d):
    e = _events(spark, d, "event_type").distinct()
    return ranked(e, ["event_type"], "event_type").select((F.col(RANK) + 1).alias("hash_id"), "event_type")


@query("""select coalesce(y.user_id, t.user_id) as user_id, round(0.2 * coalesce(t.v, 0) + 0.8 * coalesce(y.v, 0), 6) as v, (coalesce(y.n, 0) + coalesce(t.n, 0))::BIGINT as n
from (select user_id, sum(value) as v, count(*) as n from events where ts < timestamp '2024-01-15' group by 1) y full join (select user_id, sum(value) as v, count(*) as n from events where ts >= timestamp '2024-01-15' and ts < timestamp '2024-01-16' group by 1) t on y.user_id = t.user_id""")
def stm01_daily_update(spark, d):
    e = _events(spark, d, "user_id", "value", "ts")
    day = lambda cond: e.where(cond).groupBy("user_id").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    spec = MapSpec(USERS.keys, ("v", "n"), {"v": 0.0, "n": 0})
    yesterday = PMap.empty(spark, spec, {"v": "double", "n": "bigint"}).put(day("ts < timestamp '2024-01-15'"), checked=False)
    aged = PMap(spec, yesterday.copy_to(PMap.empty(spark, spec, {"v": "double", "n": "bigint"})).table.withColumn("v", A.age(F.col("v"), 0.2)))
    today = day("ts >= timestamp '2024-01-15' and ts < timestamp '2024-01-16'").withColumn("v", F.col("v") * 0.2)
    return aged.fold(today, lambda old, new: old + new, checked=False).scan().withColumn("v", F.round("v", 6))
