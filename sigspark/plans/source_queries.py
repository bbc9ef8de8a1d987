"""Queries over sources, stores, programs and streams: tables are written in a source's form first, then read by it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import field
from ..operators.pmap import MapSpec, PMap
from ..sources.records import SEQ, concatenated, from_iterable, key_source, text_source
from ..sources.store import Catalog
from ..sources.workspace import cut, scratch
from ..streaming.live import upsert_stream, windowed
from .munion import Munion
from .program import Param, bind
from .queries import USERS, _counts, _events, query
from .stream import Stream

_COUNTS = "select user_id, count(*)::BIGINT as n from events group by user_id"


def _place(spark, name: str) -> str:
    """A new folder in the shared scratch folder; it goes when the JVM ends."""
    path = f"{scratch(spark)}/engine/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def _lines(spark, d: str) -> str:
    """events as text: id|user|type, every tenth line malformed."""
    line = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("bad|"), F.col("event_type"))).otherwise(F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type")))
    path = _place(spark, "text")
    _events(spark, d, "event_id", "user_id", "event_type").select(line.alias("value")).write.text(path)
    return path


def _record(v, separator: str = r"\|"):
    return {"event_id": field(v, 0, "bigint", separator), "user_id": field(v, 1, "bigint", separator), "event_type": field(v, 2, "string", separator)}


@query("select event_id, user_id, event_type from events where event_id % 10 <> 3")
def src02_text(spark, d):
    return text_source(spark, _lines(spark, d), _record).select("event_id", "user_id", "event_type")


@query("select event_id, user_id from events where event_id % 10 <> 3 and user_id >= 5")
def src04_parameterised(spark, d):
    """The stream's parameters go to its translation and its filter."""
    keep = lambda v, separator, least: _record(v, separator)["user_id"] >= least
    return text_source(spark, _lines(spark, d), lambda v, separator, least: _record(v, separator), keep, (r"\|", 5)).select("event_id", "user_id")


@query("select event_type, 1::BIGINT as n, (row_number() over (order by event_type) - 1)::BIGINT as _seq from (select distinct event_type from events)")
def src05_iterable(spark, d):
    """Records that the driver holds: here all event types."""
    kinds = [(r.event_type, 1) for r in _events(spark, d, "event_type").distinct().orderBy("event_type").collect()]
    return from_iterable(spark, kinds, "event_type string, n bigint")


@query("select count(*) - count(*) filter (where event_id % 10 = 3) as kept, count(*) as places from events")
def src06_directory(spark, d):
    """All files of a folder are one stream; arrival numbers go on from file to file without gaps."""
    path = _place(spark, "folder")
    _events(spark, d, "event_id").repartition(5).select(F.when(F.col("event_id") % 10 == 3, F.lit("bad")).otherwise(F.col("event_id").cast("string")).alias("value")).write.text(path)
    every = text_source(spark, path, lambda v: {"event_id": v.try_cast("bigint")}, lambda v: F.lit(True))
    return every.agg(F.count("event_id").alias("kept"), (F.max(SEQ) - F.min(SEQ) + 1).alias("places"), F.count_distinct(SEQ).alias("different")).where("places = different").drop("different")


@query("select key from (select event_id, user_id as key from events union all select event_id, user_id + 1 from events) where key between 10 and 50 and event_id % 4 <> 0")
def src09_key_file(spark, d):
    """Lines of junk, of two keys with blanks, and of keys with other characters between."""
    path = _place(spark, "keys")
    user, text = F.col("user_id").cast("string"), (F.col("user_id") + 1).cast("string")
    line = F.when(F.col("event_id") % 4 == 0, F.lit("junk")).when(F.col("event_id") % 4 == 1, F.concat_ws(" ", user, text, F.lit("99999999999999999999"))).otherwise(F.concat(F.lit("x"), user, F.lit("y"), text, F.lit("-")))
    _events(spark, d, "event_id", "user_id").select(line.alias("value")).write.text(path)
    return key_source(spark, path, 10, 50).select("key")


@query(_COUNTS)
def src10_open_by_name(spark, d):
    """A map is made as new, saved, and opened again by name, which must exist and is const."""
    path = _place(spark, "map")
    Catalog(spark).map(path, USERS, {"n": "bigint"}, mode="new").save(_counts(spark, d))
    return Catalog(spark).map(path, mode="exists", const=True).map.scan()


@query("select user_id, count(*)::BIGINT * 2 as n from events group by user_id")
def snk01_map_versions(spark, d):
    """A map written from itself: a new version, then the pointer."""
    store = Catalog(spark).map(_place(spark, "versions"), USERS, {"n": "bigint"}, mode="new")
    store.save(_counts(spark, d))
    store.save(store.map.fold(store.map.table, lambda old, new: old + new, checked=False))
    return Catalog(spark).map(store.path, mode="exists").map.scan()


@query("select user_id, count(*)::BIGINT as n, 7::BIGINT as run, 'click' as label from events where event_type = 'click' group by user_id")
def snk02_directory(spark, d):
    """A directory of a map, plain values and a pickle, stored, copied and opened again."""
    path, copy = _place(spark, "directory"), _place(spark, "directory")
    fields = {"counts": (USERS, {"n": "bigint"}), "run": 0, "label": (lambda text: json.loads(text) if text else "", json.dumps)}
    c = Catalog(spark)
    one, two = c.directory(path, fields, mode="new"), c.directory(copy, fields, mode="new")
    one["counts"].save(_counts(spark, d, "click"))
    one["run"] = 7
    one["label"].value = "click"
    one.save()
    one.copy_to(two)
    again = Catalog(spark).directory(copy, fields, mode="exists", const=True)
    return again["counts"].map.scan().withColumns({"run": F.lit(again["run"]).cast("bigint"), "label": F.lit(again["label"].value)})


@query("select event_id, (row_number() over (order by event_id >= 700, event_id) - 1)::BIGINT as _seq from events")
def set04_concatenated(spark, d):
    numbered = lambda e, base: e.select("event_id", (F.col("event_id") - base).alias(SEQ))
    e = _events(spark, d, "event_id")
    low = e.agg(F.min("event_id")).first()[0] or 0
    return concatenated(numbered(e.where("event_id < 700"), low), numbered(e.where("event_id >= 700"), max(low, 700))).select("event_id", SEQ)


@query("select event_id, user_id from events where event_type = 'view' and user_id >= 5")
def prg01_parameters(spark, d):
    """A program's switches, typed and with defaults, feed its filter."""
    p = bind([Param("program"), Param("kind", "string", "k"), Param("least", "int", "l", 0), Param("quiet", "flag", "q")], ["views", "-k", "view", "-l", "5"])
    s = Stream(_events(spark, d, "event_id", "user_id", "event_type"), "event_id").filtered((F.col("event_type") == p["kind"]) & (F.col("user_id") >= p["least"]))
    return s.records().select("event_id", "user_id")


@query("select event_id, user_id as out from (select event_id, user_id, lag(user_id) over (order by user_id, event_id) as before from events) where before is distinct from user_id")
def evt01_detector_function(spark, d):
    m = Munion({"start": "bigint"})

    def starts(w):
        return m.build(start=F.when(~w[0]["user_id"].eqNullSafe(w[1]["user_id"]), w[1]["event_id"]))

    s = Stream(_events(spark, d, "event_id", "user_id"), "event_id").sorted_by("user_id").detect(m, starts, 2, 1)
    first = s.on(("start", lambda x: x)).select(F.col("out").alias("event_id"))
    return first.join(_events(spark, d, "event_id", F.col("user_id").alias("out")), "event_id").select("event_id", "out")


@query("select event_id, user_id as out from events where user_id % 2 = 1")
def evt02_detector_expression(spark, d):
    m = Munion({"odd": "struct<event_id:bigint,user_id:bigint>"})
    odd = lambda w: m.build(odd=F.when(w[0]["user_id"] % 2 == 1, F.struct(w[0]["event_id"].alias("event_id"), w[0]["user_id"].alias("user_id"))))
    s = Stream(_events(spark, d, "event_id", "user_id"), "event_id").sorted_by("event_id").detect(m, odd)
    return s.on(("odd", lambda x: x)).select("out.event_id", F.col("out.user_id").alias("out"))


@query("select event_id, event_id as x, event_id % 2 = 0 as marked from events")
def mun01_construct(spark, d):
    """Members with a value, and one that is only there or not."""
    m = Munion({"x": "bigint", "marked": None})
    made = m.build(x=F.col("event_id"), marked=F.col("event_id") % 2 == 0)
    return _events(spark, d, "event_id").select("event_id", made.alias("c")).select("event_id", m.read(F.col("c"), "x").alias("x"), m.has(F.col("c"), "marked").alias("marked"))


@query("select event_id, false as has_x, false as has_marked from events")
def mun02_empty(spark, d):
    m = Munion({"x": "bigint", "marked": None})
    return _events(spark, d, "event_id").select("event_id", m.empty().alias("c")).select("event_id", m.has(F.col("c"), "x").alias("has_x"), m.has(F.col("c"), "marked").alias("has_marked"))


@query("select 0::BIGINT as lo, 1000000000::BIGINT as hi, count(distinct user_id)::BIGINT as inside from events")
def map10_bounds(spark, d):
    ((_, lo, hi),) = USERS.keys
    return _counts(spark, d).scan(lo, hi).agg(F.lit(lo).cast("bigint").alias("lo"), F.lit(hi).cast("bigint").alias("hi"), F.count(F.lit(1)).alias("inside"))


@query("select c_custkey as user_id, coalesce(n, c_custkey % 10)::BIGINT as n from customer left join (select user_id, count(*) as n from events where event_type = 'error' group by 1) on user_id = c_custkey")
def map08_function_default(spark, d):
    spec = MapSpec(USERS.keys, ("n",), lambda k: {"n": k % 10})
    rows = _events(spark, d, "user_id", "event_type").where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    keys = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    return PMap.empty(spark, spec, {"n": "bigint"}).put(rows, checked=False).get(keys, errors="null")


@query(_COUNTS)
def stm02_live_map(spark, d):
    """Structured Streaming folds micro-batches into a stored map; the batch number makes repeats harmless."""
    source = _place(spark, "stream")
    rows = _events(spark, d, "user_id")
    rows.repartition(4).write.parquet(source)
    store = Catalog(spark).map(_place(spark, "live"), USERS, {"n": "bigint"}, mode="new")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    upsert_stream(stream, store, {"n": F.count(F.lit(1))}, lambda old, new: old + new, _place(spark, "checkpoint")).awaitTermination()
    return Catalog(spark).map(store.path, mode="exists").map.scan()


@query("select date_trunc('hour', ts) as hour, event_type, count(*)::BIGINT as n from events group by all")
def stm03_time_windows(spark, d):
    """An extension: event-time windows of a stream, with a watermark that is wider than the rows are out of order."""
    source, out = _place(spark, "stream"), _place(spark, "windows")
    rows = _events(spark, d, "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    w = windowed(stream, "ts", ["event_type"], "1 hour", "3650 days", {"n": F.count(F.lit(1))}).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        """Each batch gives all windows so far, in a folder of its own; the last one is read."""
        batch.write.mode("overwrite").parquet(f"{out}/v{number}")
        last[:] = [f"{out}/v{number}"]

    w.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", _place(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(w.schema).parquet(last[0])


@query("select user_id, event_id from events")
def snk04_output(spark, d) -> DataFrame:
    """Printed output is a returned table; cut() is the written form that others read."""
    return cut(_events(spark, d, "user_id", "event_id"), "output")
