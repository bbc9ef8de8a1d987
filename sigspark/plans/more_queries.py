"""More queries: binary and packed sources, stores, handlers with state, parameters."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import char_literal
from ..operators.ordering import RANK
from ..operators.pmap import MapSpec, PMap
from ..sources.bytestreams import coded, decoded, delta, dos, filtered, from_delta, from_run_length, inflated, mapped, pieces, run_length
from ..sources.records import SEQ, binary_source, files_of
from ..sources.store import Catalog
from .munion import Munion
from .program import Param, bind
from .queries import USERS, _counts, _events, query
from .source_queries import _place
from .stream import Stream


def _write_binary(rows: DataFrame, path: str, layout: list[str], names: list[str]) -> None:
    """One file of fixed-width records for each partition."""
    kind = np.dtype([(n, f"<{c}") for n, c in zip(names, layout)])

    def write(batches):
        from pyarrow.fs import FileSystem

        fs, at = FileSystem.from_uri(path)
        fs.create_dir(at)
        n = 0
        with fs.open_output_stream(f"{at}/part-{TaskContext.get().partitionId():05d}") as f:
            for b in batches:
                out = np.empty(b.num_rows, kind)
                for i, name in enumerate(names):
                    out[name] = b.column(i).to_numpy(zero_copy_only=False)
                f.write(out.tobytes())
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows.select(*names).mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


@query("select event_id, user_id::INTEGER as user_id, value, count(*) over () as places from events")
def src01_binary(spark, d):
    """Fixed-width records of several files, read by ranges; arrival numbers have no gaps."""
    path = _place(spark, "binary")
    e = _events(spark, d, "event_id", "user_id", "value")
    _write_binary(e.repartition(3), path if "://" in path else "file://" + path, ["i8", "i4", "f8"], ["event_id", "user_id", "value"])
    rows = binary_source(spark, path, "<qid", ["event_id", "user_id", "value"], chunk=1000)
    places = rows.agg((F.max(SEQ) + 1).alias("places"), F.count_distinct(SEQ).alias("different")).where("places = different").drop("different")
    return rows.drop(SEQ).join(F.broadcast(places))


@query("select event_id from events")
def src12_disciplines(spark, d):
    """Compressed text with carriage returns, through stacked disciplines."""
    path = _place(spark, "packed")
    _events(spark, d, "event_id").repartition(3).select(F.concat(F.col("event_id").cast("string"), F.lit("\r")).alias("value")).write.option("compression", "gzip").text(path)
    return decoded(spark, files_of(spark, path), inflated, dos, filtered("cat")).select(F.col("value").cast("bigint").alias("event_id"))


@query("select * from (values ('delta', true), ('map', true), ('run length', true)) t(codec, same)")
def scl08_byte_codecs(spark, d):
    """Byte codecs give every event type back."""
    there, back = mapped(bytes(range(255, -1, -1)))
    codecs = {"run length": (run_length, from_run_length), "map": (there, back), "delta": (delta, from_delta)}

    def check(batches):
        for b in batches:
            for rows in pieces(b.column(0)):
                text = pc.binary_repeat(rows.cast(pa.large_binary()), 3)
                same = [pc.all(pc.equal(coded(fro, coded(to, text)), text), min_count=0) for to, fro in codecs.values()]
                yield pa.RecordBatch.from_arrays([pa.array(codecs, pa.string()), pa.array([x.as_py() for x in same], pa.bool_())], ["codec", "same"])

    # as found in no rows at all, so that each codec has its row where the table is empty
    none = spark.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, codecs))).alias("codec"), F.lit(True).alias("same"))
    found = _events(spark, d, "event_type").mapInArrow(check, "codec string, same boolean").union(none)
    return found.groupBy("codec").agg(F.bool_and("same").alias("same"))


def _outcome(act) -> str:
    try:
        act()
        return "ok"
    except (Exception, SystemExit) as e:
        return type(e).__name__


@query("""select * from (values (1, 'FileNotFoundError'), (2, 'ok'), (3, 'FileExistsError'), (4, 'ok'), (5, 'TypeError'), (6, 'TypeError'), (7, 'FileNotFoundError'), (8, 'PermissionError')) t(step, outcome)""")
def src11_open_modes(spark, d):
    """new, exists, either, const; one name, one handle."""
    path, c, kinds = _place(spark, "modes"), Catalog(spark), {"n": "bigint"}
    steps = [
        lambda: c.map(path, USERS, kinds, mode="exists"),
        lambda: c.map(path, USERS, kinds, mode="new"),
        lambda: Catalog(spark).map(path, USERS, kinds, mode="new"),
        lambda: c.map(path) is c.map(path) or 1 / 0,
        lambda: c.pickle(path, json.loads, json.dumps),
        lambda: c.map(path, const=True),
        lambda: Catalog(spark).map(path + "-none", const=True),
        lambda: Catalog(spark).map(path, mode="exists", const=True).save(_counts(spark, d)),
    ]
    return spark.createDataFrame([(i + 1, _outcome(s)) for i, s in enumerate(steps)], "step int, outcome string")


@query("""select * from (values (1, 0, 'ok'), (3, 2, 'ok'), (3, 3, 'ValueError'), (1, -1, 'ValueError'), (0, 0, 'ValueError')) t(size, "offset", outcome)""")
def win04_bounds(spark, d):
    s = Stream(_events(spark, d, "event_id"), "event_id")
    m = Munion({"x": None})
    tries = [(1, 0), (3, 2), (3, 3), (1, -1), (0, 0)]
    return spark.createDataFrame([(n, o, _outcome(lambda n=n, o=o: s.detect(m, lambda w: m.build(), n, o))) for n, o in tries], "size int, offset int, outcome string")


@query("select user_id, (row_number() over (order by user_id) - 1)::BIGINT as place from events")
def srt05_scalars(spark, d):
    """A stream of one number a record, sorted by itself."""
    rows = _events(spark, d, "user_id", "event_id")
    return Stream(rows, "event_id").sorted().ordered().select("user_id", F.col(RANK).alias("place"))


@query("""select event_id, (row_number() over (order by x, case when x = 0 then event_id % 4 else 0 end, event_id) - 1)::BIGINT as place
from (select event_id, case event_id % 4 when 0 then 0 when 1 then 0 when 2 then value + 1 else -value - 1 end as x from events)""")
def srt07_float_order(spark, d):
    """Total order of floats: -0.0 is below 0.0."""
    k = F.col("event_id") % 4
    x = F.when(k == 0, F.lit(-0.0)).when(k == 1, F.lit(0.0)).when(k == 2, F.col("value") + 1).otherwise(-F.col("value") - 1)
    rows = _events(spark, d, "event_id", "value").select("event_id", x.alias("x"))
    return Stream(rows, "event_id").sorted_by("x").ordered().select("event_id", F.col(RANK).alias("place"))


@query("""select event_id, user_id, n, total from (select *, count(*) over w as n, round(sum(value) over w, 4) as total from events
window w as (partition by user_id order by event_id rows between unbounded preceding and current row)) where event_type = 'purchase'""")
def udf04_stateful_handler(spark, d):
    """A handler that gathers over a user's records and emits at purchases."""
    m = Munion({"bought": None})
    s = Stream(_events(spark, d, "event_id", "user_id", "event_type", "value"), "event_id").sorted_by("user_id")
    s = s.detect(m, lambda w: m.build(bought=F.when(w[0]["event_type"] == "purchase", F.lit(True))))
    out = s.accumulate(["user_id"], {"n": F.count(F.lit(1)), "sum": F.sum("value")}, "bought", keep=("event_id",))
    return out.select("event_id", "user_id", "n", F.round("sum", 4).alias("total"))


@query("""select n_nationkey, user_id, n from nation join (select user_id, count(*)::BIGINT as n from events group by 1) on user_id between n_nationkey * 10 and n_nationkey * 10 + 4 where n_nationkey % 2 = 1""")
def evt08_nested_iterate(spark, d):
    """A handler opens an iterate over a range of a map for each of its events."""
    m = Munion({"odd": None})
    rows = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"))
    s = Stream(rows, "n_nationkey").detect(m, lambda w: m.build(odd=F.when(w[0]["n_nationkey"] % 2 == 1, F.lit(True))))
    low = lambda r: r["n_nationkey"] * 10
    return s.iterate(_counts(spark, d), low, lambda r: low(r) + 4, "odd", keep=("n_nationkey",)).select("n_nationkey", "user_id", "n")


@query("""select user_id, least(n, floor(avg(n) over (partition by user_id // 10000, user_id % 10000 // 1000)))::BIGINT as n from (select user_id, count(*)::BIGINT as n from events group by 1 having count(*) >= 60)""")
def map13_stripe_codec(spark, d):
    """A codec that sees a stripe at once and removes entries when they are written."""
    plain = MapSpec(USERS.keys, USERS.values, USERS.default, split=USERS.split)
    level = lambda v: {"n": F.least(v["n"], F.floor(F.avg(v["n"]).over(plain.stripe_window())).cast("bigint"))}
    spec = MapSpec(USERS.keys, USERS.values, USERS.default, split=USERS.split, encode=level, decode=lambda v: dict(v), drop=lambda v: v["n"] < 60)
    rows = _events(spark, d, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return PMap.empty(spark, spec, {"n": "bigint"}).put(rows, checked=False).scan()


@query("select user_id, max(event_id) as n from events group by user_id")
def map03_last_write(spark, d):
    """A key that is put many times keeps the value that arrived last."""
    rows = _events(spark, d, "user_id", "event_id").select("user_id", F.col("event_id").alias("n"), F.col("event_id").alias(SEQ))
    return PMap.empty(spark, USERS, {"n": "bigint"}).put(rows, checked=False).scan()


@query("""select * from (values ('array', '[1, 2, 3]'), ('number', '7'), ('struct', '{"a": 1, "b": [true, null]}'), ('text', '"é"')) t(name, value)""")
def dir04_values(spark, d):
    """Scalars, strings, structs and arrays of a directory, stored and read again."""
    path = _place(spark, "values")
    fields = {"number": 7, "text": "é", "struct": {"a": 1, "b": [True, None]}, "array": [1, 2, 3]}
    Catalog(spark).directory(path, fields, mode="new")
    again = Catalog(spark).directory(path, dict.fromkeys(fields), mode="exists")
    return spark.createDataFrame([(k, json.dumps(again[k], ensure_ascii=False)) for k in fields], "name string, value string")


@query("""select * from (values ('copy', '[1, 2]'), ('source', '[1]')) t(name, value)""")
def pkl02_copy(spark, d):
    """A copied pickle shares nothing with its source."""
    load = lambda text: json.loads(text) if text else []
    c = Catalog(spark)
    one, two = (c.pickle(_place(spark, "pickle"), load, json.dumps) for _ in range(2))
    one.value = [1]
    one.save()
    one.copy_to(two)
    two.value.append(2)
    two.save()
    read = lambda p: json.dumps(Catalog(spark).pickle(p.path, load, json.dumps, mode="exists").value)
    return spark.createDataFrame([("source", read(one)), ("copy", read(two))], "name string, value string")


@query(r"""select * from (values ('A', 65), ('\n', 10), ('\x41', 65), ('\101', 65)) t(literal, code)""")
def scl06_character_literals(spark, d):
    return spark.createDataFrame([(t, char_literal(t)) for t in ("A", r"\n", r"\x41", r"\101")], "literal string, code int")


@query("""select * from (values (1, 'prog', 5, false, 0.5::DOUBLE, 'ok'), (2, 'prog', 127, true, 0.25, 'ok'), (3, null, null, null, null, 'UsageError'), (4, null, null, null, null, 'UsageError'),
(5, null, null, null, null, 'UsageError'), (6, null, null, null, null, 'UsageError'), (7, null, null, null, null, 'UsageError')) t(run, program, n, quiet, share, outcome)""")
def prg03_switches(spark, d):
    """Conversions with ranges, defaults, repeated and unknown switches, missing arguments, usage."""
    params = [Param("program"), Param("n", "short", "n"), Param("quiet", "flag", "q"), Param("share", "double", "s", 0.5)]
    runs = [["prog", "-n", "5"], ["prog", "-q", "-n127", "-s", "0.25"], ["prog"], ["prog", "-n", "40000"], ["prog", "-n", "1", "-n", "2"], ["prog", "-z"], ["prog", "--"]]
    rows = []
    for i, argv in enumerate(runs):
        outcome = _outcome(lambda argv=argv: bind(params, argv))
        v = bind(params, argv) if outcome == "ok" else {}
        rows.append((i + 1, v.get("program"), v.get("n"), v.get("quiet"), v.get("share"), outcome))
    return spark.createDataFrame(rows, "run int, program string, n int, quiet boolean, share double, outcome string")


@query("select user_id, count(*)::BIGINT as n from events where event_type = 'click' group by user_id")
def prg06_store_parameter(spark, d):
    """A parameter that is a map: its text names the store, its mode says how it is opened."""
    path = _place(spark, "parameter")
    Catalog(spark).map(path, USERS, {"n": "bigint"}, mode="new").save(_counts(spark, d, "click"))
    opened = bind([Param("program"), Param("counts", lambda text, mode: Catalog(spark).map(text, mode=mode), "m", mode="exists")], ["prog", "-m", path])
    return opened["counts"].map.scan()


@query("select event_id, user_id * 2 as out from events where user_id > 5")
def udf09_function_parameters(spark, d):
    """A program whose filter and translation are parameters."""
    choice = {"large": lambda r: r["user_id"] > 5, "twice": lambda r: r["user_id"] * 2}
    pick = lambda text, _: choice[text]
    p = bind([Param("program"), Param("keep", pick, "k"), Param("make", pick, "t")], ["prog", "-k", "large", "-t", "twice"])
    rows = Stream(_events(spark, d, "event_id", "user_id"), "event_id").filtered(p["keep"]).records()
    return rows.select("event_id", p["make"](rows).alias("out"))
