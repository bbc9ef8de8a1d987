"""The ten operators as queries over whole tables, with production parameters; SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(_read(spark, sf_dir, "documents")).drop("n_repeats")


def op2_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), percent=85)


def op3_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import read_back, windows

    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.get(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int")).alias("role"), F.lit(said).alias("text"))
    return read_back(windows(turns.unionByName(extra)))


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import verdicts

    return verdicts(_read(spark, sf_dir, "documents"))


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan

    p = plan(_read(spark, sf_dir, "documents"))
    return p.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_position", "second_position")


def op7_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import decisions

    d = decisions(_read(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), tokenizer_path())


def op9_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import ShardTree, shard_rows

    return shard_rows(_read(spark, sf_dir, "documents"), ShardTree.uniform(2, 3, 4))


def op10_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), tokenizer_path())


_ALL = [op1_suffix_trees, op2_minhash_join, op3_kernel_toxicity, op4_chat_windows, op5_line_frequency, op6_curriculum_mix, op7_bloom_dedup, op8_token_counts, op9_hash_tree, op10_bm25_packing]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_SIZED = r"""select doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT as size from documents"""

OP6_SQL = rf"""
with d as ({_SIZED}),
s0 as (select source, sum(size)::BIGINT as source_size from d group by source),
s1 as (select *, row_number() over (order by source nulls last) - 1 as rnk from s0),
s2 as (select *, case rnk % 3 when 0 then 3.0::DOUBLE when 1 then 1.0::DOUBLE else 2.0::DOUBLE end as w, source_size * 2.0::DOUBLE as cap, max(rnk) over () as top from s1),
s3 as (select *, (sum(source_size) over () * 1.5::DOUBLE - coalesce(sum(cap) over (order by cap / w, rnk rows between unbounded preceding and 1 preceding), 0))
  / (sum(w) over () - coalesce(sum(w) over (order by cap / w, rnk rows between unbounded preceding and 1 preceding), 0)) as level from s2),
s4 as (select *, first_value(case when cap / w > level then level end ignore nulls) over (order by cap / w, rnk rows between unbounded preceding and unbounded following) as water from s3),
g as (select *, least(cap, coalesce(w * water, cap)) as target, case when top > 0 then rnk / top::DOUBLE - 0.5 else 0.0 end as a from s4),
p as (select doc_id, size, d.source, sum(size) over (partition by d.source order by md5(coalesce(doc_id::VARCHAR, 'null ' || coalesce(text, ''))), doc_id, size rows between unbounded preceding and current row) - size as b from d),
j as (select p.*, g.source_size, g.target, g.a, greatest(0, least(size, round(target)::BIGINT - b)) as e0, greatest(0, least(size, round(target)::BIGINT - b - source_size)) as e1 from p join g on p.source is not distinct from g.source),
k as (select *, least(1.0, greatest(0.0, (b + e0 / 2.0::DOUBLE) / target)) as u0, least(1.0, greatest(0.0, (b + source_size + e1 / 2.0::DOUBLE) / target)) as u1 from j)
select doc_id, size, source_size, target, (e0 + e1)::BIGINT as taken,
 case when e0 > 0 then case when abs(a) < 1e-9 then u0 else (sqrt(greatest(0.0, (1 - a) * (1 - a) + 4 * a * u0)) - (1 - a)) / (2 * a) end end::DOUBLE as first_position,
 case when e1 > 0 then case when abs(a) < 1e-9 then u1 else (sqrt(greatest(0.0, (1 - a) * (1 - a) + 4 * a * u1)) - (1 - a)) / (2 * a) end end::DOUBLE as second_position
from k
"""

OP7_SQL = r"""
with n as (select doc_id, length(coalesce(text, '')) as pts, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as sha from documents),
r as (select *, first_value(doc_id) over (partition by sha order by pts desc, doc_id nulls last rows between unbounded preceding and unbounded following) as keep_id, count(*) over (partition by sha) as group_size from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha as text_sha256 from r
"""


OP1_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, i, sha256(array_to_string(list_slice(w, i, i + 12), ' ')) as h from (select doc_id, w, unnest(generate_series(1, len(w) - 12)) as i from d where len(w) >= 13)),
m as (select *, min(doc_id) over (partition by h) as least from g),
c as (select distinct doc_id, i + k as i from m, generate_series(0, 12) as s(k) where least < doc_id),
k as (select d.doc_id, len(w) as n, w, (select count(*) from c where c.doc_id = d.doc_id) as gone from d),
p as (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as i from d),
t as (select p.doc_id, string_agg(p.word, ' ' order by p.i) as kept from p left join c on c.doc_id = p.doc_id and c.i = p.i where c.i is null group by p.doc_id)
select k.doc_id, k.n::BIGINT as n_words, k.gone::BIGINT as n_removed, sha256(coalesce(t.kept, '')) as kept_sha256 from k left join t on t.doc_id = k.doc_id
"""

OP2_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as g from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * common >= 85 * (a.n + b.n - common)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as a, doc_id as b from d union select r.a, e.y from r join e on r.b = e.x)
select d.doc_id, coalesce(n.n, 0)::BIGINT as n_shingles, c.least as component_id, d.doc_id = c.least as kept
from d left join n on n.doc_id = d.doc_id join (select a, min(b) as least from r group by a) c on c.a = d.doc_id
"""


OP5_SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') as gram from (select doc_id, w, unnest(generate_series(1, len(w) - 4)) as i from d where len(w) >= 5)),
c as (select distinct doc_id, i + k as i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g), generate_series(0, 4) as s(k) where n > 1),
r as (select doc_id, count(*) as n from c group by doc_id),
b as (select d.doc_id, source, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') as doc, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, coalesce(r.n, 0) as n_repeat_words,
  string_split(regexp_replace(regexp_replace(lower(t), '[0-9]', '0', 'g'), '[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]', ' ', 'g'), chr(10)) as plain from d left join r on r.doc_id = d.doc_id),
l as (select doc_id, source, doc, trim(x, ' ') as line from (select doc_id, source, doc, unnest(plain) as x from b) where trim(x, ' ') <> ''),
h as (select source, count(distinct doc) as docs from b group by source),
f as (select l.source, line from l join h on h.source is not distinct from l.source group by l.source, line, docs having count(distinct doc) > least(10, greatest(2, 0.1::DOUBLE * docs))),
x as (select doc_id, sum(len(regexp_extract_all(l.line, '[^\x20\x09-\x0D]+'))) as lost from l join f on f.source is not distinct from l.source and f.line = l.line group by doc_id),
v as (select b.*, n_words - coalesce(lost, 0) as kept_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as failed from b left join x on x.doc_id = b.doc_id)
select doc_id, n_words::BIGINT as n_words, word_chars::BIGINT as word_chars, n_symbols::BIGINT as n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT as n_dup_lines, n_repeat_words::BIGINT as n_repeat_words,
 kept_words::BIGINT as kept_words, failed as base_failed, not failed and kept_words >= 0.3::DOUBLE * n_words as kept from v
"""


def _draw(name: str, weight: float) -> str:
    return f"-ln((('0x' || substr(md5({name}), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(16**13)!r}::DOUBLE) / {weight!r}::DOUBLE"


def _least(children: list[tuple[int, str]]) -> str:
    """SQL for the number of the child with the smallest draw."""
    return "list_sort([" + ", ".join(f"{{'d': {draw}, 'i': {i}}}" for i, draw in children) + "])[1].i"


OP9_SQL = rf"""
with recursive t(i, k, c) as (select i, 0, i from range(256) as r(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from t where k < 8),
tab as (select list(c order by i) as t from t where k = 8),
d as (select doc_id, coalesce(doc_id::VARCHAR, chr(0) || 'null') as key, octet_length(encode(coalesce(text, '')))::BIGINT + 8 as size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) as bytes from documents),
z as (select doc_id, key, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) as text_crc32 from d, tab),
r as (select *, {_least([(i, _draw(f"key || '|r{i}'", 12.0)) for i in range(2)])} as r, {_least([(i, _draw(f"key || '|r{i}'", w)) for i, w in enumerate((12.0, 12.0, 1.0))])} as gr from z),
k as (select *, {_least([(i, _draw(f"key || '|k' || r || '.{i}'", 4.0)) for i in range(3)])} as k from r),
p as (select *, case r * 3 + k {" ".join(f"when {rack} then " + _least([(s, _draw(f"key || '|s{s}'", 1.0)) for s in range(4 * rack, 4 * rack + 4)]) for rack in range(6))} end as shard from k)
select doc_id, size, text_crc32, 'key' as law, shard::INTEGER as shard, (row_number() over (partition by shard order by md5(key || '|' || text_crc32), doc_id, size) - 1)::BIGINT as slot,
 (case when gr = 2 then 24 else shard end)::INTEGER as grown_shard from p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_trees": OP1_SQL, "op2_minhash_join": OP2_SQL, "op5_line_frequency": OP5_SQL, "op6_curriculum_mix": OP6_SQL, "op7_bloom_dedup": OP7_SQL, "op9_hash_tree": OP9_SQL}
