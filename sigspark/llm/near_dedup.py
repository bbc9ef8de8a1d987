"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set is its distinct ``SHINGLE``-word shingles (52-bit hashes) in ASCII lower case. Documents with equal
sets are one class; only one of them goes on. A signature has ``COORDINATES`` coordinates, each the hash of ``ROWS``
min-hashes. Linked documents agree in ``matches`` coordinates or more (missed with odds of about 3e-9 at the threshold),
so it is enough to post a document under its first COORDINATES - matches + 1 coordinate-value pairs (prefix).

Pairs of a posting list are found in two steps, and texts are read only for pairs whose signatures collide often enough.

1. Stars: a list's smallest id is its leader. Each (leader, member) pair with ``matches`` collisions is confirmed on full
   sets, ``PART`` members beside one copy of the leader; n members send n rows. The confirmed links give components, so a
   group of any number of near copies of one another is connected here.
2. Rest: only lists whose members are still in different components go on, with their leader as name; signatures alone
   are dealt to pairs of blocks of ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles. Inside, each member merges its shorter
   lists, skips the ``matches`` - 1 longest and probes those for what it found (skip merging); members of one component
   aren't compared. Only members with a partner left have their texts fetched and confirmed, in the same blocks.

Components of both steps' links come from distributed stars. No step emits the pairs of a group: a member sends one link
for a leader or block. Work is quadratic over BLOCK only in documents that collide often and don't link.

Defined results: null, blank: empty set, linked with nothing; fewer words than a shingle: the whole sequence as one; a
null id: no component (null), kept; rows that repeat an id are one document, linked whatever their texts, and
``drop_near_copies`` keeps one of them; texts of any length are taken whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .rows import FILE, ROW, bitmaps, located, marked, without
from .textnp import U, give_back, mix, slices, window_hashes, window_starts, words_of
from .workspace import stage

SHINGLE = 5
COORDINATES, ROWS = 28, 3
PART, BLOCK, BLOCK_SHINGLES = 256, 512, 1 << 19
BITS = 12
_rng = np.random.Generator(np.random.PCG64(0xC0FFEE))
MULTIPLY = _rng.integers(0, 2**63, COORDINATES * ROWS, dtype=np.uint64) * U(2) + U(1)


def sets_of(column: pa.Array, k: int = SHINGLE):
    """(row from, row to, sorted distinct shingles of the rows end to end, offsets) over runs of rows."""
    rows = 1 << BITS
    for a in range(0, len(column), rows):
        part = column.slice(a, min(rows, len(column) - a))
        for at, to, data, offsets in slices(part):
            w = words_of(data, offsets, lower=True)
            sizes = np.diff(w.first)
            full = window_hashes(w.hashes, k)
            ok = np.flatnonzero(window_starts(w.first, k)[: len(full)])
            doc = np.searchsorted(w.first, ok, "right") - 1
            h = full[ok]
            few = np.flatnonzero((sizes > 0) & (sizes < k))
            if len(few):
                whole = np.array([window_hashes(w.hashes[w.first[d] : w.first[d + 1]], int(sizes[d]))[0] + U(int(sizes[d])) for d in few], np.uint64)
                doc, h = np.concatenate((doc, few)), np.concatenate((h, mix(whole)))
            key = (doc.astype(np.uint64) << U(64 - BITS)) | (h >> U(BITS))
            key.sort()
            if len(key):
                key = key[np.concatenate(([True], key[1:] != key[:-1]))]
            begins = np.searchsorted(key >> U(64 - BITS), np.arange(to - at + 1, dtype=np.uint64))
            yield a + at, a + to, key & U((1 << (64 - BITS)) - 1), begins


def signatures(flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """COORDINATES values for each row that has shingles; rows without get zeros."""
    n = len(begins) - 1
    has = np.flatnonzero(np.diff(begins))
    out = np.zeros((n, COORDINATES), np.uint64)
    if len(has):
        x, at = mix(flat), begins[:-1][has]
        for c in range(COORDINATES):
            v = np.full(len(has), c + 1, np.uint64)
            for r in range(ROWS):
                v = mix(v * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(x * MULTIPLY[c * ROWS + r], at))
            out[has, c] = v
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, k1, k2, posts, FILE, ROW): set size, 128 bits that stand for the set, coordinates as keys; docs is located."""

    def make(batches):
        for b in batches:
            for at, to, flat, begins in sets_of(b.column(1)):
                n = np.diff(begins)
                sums = []
                for salt in (0x1234567, 0x89ABCDEF01):
                    c = np.zeros(len(flat) + 1, np.uint64)
                    np.cumsum(mix(flat ^ U(salt)), out=c[1:])
                    sums.append((c[begins[1:]] - c[begins[:-1]]).view(np.int64))
                s = signatures(flat, begins)
                offsets = pa.array(np.arange(0, (to - at + 1) * COORDINATES, COORDINATES, dtype=np.int32))
                posts = pa.ListArray.from_arrays(offsets, pa.array(s.ravel().view(np.int64)))
                place = [b.column(i).slice(at, to - at) for i in (2, 3)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array(n.astype(np.int64)), *map(pa.array, sums), posts, *place], ["id", "n_shingles", "k1", "k2", "posts", FILE, ROW])
        give_back()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), FILE, ROW)
    return stage(rows.mapInArrow(make, f"id bigint, n_shingles bigint, k1 bigint, k2 bigint, posts array<bigint>, {FILE} string, {ROW} bigint"), "near-sketch")


class Lists:
    """Posting lists of some members' coordinates."""

    def __init__(self, posts: np.ndarray):
        flat = posts.ravel()
        order = np.argsort(flat, kind="stable")
        new = np.concatenate(([True], flat[order[1:]] != flat[order[:-1]]))
        ends = np.append(np.flatnonzero(new)[1:], len(flat))
        self.posts, self.members = posts, order // posts.shape[1]
        rank, end = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
        rank[order], end[order] = np.arange(len(flat)), ends[np.cumsum(new) - 1]
        self.after, self.end = rank.reshape(posts.shape) + 1, end.reshape(posts.shape)

    def partners(self, p: int, matches: int) -> np.ndarray:
        """Later members that share ``matches`` coordinates with member p, in order."""
        left = self.end[p] - self.after[p]
        by = np.argsort(left, kind="stable")
        merge, skip = by[: len(by) - matches + 1], by[len(by) - matches + 1 :]
        merge = merge[left[merge] > 0]
        if not len(merge):
            return np.zeros(0, np.int64)
        met, n = np.unique(np.concatenate([self.members[self.after[p, c] : self.end[p, c]] for c in merge]), return_counts=True)
        if len(skip):
            n = n + (self.posts[met][:, skip] == self.posts[p, skip]).sum(1)
        return met[n >= matches]


def common(own: np.ndarray, flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many of each set (flat from begins on; none is empty) are in the sorted set own."""
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    return np.add.reduceat((own[at] == flat).astype(np.int64), begins[:-1]) if len(begins) > 1 else np.zeros(0, np.int64)


def with_partners(comps: np.ndarray, sides: np.ndarray, posts: np.ndarray, matches: int) -> np.ndarray:
    """Mask of members that collide often enough with one of another component and, if there are two sides, of the other side."""
    out, lists = np.zeros(len(comps), bool), Lists(posts)
    both = len(np.unique(sides)) > 1
    for p in range(len(comps) - 1):
        q = lists.partners(p, matches)
        q = q[(comps[q] != comps[p]) & ((sides[q] != sides[p]) | (not both))]
        if len(q):
            out[p] = True
            out[q] = True
    return out


def links_within(ids: np.ndarray, comps: np.ndarray, posts: np.ndarray, flat: np.ndarray, begins: np.ndarray, percent: int, matches: int) -> list[tuple[int, int]]:
    """Links (id, id) that connect these members as all links among them do; those of one component are connected already."""
    size = np.diff(begins)
    order = np.argsort(size, kind="stable")
    root = np.unique(comps, return_inverse=True)[1]
    out, lists = [], Lists(posts[order])
    for p in range(len(ids) - 1):
        a = order[p]
        own = flat[begins[a] : begins[a + 1]]
        for b in order[lists.partners(p, matches)].tolist():
            if root[b] != root[a] and 100 * size[a] >= percent * size[b]:
                both = len(np.intersect1d(own, flat[begins[b] : begins[b + 1]], assume_unique=True))
                if 100 * both >= percent * (size[a] + size[b] - both):
                    out.append((int(ids[a]), int(ids[b])))
                    root[root == root[b]] = root[a]
    return out


def _groups(keys: list[np.ndarray]) -> list[tuple[int, int]]:
    """Runs of rows with equal keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new).tolist()
    return list(zip(at, [*at[1:], n]))


def _ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _posts(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, COORDINATES)


def _edges(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(p[0]) for p in pairs], pa.int64()), pa.array([int(p[1]) for p in pairs], pa.int64())], ["u", "v"])


def _texts(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """wanted (with FILE and ROW) and the texts at these places; other texts aren't moved."""
    some = marked(docs.select(FILE, ROW, F.col(text_col).alias("text")), bitmaps(wanted), "__sig_in").where("__sig_in").drop("__sig_in")
    some = some.select(F.col(FILE).alias("t_file"), F.col(ROW).alias("t_row"), "text")
    return wanted.join(some, (wanted[FILE] == some["t_file"]) & (wanted[ROW] == some["t_row"])).drop("t_file", "t_row", FILE, ROW)


def _dealt(rows: DataFrame, keys: list[str], then: list[str]) -> DataFrame:
    """rows in groups of keys, each in one partition, in order of keys and then."""
    n = max(12, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *then)


def _met(rows: DataFrame, key: str, side: DataFrame, side_key: str, large: int) -> DataFrame:
    """rows joined with side, a staged table with a size for each key. Keys of over ``large`` rows, a thousandth of all rows
    and so a thousand times the coordinates at most, are broadcast: no task gets all rows of such a key."""
    hot = F.broadcast(side.where(F.col("size") > large))
    on = F.col(key) == F.col(side_key)
    cold = rows.join(hot.select(side_key), on, "left_anti").join(side.where(F.col("size") <= large), on)
    return rows.join(hot, on).unionByName(cold).drop(side_key)


def star_links(docs: DataFrame, reps: DataFrame, work: DataFrame, text_col: str, percent: int, matches: int) -> DataFrame:
    """(u, v) links of members with the leaders of their lists, staged."""
    pairs = work.where("rep <> leader").select("leader", "rep").distinct()
    pairs = stage(pairs, "near-pairs")
    parts = pairs.groupBy(F.col("leader").alias("p_leader")).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    parts = stage(parts, "near-parts")
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part")
    pairs = pairs.join(parts, F.col("leader") == F.col("p_leader")).select("leader", "rep", part)
    posts = reps.select(F.col("rep").alias("r_rep"), "posts", FILE, ROW)
    # An id may lead with several sets, which k1 tells apart.
    heads = parts.join(reps, F.col("p_leader") == F.col("rep")).select("p_leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p_part"), F.col("k1").alias("set"), F.col("posts").alias("p_posts"), F.struct(FILE, ROW).alias("p_at"))
    met = pairs.join(posts, F.col("rep") == F.col("r_rep")).join(heads, (F.col("leader") == F.col("p_leader")) & (F.col("part") == F.col("p_part")))
    same = F.aggregate(F.zip_with("posts", "p_posts", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, b: a + b)
    met = stage(met.where(same >= matches).select("leader", "set", "part", "rep", FILE, ROW, "p_at"), "near-stars")
    first = met.select("leader", "set", "part", F.col("leader").alias("rep"), f"p_at.{FILE}", f"p_at.{ROW}").distinct()
    wanted = met.drop("p_at").withColumn("head", F.lit(0)).unionByName(first.withColumn("head", F.lit(1)))
    full = _dealt(_texts(docs, text_col, wanted), ["leader", "set", "part"], [F.desc("head")])

    def confirm(batches):
        key, own = None, np.zeros(0, np.uint64)
        for b in batches:
            leaders, sets, parts, ids = (_ints(b.column(b.schema.get_field_index(c))) for c in ("leader", "set", "part", "rep"))
            out: list = []
            for at, to, flat, begins in sets_of(b.column(b.schema.get_field_index("text"))):
                for x, y in _groups([leaders[at:to], sets[at:to], parts[at:to]]):
                    if (now := (leaders[at + x], sets[at + x], parts[at + x])) != key:
                        # A group's first row is its leader's.
                        key, own, x = now, flat[begins[x] : begins[x + 1]], x + 1
                    if x < y:
                        cuts = begins[x : y + 1] - begins[x]
                        n, both = np.diff(cuts), common(own, flat[begins[x] : begins[y]], cuts)
                        out += [(ids[at + x + i], key[0]) for i in np.flatnonzero(100 * both >= percent * (n + len(own) - both)).tolist()]
            yield _edges(out)
        give_back()

    return stage(full.mapInArrow(confirm, "u bigint, v bigint"), "near-links")


def rest_links(docs: DataFrame, reps: DataFrame, work: DataFrame, comp: DataFrame, text_col: str, percent: int, matches: int, block: int, large: int) -> DataFrame | None:
    """(u, v) links between components, of pairs without the leader of their list; None if no list is open."""
    named = work.where("size > 2").join(comp, F.col("rep") == F.col("u"), "left").select("key", "leader", "rep", F.coalesce("v", "rep").alias("comp"))
    lists = named.groupBy(F.col("key").alias("o_key")).agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("size")).where("a <> b")
    lists = stage(lists.select("o_key", "size"), "near-open-lists")
    if lists.isEmpty():
        return None
    posts = reps.select(F.col("rep").alias("r_rep"), "posts", "n_shingles", FILE, ROW)
    group = _met(named, "key", lists, "o_key", large).select("leader", "rep", "comp").distinct()
    group = stage(group.join(posts, F.col("rep") == F.col("r_rep")).drop("r_rep"), "near-open")
    count = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    many = group.groupBy(F.col("leader").alias("l_leader")).agg(count.alias("blocks")).where("blocks > 1")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, own).alias("i"), F.greatest(b, own).alias("j"), own.alias("side")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    dealt = group.join(many, F.col("leader") == F.col("l_leader"), "left").withColumn("p", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(pairs)))
    dealt = dealt.select("leader", "p.i", "p.j", "p.side", "rep", "comp", "posts", FILE, ROW)
    names, kinds = ["leader", "i", "j", "side", "rep", "comp"], "leader bigint, i int, j int, side int, rep bigint, comp bigint"

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        comps, sides = (table.column(c).to_numpy() for c in ("comp", "side"))
        posts = _posts(table.column("posts").combine_chunks())
        return table.filter(pa.array(with_partners(comps, sides, posts, matches)))

    full_kind = f"{kinds}, posts array<bigint>, {FILE} string, {ROW} bigint"
    # Numbered partitions: a few rows may be much work here, so Spark isn't to put partitions together.
    n = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted = stage(dealt.repartition(n, "leader", "i", "j").groupBy("leader", "i", "j").applyInArrow(meet, full_kind), "near-met")
    if wanted.isEmpty():
        return None

    def confirm(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, comps = (table.column(c).to_numpy() for c in ("rep", "comp"))
        flats, sizes = [], []
        for _, _, flat, begins in sets_of(table.column("text").combine_chunks()):
            flats.append(flat)
            sizes.append(np.diff(begins))
        begins = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        found = links_within(ids, comps, _posts(table.column("posts").combine_chunks()), np.concatenate(flats), begins, percent, matches)
        return pa.Table.from_batches([_edges(found)])

    return stage(_texts(docs, text_col, wanted.select(*names, "posts", FILE, ROW)).repartition(n, "leader", "i", "j").groupBy("leader", "i", "j").applyInArrow(confirm, "u bigint, v bigint"), "near-links")


def _placed(docs: DataFrame, id_col: str, text_col: str, percent: int, matches: int | None, block: int) -> DataFrame:
    """(id, n_shingles, component_id, FILE, ROW) of each row of located docs."""
    matches = matches or (3 if percent >= 85 else 2)
    rows = sketch(docs, id_col, text_col)
    n = rows.count()
    sets = rows.where("n_shingles > 0 and id is not null")
    first = F.min(F.struct("id", FILE, ROW, "n_shingles", "posts")).alias("r")
    classes = stage(sets.groupBy("k1", "k2").agg(first, F.count(F.lit(1)).alias("size")).select("k1", "k2", "size", F.col("r.id").alias("rep"), f"r.{FILE}", f"r.{ROW}", "r.n_shingles", "r.posts"), "near-classes")
    posts = classes.select("rep", F.explode(F.slice("posts", 1, COORDINATES - matches + 1)).alias("key"))
    lists = posts.groupBy(F.col("key").alias("l_key")).agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
    large = max(64, n // 1000)
    work = stage(_met(posts, "key", stage(lists, "near-lists"), "l_key", large), "near-work")
    # Rows that repeat an id with other texts lie in several classes, which they link.
    names = classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("rep").alias("v"))
    twice = sets.groupBy(F.col("id").alias("d_id")).agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b")
    again = sets.join(twice, F.col("id") == F.col("d_id")).join(names, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))).select(F.col("id").alias("u"), "v")
    comp = components(star_links(docs, classes, work, text_col, percent, matches).unionByName(again))
    more = rest_links(docs, classes, work, comp, text_col, percent, matches, block, large)
    if more is not None:
        comp = components(comp.unionByName(more))
    named = classes.join(comp, classes["rep"] == comp["u"], "left").select("k1", "k2", "size", F.coalesce("v", "rep").alias("component_id"))
    # Classes of over a thousandth of all rows, a thousand at most, are broadcast to salt their rows.
    salts = F.when(F.col("size") > large, F.ceil(F.col("size") / large)).otherwise(F.lit(1)).cast("int")
    hot = classes.where(F.col("size") > large).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), salts.alias("salts"))
    thin = rows.select("id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("k1")).alias("r1"), F.col("k2").alias("r2"), FILE, ROW)
    thin = thin.join(F.broadcast(hot), (F.col("r1") == F.col("h1")) & (F.col("r2") == F.col("h2")), "left")
    thin = thin.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(FILE, ROW), F.col("salts")), F.lit(0)).cast("int"))
    sides = named.withColumn("g_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    out = thin.join(sides, (F.col("r1") == F.col("k1")) & (F.col("r2") == F.col("k2")) & (F.col("salt") == F.col("g_salt")), "left")
    return out.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"), FILE, ROW)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, matches: int | None = None, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per input row; a link needs 100 * common >= percent * all shingles."""
    out = _placed(located(docs), id_col, text_col, percent, matches, block)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, matches: int | None = None, block: int = BLOCK) -> DataFrame:
    """docs with one row of each component: docs' columns."""
    rows = located(docs)
    placed = stage(_placed(rows, id_col, text_col, percent, matches, block).where("n_shingles > 0 and id is not null"), "near-verdict")
    place = F.struct(FILE, ROW)
    stay = placed.where("id = component_id").groupBy("component_id").agg(F.min(place).alias("p")).select(F.col(f"p.{FILE}").alias("s_file"), F.col(f"p.{ROW}").alias("s_row"))
    gone = placed.join(stay, (F.col(FILE) == F.col("s_file")) & (F.col(ROW) == F.col("s_row")), "left_anti")
    return without(rows, gone.select(FILE, ROW))
