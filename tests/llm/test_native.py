"""Chat, quality, mixing and sharding against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sigspark.llm import chat, quality
from sigspark.llm.mixing import plan, sequence
from sigspark.llm.sharding import ShardTree, shard_rows

from .conftest import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id bigint, turn bigint, role string, text string"


def conversations():
    evil = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", evil), (-7, 1, "assistant", evil)]
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", f"be {c} \\l \\e <s>[ROLE] x [/ROLE]"))
        for t in range(1, 2 + 5 * c):
            rows.append((c, t, ["user", "assistant"][t % 2 == 0], ["hi", "", None, "é<[\\" * 40, "long " * (30 * c)][(c + t) % 5]))
    return rows + [(None, 1, None, "a"), (99, 0, "assistant", "only"), (50, 1, "tool", "r"), (50, 1, "assistant", "tie"), (50, None, "user", "x")]


def brute_chat(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for *_, r, x in turns if r == "assistant")
        told = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        out.append((c, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("budget,history", [(2048, 512), (200, 60), (40, 0)])
def test_chat_reads_back(spark, budget, history):
    df = spark.createDataFrame(conversations(), TURNS).withColumn("window", F.lit("extra"))
    w = chat.windows(df, budget, history)
    assert table(chat.read_back(w).drop("formatted_chars")) == brute_chat(conversations())


def test_chat_windows_keep_the_budget_the_system_turn_and_repeat_history(spark):
    rows = [(1, 0, "system", "rules")] + [(1, i, ["user", "assistant"][i % 2 == 0], "word " * 40) for i in range(1, 40)]
    w = chat.windows(spark.createDataFrame(rows, TURNS), 1000, 200).orderBy("window").collect()
    assert len(w) > 2
    for x in w:
        parts = x.formatted.split(chat.CLOSE)[:-1]
        assert parts[0].startswith("<s>[ROLE] system [/ROLE]rules")
        assert sum(len(p) + 4 for p in parts) / 4 <= 1000
        assert x.n_repeated == (0 if x.window == 0 else x.n_repeated) and (x.window == 0 or x.n_repeated >= 2)
        assert all(x.formatted[s.start - 1 : s.start - 1 + s.length] == "word " * 40 for s in x.loss)
    assert sum(len(x.loss) for x in w) == 19


def brute_windows(turns, budget, history):
    """Greedy windows of one conversation's (role, tokens): lists of (turn, repeated)."""
    system = bool(turns) and turns[0][0] == "system"
    out, at = [], 0
    while at < len(turns):
        t = turns[at][1]
        head = system and at > 0 and turns[0][1] + t <= budget
        used = t + (turns[0][1] if head else 0)
        room, back = min(history, budget - used), at
        while back > system and sum(x[1] for x in turns[back - 1 : at]) <= room:
            back -= 1
        used += sum(x[1] for x in turns[back:at])
        to = at + 1
        while to < len(turns) and used + turns[to][1] <= budget:
            used += turns[to][1]
            to += 1
        out.append(([0] if head else []) + list(range(back, at)) + list(range(at, to)))
        at = to
    return out


def test_chat_budget_over_many_system_turns_and_lengths(spark):
    import random

    r = random.Random(5)
    rows, budget, history = [], 2048, 512
    for c in range(60):
        n = r.choice([1, 2, 5, 30])
        for t in range(n):
            role = "system" if t == 0 and c % 3 else ["user", "assistant"][t % 2]
            rows.append((c, t, role, "x" * 4 * r.choice([0, 10, 100, 700, 900, 1300, 2040, 2041, 4000])))
    w = chat.windows(spark.createDataFrame(rows, TURNS), budget, history)
    got = defaultdict(list)
    for x in w.orderBy("conv_id", "block", "window").collect():
        sizes = [len(p.split(chat.ROLE_END)[1]) // 4 + 8 for p in x.formatted.split(chat.CLOSE)[:-1]]
        assert x.n_tokens == sum(sizes) and x.estimated
        assert x.n_tokens <= budget or len(sizes) == 1
        got[x.conv_id].append((sizes, x.n_repeated))
    for c in range(60):
        turns = [(role, len(t) // 4 + 8) for i, _, role, t in rows if i == c]
        assert [s for s, _ in got[c]] == [[turns[i][1] for i in w] for w in brute_windows(turns, budget, history)]
    assert table(chat.read_back(w).drop("formatted_chars")) == brute_chat(rows)


def test_chat_blocks_of_a_long_conversation(spark):
    """A conversation dealt over several blocks reads back and keeps its system turn in each; real token counts are taken."""
    rows = [(1, 5, "system", "rules")] + [(1, 5 + i, ["user", "assistant"][i % 2 == 0], f"turn {i}") for i in range(1, 50)]
    rows += [(2, i, "user" if i else "system", "y" * i) for i in range(3)] + [(3, i, "system", "z") for i in (1, 40)]
    df = spark.createDataFrame(rows, TURNS).withColumn("mine", F.lit(10))
    w = chat.windows(df, 100, 30, tokens_col="mine", block=8)
    assert table(chat.read_back(w).drop("formatted_chars")) == brute_chat(rows)
    found = w.collect()
    assert all(x.n_tokens <= 100 and not x.estimated for x in found) and len({x.block for x in found if x.conv_id == 1}) == 7
    assert all(x.formatted.startswith("<s>[ROLE] system [/ROLE]rules") for x in found if x.conv_id == 1)


def test_chat_empty(spark):
    assert chat.read_back(chat.windows(spark.createDataFrame([], TURNS))).count() == 0


def brute_base(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def normal(line):
    line = re.sub("[0-9]", "0", line.lower())
    return re.sub(r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ", line).strip(" ")


def brute_quality(rows, least, fraction, keep):
    hosts, seen = defaultdict(set), defaultdict(set)
    for _, t, _, s, _ in rows:
        d = re.sub(r"[\x20\x09-\x0D]+", "", t or "")
        hosts[s].add(d)
        for x in (t or "").split("\n"):
            if normal(x):
                seen[s, normal(x)].add(d)
    gone = {k for k, d in seen.items() if len(d) > least and len(d) > fraction * len(hosts[k[0]])}
    out = []
    for i, t, _, s, _ in rows:
        b = brute_base(t)
        left = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if (s, normal(x)) not in gone)
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        out.append((i, *b, left, failed, not failed and left >= keep * b[0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,fraction", [(50, 0.1), (1, 0.02)])
def test_quality(clashing, rows, least, fraction):
    more = [(1000 + i, f"menu home about\nown words of page {chr(97 + i)} {'and so on ' * (i % 3)}\nhome 12\nHome  34", "en", "s9", 0) for i in range(9)]
    df = clashing.select("doc_id", "text", "lang", "source", "n_chars").unionByName(clashing.sparkSession.createDataFrame(more, clashing.select("doc_id", "text", "lang", "source", "n_chars").schema))
    df = df.withColumns({c: F.lit("extra") for c in ("line", "host", "left", "words", "kept")})
    got = quality.verdicts(df, least_docs=least, fraction=fraction)
    want = brute_quality(rows + more, least, fraction, quality.KEEP_WORDS)
    assert table(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_words", "base_failed", "kept")) == want
    clean = quality.clean(df, least_docs=least, fraction=fraction)
    assert clean.columns == df.columns
    assert {r.doc_id: len(WORD.findall(r.text or "")) for r in clean.collect()} == {r[0]: r[6] for r in want if r[-1]}


@pytest.mark.parametrize("n,shared", [(4, 3), (400, 11)])
def test_quality_limits(spark, n, shared):
    """A repeated line goes from a host of 4 documents and, in 11 of 400, from a large one; one at the limit stays."""
    own = lambda i: " ".join("x" * (i // 20 + 1) + chr(97 + i % 20) + chr(97 + j) for j in range(12))
    text = lambda i: own(i) + "\nShare this page" * (i < shared) + "\nstays here" * (i < shared - 1)
    df = spark.createDataFrame([(i, text(i), "host") for i in range(n)], "doc_id bigint, text string, source string")
    got = {r.doc_id: r.text for r in quality.clean(df).collect()}
    assert got == {i: text(i).replace("\nShare this page", "") for i in range(n)}


def test_quality_odd_and_empty(odd, nothing):
    assert quality.verdicts(nothing).count() == 0 and quality.clean(nothing).count() == 0
    assert quality.verdicts(odd).count() == 7 and quality.clean(odd).count() == 0


def brute_targets(rows):
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, free = 1.5 * sum(size.values()), set(order)
    while free and left > 1e-9:
        w = sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        left = 0.0
        for s in list(free):
            target[s] += share[s]
            if target[s] >= 2 * size[s]:
                left += target[s] - 2 * size[s]
                target[s] = 2.0 * size[s]
                free.discard(s)
    return size, target


def test_mixing(clashing, rows):
    size, target = brute_targets(rows)
    got = plan(clashing).collect()
    assert len(got) == len(rows)
    taken = Counter()
    source = {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r.id]
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        assert (r.first_position is None) == (r.taken == 0) and (r.second_position is None) == (r.taken <= r.size)
        taken[s] += r.taken
        for p in (r.first_position, r.second_position):
            assert p is None or 0 <= p <= 1
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6
    assert table(plan(clashing)) == table(plan(clashing.repartition(2)))


def test_sequence_takes_effect(docs, rows):
    want = {r.id: r.taken for r in plan(docs).collect()}
    got = Counter()
    seq = sequence(docs)
    assert seq.columns == docs.columns
    for r in seq.collect():
        got[r.doc_id] += len(WORD.findall(r.text or ""))
    assert dict(got) == {i: n for i, n in want.items() if n}


def test_sequence_order_and_rows_that_repeat_an_id(spark, docs):
    """Each row of an id is taken by its own plan; positions rise from file to file, but for rows of one block."""
    rows = [(i // 3, " ".join(f"w{i}x{j}" for j in range(1 + i % 7)), None, f"s{i % 2}", 0) for i in range(300)]
    df = spark.createDataFrame(rows, docs.schema)
    want = plan(df).collect()
    seq = sequence(df, part_words=50).withColumn("part", F.spark_partition_id()).collect()
    got, full = Counter(), Counter()
    for r in seq:
        got[r.doc_id] += len(WORD.findall(r.text))
        full[r.doc_id, r.text] += 1
    need = Counter()
    for r in want:
        need[r.id] += r.taken
    assert got == need
    # A row that is taken whole twice is there twice, with its own words.
    text = {(i, len(WORD.findall(t))): t for i, t, *_ in rows}
    assert all(full[r.id, text[r.id, r.size]] >= 2 for r in want if r.taken == 2 * r.size)
    first = {(r.id, r.size): r.first_position for r in want}
    by_part = defaultdict(list)
    for r in seq:
        p = first.get((r.doc_id, len(WORD.findall(r.text))))
        if p is not None and full[r.doc_id, r.text] == 1:
            by_part[r.part].append(p)
    means = [sum(v) / len(v) for _, v in sorted(by_part.items()) if v]
    assert len(means) > 5 and means == sorted(means)


def test_mixing_odd_and_empty(odd, nothing):
    assert plan(nothing).count() == 0 and sequence(nothing).count() == 0
    assert plan(odd).count() == 7
    taken = sum(r.taken for r in plan(odd).collect())
    assert sum(len(WORD.findall(r.text)) for r in sequence(odd).collect()) == taken


def test_sharding(clashing, rows):
    got = shard_rows(clashing, ShardTree.uniform()).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        slots[r.shard].append(r.slot)
        raw = text[r.doc_id].encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.law == "key"
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_tree_is_even_and_moves_little(spark):
    tree = ShardTree.uniform()
    df = spark.range(20000).selectExpr("cast(id as string) as k")
    placed = tree.grow().place(tree.place(df, "k", "a"), "k", "b")
    placed = tree.reweight(5, 3.0).place(placed, "k", "c")
    n = Counter(r.a for r in placed.collect())
    assert len(n) == 24 and max(n.values()) < 1.3 * min(n.values())
    moved = placed.where("a <> b").select("b").distinct().collect()
    assert [r.b for r in moved] == [24]
    share = placed.where("b = 24").count() / 20000
    assert 0.03 < share < 0.05
    # More weight on shard 5, in rack 1 of region 0: at the highest level where a row moves, it moves into the child that grew.
    assert placed.where("a <> c").count() > 0
    assert placed.where("a div 12 <> c div 12 and c div 12 <> 0").count() == 0
    assert placed.where("a div 12 = c div 12 and a div 4 <> c div 4 and c div 4 <> 1").count() == 0
    assert placed.where("a div 4 = c div 4 and a <> c and c <> 5").count() == 0


def test_sharding_odd_and_empty(odd, nothing):
    assert shard_rows(nothing, ShardTree.uniform()).count() == 0
    got = shard_rows(odd, ShardTree.uniform())
    assert got.count() == 7 and got.select("shard", "slot").distinct().count() == 7
