import random

import pytest

WORDS = "the of and tion er the idea over under loser green blue Stone river Éau größe x1 9 a.b ;-) zeit mañana".split()


def make_docs(seed=3, n=120):
    """Rows (doc_id, text, lang, source, n_chars) with copies, near copies, shared passages, nulls, blanks and long texts."""
    r = random.Random(seed)
    vocabulary = WORDS + ["w" + "".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = prose(60)
    texts = []
    for i in range(n):
        kind = i % 12
        if kind == 3 and texts:
            texts.append(r.choice(texts))
        elif kind == 5 and i > 20:
            w = (r.choice([t for t in texts if t and len(t) > 100]) or "").split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif kind == 7:
            texts.append(prose(r.randrange(5, 90)) + "\n" + passage + "\n" + prose(20))
        elif kind == 9:
            texts.append(r.choice([None, "", " \t\n", "one", "two words", "\n\n", "a b c d e", "same line\nsame line\nother\n9 x\n same line"]))
        else:
            texts.append(prose(r.randrange(1, 160)).replace(" the ", "\nthe  ", 2))
    texts[7] = prose(6000)
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", "s2", "b", "B", "é", None]), len(t) if t else 0) for i, t in enumerate(texts)]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ["id", "h", "size", "kept", "uid", "key", "n", "u", "v", "sha", "target", "rank", "host", "line", "lines", "position", "shard", "block", "words", "rep", "leader", "stay", "taken", "part", "salt", "at"]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(f"extra {c}") for c in CLASH})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, repeated rows, repeated ids."""
    return spark.createDataFrame([(None, None, None, None, None), (None, "x y", None, None, 3), (5, "x  y", "en", None, 4), (5, "x  y", "en", None, 4), (5, "other text", "en", "s", 9), (2, "xy", None, "s", 2), (1, None, None, None, None)], SCHEMA)


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
