"""Quality rules with cross-document line frequency (native DataFrame functions only).

Lines are normalised (lower case, digits to 0, blanks to one space), hashed, and counted once per different document
of a host: documents whose texts are equal after removal of blanks count as one. A line above the host's limit,
``min(most_docs, max(least_docs, fraction * documents of the host))``, is removed; so a line of over ``most_docs``
documents goes however large its host is. A document that keeps fewer than ``keep_words`` of
its words, as a share, is depleted and rejected. ``base`` holds the rules inside one document.

A text is scanned once: counts and hashes of its lines are staged, and all that follows works on those.

Defined results: null text: no words, base failed; null host: a host of its own; texts of any length are taken whole; an
empty table gives an empty result; repeated rows each get their verdict; other columns are ignored by ``verdicts`` and
kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import FILE, ROW, bitmaps, located, marked, without
from .workspace import stage

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 5
LEAST_DOCS, FRACTION, MOST_DOCS, KEEP_WORDS = 2, 0.10, 10, 0.30


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, even inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Number of words inside k-word windows that occur twice or more among these words."""

    def covered(grams: Column) -> Column:
        def from_sorted(s: Column) -> Column:
            n = F.size(s)
            same = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == x["h"]))
            at = F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))
            # Words covered: each window adds what lies beyond the one before it.
            return _let(at, lambda p: F.aggregate(F.transform(p, lambda v, j: F.when(j == 0, F.lit(k)).otherwise(F.least(F.lit(k), v - F.get(p, j - 1)))), F.lit(0), lambda a, v: a + v))

        return _let(F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), from_sorted)

    def from_hashes(h: Column) -> Column:
        n = F.size(h)
        grams = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return F.when(n < k, F.lit(0)).otherwise(_let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes).cast("long")


def base(text: Column) -> dict[str, Column]:
    """The rules inside one text, as columns by name."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.regexp_replace(x, BLANK, "")) > 0)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(t, BLANK, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, SYMBOL, "")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def hashed_lines(text: Column) -> Column:
    """(h, n) of each line: hash of the normalised line, null for lines without a word, and its words. The whole text is normalised before it is cut."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    # Words of a normalised line have one space between them.
    count = lambda t: (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("int")
    line = lambda t: F.struct(F.when(t != "", F.xxhash64(t)).alias("h"), F.when(t != "", count(t)).otherwise(0).alias("n"))
    return F.transform(F.split(plain, "\n"), lambda x: _let(F.trim(x), line))


def scanned(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(uid, id, host, doc, lines, base counts) of each row, and its place if docs has it, staged: the one scan of the texts.

    doc is a hash of the text without blanks.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    counts = [v.alias(k) for k, v in base(F.col(text_col)).items()]
    place = [c for c in (FILE, ROW) if c in docs.columns]
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.xxhash64(F.regexp_replace(t, BLANK, "")).alias("doc"), hashed_lines(t).alias("lines"), *counts, *place)
    return stage(rows.withColumn("uid", F.monotonically_increasing_id()), "quality-rows")


def frequent_lines(rows: DataFrame, least_docs: int, fraction: float, most_docs: int) -> DataFrame:
    """(g_host, g_line) above the limit of their host, staged."""
    sizes = rows.select("host", "doc").distinct().groupBy(F.col("host").alias("s_host")).agg(F.count(F.lit(1)).alias("host_docs"))
    # explode_outer: explode would have Catalyst evaluate the array a second and third time, in a filter for empty arrays.
    pairs = rows.select("host", "doc", F.explode_outer("lines.h").alias("line")).where("line is not null").distinct()
    seen = pairs.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min(least_docs, most_docs))
    limit = F.least(F.lit(most_docs), F.greatest(F.lit(least_docs), F.col("host_docs") * fraction))
    over = seen.join(sizes, F.col("host").eqNullSafe(F.col("s_host"))).where(F.col("n") > limit)
    return stage(over.select(F.col("host").alias("g_host"), F.col("line").alias("g_line")), "quality-lines")


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, least_docs: int, fraction: float, keep_words: float, most_docs: int) -> DataFrame:
    """The scanned rows with kept_words, base_failed, kept and gone, the numbers of the lines to remove (null: none)."""
    rows = scanned(docs, id_col, text_col, host_col)
    gone = frequent_lines(rows, least_docs, fraction, most_docs)
    # Each line meets the limits by (host, line). gone is staged, so Spark knows its size: it broadcasts it only if it is
    # small; else both sides shuffle by (host, line), where no line is a row of gone twice and a hot line's rows can be split.
    lines = rows.select("uid", "host", F.posexplode_outer("lines").alias("at", "line")).where("line.h is not null").select("uid", "host", "at", "line.h", "line.n")
    hits = lines.join(gone, F.col("host").eqNullSafe(F.col("g_host")) & (F.col("h") == F.col("g_line")))
    lost = hits.groupBy(F.col("uid").alias("l_uid")).agg(F.sum("n").alias("lost"), F.collect_list("at").alias("gone"))
    n = F.col("n_words")
    out = rows.drop("lines").join(lost, F.col("uid") == F.col("l_uid"), "left").withColumn("kept_words", n - F.coalesce("lost", F.lit(0)))
    out = out.withColumn("base_failed", (n < 10) | (100 * F.col("n_repeat_words") > 20 * n))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("kept_words") >= keep_words * n)).drop("lost", "l_uid", "uid")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_docs: int = LEAST_DOCS, fraction: float = FRACTION, keep_words: float = KEEP_WORDS, most_docs: int = MOST_DOCS) -> DataFrame:
    """id, the base counts, base_failed, kept_words and kept of each row."""
    out = _judged(docs, id_col, text_col, host_col, least_docs, fraction, keep_words, most_docs)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_words", "base_failed", "kept")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_docs: int = LEAST_DOCS, fraction: float = FRACTION, keep_words: float = KEEP_WORDS, most_docs: int = MOST_DOCS) -> DataFrame:
    """docs without the rejected rows and, in the rows that stay, without the lines above the limits: docs' columns.

    Only texts that lose lines are moved; the others stay where they are.
    """
    rows = located(docs)
    judged = stage(_judged(rows, id_col, text_col, host_col, least_docs, fraction, keep_words, most_docs).where("not kept or gone is not null").select(FILE, ROW, "kept", "gone"), "quality-verdict")
    same = without(rows, judged)
    cut = judged.where("kept").select(F.col(FILE).alias("c_file"), F.col(ROW).alias("c_row"), "gone")
    some = marked(rows, bitmaps(judged.where("kept")), "__sig_in").where("__sig_in")
    some = some.join(cut.withColumnRenamed("gone", "__sig_gone"), (F.col(FILE) == F.col("c_file")) & (F.col(ROW) == F.col("c_row")))
    lines = F.split(F.col(text_col), "\n")
    stay = _let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__sig_gone")), lambda i: F.get(x, i)), "\n"))
    return same.unionByName(some.select(*[stay.alias(c) if c == text_col else F.col(c) for c in docs.columns]))
