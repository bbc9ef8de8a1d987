"""Chat formatting in budgeted windows (native DataFrame functions only).

Turns are cut into spans by prefix sums of turn tokens: a span starts at a turn and takes the turns after it while the
system turn, the repeated history and the span fit ``budget``. The history is as many of the turns right before the
span as fit ``history`` tokens and leave room for the span's first turn. So a window passes the budget only if a single
turn does, and then holds that turn alone. The system turn (the first turn, if its role is system) is repeated in each
window whose first turn fits beside it. A window's new assistant texts are under the loss mask, repeated turns are not.

Tokens of a turn are estimated as its UTF-8 bytes / 4 + 8, unless ``tokens_col`` names real counts.

A conversation is dealt by ``BLOCK`` turn numbers, so a huge one is not one task; a span or its history doesn't cross the
border of a block. ``read_back`` gathers a conversation's windows, as a digest of a whole conversation must.

Template: ``<s>[ROLE] role [/ROLE]`` text ``</s>`` per turn. Inside roles and texts ``\\``, ``<`` and ``[`` are written
``\\e``, ``\\l`` and ``\\b``, so no control string can occur there; ``unescape`` is the inverse.

Defined results: null text is empty, null role is the role ``""``; rows with equal turn numbers are ordered by role
and text, null ones come first; a null conv_id is a conversation of its own; repeated rows are turns each; texts of any
length are taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY = 2048, 512
BLOCK = 1024
OPEN, ROLE_END, CLOSE = "<s>[ROLE] ", " [/ROLE]", "</s>"
_NO_TURN = -(1 << 62)


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\e"), F.lit("\\"))


def _blocks(rows: DataFrame) -> DataFrame:
    """rows and, for each block after a conversation's first, a row that carries its first turn there (``own`` false)."""
    first = F.min(F.struct("turn", "role", F.when(F.col("role") == "system", F.col("text")).alias("text"), "tokens"))
    heads = rows.groupBy("conv_id").agg(first.alias("head"), F.collect_set("block").alias("blocks")).where(F.size("blocks") > 1)
    later = F.array_remove(F.col("blocks"), F.array_min("blocks"))
    carried = heads.select("conv_id", F.explode(later).alias("block"), F.lit(False).alias("own"), "head.turn", "head.role", "head.text", "head.tokens")
    return rows.select("conv_id", "block", F.lit(True).alias("own"), "turn", "role", "text", "tokens").unionByName(carried)


def _spans(budget: int, history: int) -> Column:
    """The windows over the array ``turns``: (from, to, history, head, tokens), to excluded, history in turns."""
    turns = F.col("turns")
    tokens, before = (lambda i: F.get(turns, i)["tokens"]), (lambda i: F.get(turns, i)["upto"] - F.get(turns, i)["tokens"])
    # Turn 0 is the system turn: a carried one belongs to no span here.
    low = F.when(F.col("system"), 1).otherwise(0)
    own = F.when(F.get(turns, F.lit(0))["own"], 0).otherwise(1)
    kind = "struct<from:int,to:int,history:int,head:boolean,tokens:bigint>"

    def opened(i: Column) -> Column:
        head = F.col("system") & (i > 0) & (tokens(F.lit(0)) + tokens(i) <= budget)
        used = tokens(i) + F.when(head, tokens(F.lit(0))).otherwise(F.lit(0))
        room = F.least(F.lit(history), F.lit(budget) - used)
        start = F.greatest(low, own)
        near = F.size(F.filter(F.slice(turns, start + 1, F.greatest(F.lit(0), i - start)), lambda t: before(i) - (t["upto"] - t["tokens"]) <= room))
        return F.struct(i.alias("from"), (i + 1).alias("to"), near.alias("history"), head.alias("head"), (used + before(i) - before(i - near)).alias("tokens")).cast(kind)

    def step(done: Column, i: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["from"].alias("from"), (i + 1).alias("to"), last["history"].alias("history"), last["head"].alias("head"), (last["tokens"] + tokens(i)).alias("tokens")).cast(kind)
        fits = (F.size(done) > 0) & (F.coalesce(last["tokens"], F.lit(0)) + tokens(i) <= budget)
        return F.when(fits, F.concat(F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1)), F.array(longer))).otherwise(F.concat(done, F.array(opened(i))))

    every = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: i >= own)
    return F.aggregate(every, F.array().cast(f"array<{kind}>"), step)


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens_col: str | None = None, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, window, formatted, n_repeated, loss, n_tokens, estimated) by block and window of a conversation.

    loss holds (start, length) of the spans under the mask, 1-based code points; ``estimated`` says that n_tokens is no real count.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.col(tokens_col).cast("bigint").alias("tokens")] if tokens_col else []))
    if not tokens_col:
        rows = rows.withColumn("tokens", (F.octet_length("text") / 4).cast("long") + 8)
    rows = _blocks(rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block).cast("long"), F.lit(_NO_TURN))))
    order = Window.partitionBy("conv_id", "block").orderBy("own", "turn", "role", "text")
    rows = rows.withColumns({"n": F.row_number().over(order), "upto": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    grouped = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("n", "own", "tokens", "upto", "role", "text"))).alias("turns"))
    head = F.get("turns", F.lit(0))
    # A block that no carried turn opens is a conversation's first, so its first turn is the conversation's.
    grouped = grouped.withColumn("system", head["role"] == "system")
    cut = grouped.withColumn("spans", _spans(budget, history))
    part = lambda t, new: F.struct(t["role"].alias("role"), new.alias("new"), F.concat(F.lit(OPEN), escape(t["role"]), F.lit(ROLE_END)).alias("lead"), escape(t["text"]).alias("body"))
    nothing = F.slice(F.col("turns"), 1, 0)

    def window(s: Column, i: Column) -> Column:
        repeated = F.concat(F.when(s["head"], F.slice("turns", 1, 1)).otherwise(nothing), F.slice("turns", s["from"] - s["history"] + 1, s["history"]))
        new = F.slice("turns", s["from"] + 1, s["to"] - s["from"])
        parts = F.concat(F.transform(repeated, lambda t: part(t, F.lit(False))), F.transform(new, lambda t: part(t, F.lit(True))))
        return F.struct(i.cast("long").alias("window"), s["tokens"].alias("tokens"), parts.alias("parts"))

    each = cut.select("conv_id", "block", F.explode(F.transform("spans", window)).alias("w"))
    parts = F.col("w.parts")
    formatted = F.array_join(F.transform(parts, lambda p: F.concat(p["lead"], p["body"], F.lit(CLOSE))), "")
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    step = lambda a, p: F.struct(
        (a["at"] + F.length(p["lead"]) + F.length(p["body"]) + len(CLOSE)).alias("at"),
        F.when((p["role"] == "assistant") & p["new"], F.concat(a["loss"], F.array(F.struct((a["at"] + F.length(p["lead"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(a["loss"]).alias("loss"),
    )
    loss = F.aggregate(parts, start, step, lambda a: a["loss"])
    return each.select("conv_id", "block", F.col("w.window").alias("window"), formatted.alias("formatted"), F.size(F.filter(parts, lambda p: ~p["new"])).alias("n_repeated"), loss.alias("loss"), F.col("w.tokens").alias("n_tokens"), F.lit(tokens_col is None).alias("estimated"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from the windows' text and masks alone: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    turns = F.split(F.col("formatted"), F.lit(CLOSE))
    new = F.slice(turns, F.col("n_repeated") + 1, F.greatest(F.lit(0), F.size(turns) - 1 - F.col("n_repeated")))
    role = lambda t: unescape(F.substring(F.split_part(t, F.lit(ROLE_END), F.lit(1)), len(OPEN) + 1, 1 << 30))
    text = lambda t: unescape(F.substring(t, F.length(F.split_part(t, F.lit(ROLE_END), F.lit(1))) + len(ROLE_END) + 1, F.length(t)))
    told = F.array_join(F.transform(new, lambda t: F.concat(role(t), F.lit("\n"), text(t), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"]))), "")
    rows = formatted.select("conv_id", "block", "window", F.size(new).cast("long").alias("n"), told.alias("told"), loss.alias("said"), F.length("formatted").cast("long").alias("chars"))
    by = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("block", "window", "told", "said"))).alias("w"))
    told, said = F.array_join(F.transform("w", lambda x: x["told"]), ""), F.array_join(F.transform("w", lambda x: x["said"]), "")
    return by.select("conv_id", "n_turns", F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length(said).cast("long").alias("loss_chars"), F.sha2(said.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
