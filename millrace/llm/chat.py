"""Chat formatting in budgeted windows (operator 4). DataFrame functions only.

Every turn costs ``MARKS`` tokens and one for each run of up to four letters or digits and each other sign.
Prefix sums of these counts place a turn on a grid of ``stride`` tokens; the turns that start in one cell are the
fresh turns of one window. The stride is half of what the budget leaves beside history and system turn, so the
overhang of a cell's last turn fits as well; only a turn longer than the stride (or a system turn longer than its
reserve) makes a longer window, for turns are never cut. Each later window begins with the conversation's system
turn (its first turn, if the role is "system") and the turns that lie wholly in the last ``history`` tokens before
its first fresh turn. Repeated turns are not targets: the loss mask holds the texts of fresh assistant turns only.

Template: ``<|role|>role<|text|>text<|end|>`` for every turn. Inside roles and texts a backslash is doubled, and
one is put into control strings (after the ``<`` of ``<|``, ``</`` and ``<s``, after the ``[`` of ``[INST]`` and
``[/INST]``), so no text can hold a mark and reading back is exact.

Prefix sums are taken within blocks of ``BLOCK`` turn numbers and carried over by one small row for each block, so
a very long conversation is spread over tasks; a window holds a bounded number of turns.

Defined results: null roles and texts are empty; null turns come first; turns of one number are ordered by role
and text; repeated rows are repeated turns. A null conversation id is one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import cut

BUDGET, HISTORY, RESERVE = 1024, 128, 128
STRIDE = (BUDGET - HISTORY - RESERVE) // 2
MARKS, BLOCK = 4, 4096
PIECE = r"[\p{L}\p{N}]{1,4}|[^\p{L}\p{N}\s]"
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"


def escaped(s: Column) -> Column:
    doubled = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, r"<([|/s])", r"<\\$1"), r"\[(/?INST\])", r"[\\$1")


def unescaped(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)\\(.)", "$1")


def placed(conversations: DataFrame) -> DataFrame:
    """c, role, text, pos (from 1), start, cell, system: turns on the grid."""
    rows = conversations.select(
        F.struct("conv_id").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumns({
        "tokens": F.regexp_count("text", F.lit(PIECE)) + MARKS, "block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))),
    })
    blocks = rows.groupBy("c", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"))
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("c", "block", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in ("n", "sum")])
    within = Window.partitionBy("c", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.join(carried, ["c", "block"]).select(
        "c", "role", "text", (F.row_number().over(within) + F.col("n_before")).alias("pos"),
        (F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens") + F.col("sum_before")).alias("start"),
    ).withColumns({"cell": F.floor(F.col("start") / STRIDE), "system": (F.col("pos") == 1) & (F.col("role") == "system")})


def windows(conversations: DataFrame) -> DataFrame:
    """conv_id, cell (orders the windows), formatted, fresh (a flag for each turn), loss (spans of characters, end exclusive)."""
    turns = cut(placed(conversations), "turns")
    cells = turns.groupBy("c", "cell").agg(F.min("start").alias("first"), F.min("pos").alias("from"))
    own = turns.select("c", "cell", "pos", F.lit(True).alias("fresh"), "role", "text")
    last = F.floor((F.col("start") + HISTORY) / STRIDE)
    reached = turns.where(~F.col("system") & (last > F.col("cell"))).select("c", "start", "pos", "role", "text", F.explode(F.sequence(F.col("cell") + 1, last)).alias("cell"))
    again = reached.join(cells, ["c", "cell"]).where(F.col("first") - F.col("start") <= HISTORY).select("c", "cell", "pos", F.lit(False).alias("fresh"), "role", "text")
    heads = turns.where("system").select("c", "pos", "role", "text")
    headed = cells.where(F.col("from") > 1).join(heads, "c").select("c", "cell", "pos", F.lit(False).alias("fresh"), "role", "text")
    packed = own.union(again).union(headed).groupBy("c", "cell").agg(F.sort_array(F.collect_list(F.struct("pos", "fresh", "role", "text"))).alias("turns"))
    marked = packed.select("c", "cell", F.transform("turns", lambda t: F.struct(
        t["fresh"].alias("fresh"), (t["fresh"] & (t["role"] == "assistant")).alias("target"),
        F.concat(F.lit(ROLE), escaped(t["role"]), F.lit(TEXT)).alias("head"), escaped(t["text"]).alias("body"),
    )).alias("turns"))

    def spans(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(t["target"], F.concat(state["spans"], one)).otherwise(state["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return marked.select(
        F.col("c.conv_id").alias("conv_id"), "cell", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform("turns", lambda t: t["fresh"]).alias("fresh"),
        F.aggregate("turns", F.struct(F.lit(0).alias("at"), none.alias("spans")), spans)["spans"].alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, cell, turns (fresh ones: role and text), targets (texts under the loss mask) from the output of ``windows``."""
    pieces = F.split("formatted", r"<\|end\|>")
    numbered = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p, i: F.struct(i.alias("i"), F.split(F.substr(p, F.lit(len(ROLE) + 1)), r"<\|text\|>").alias("p")))
    fresh = F.filter(numbered, lambda x: F.get("fresh", x["i"]))
    return formatted.select(
        "conv_id", "cell", "formatted",
        F.transform(fresh, lambda x: F.struct(unescaped(F.get(x["p"], F.lit(0))).alias("role"), unescaped(F.get(x["p"], F.lit(1))).alias("text"))).alias("turns"),
        F.transform("loss", lambda s: unescaped(F.substr("formatted", s["start"] + 1, s["end"] - s["start"]))).alias("targets"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation. A hash of a whole conversation needs it in one cell; the windows do not."""
    said = read_back(formatted).select(
        "conv_id", "cell", F.size("turns").alias("n"), F.length("formatted").alias("chars"), F.array_join("targets", "").alias("loss"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("told"),
    )
    joined = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("cell", "told", "loss"))).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    whole = joined.withColumns({k: F.array_join(F.col("parts").getField(k), "") for k in ("told", "loss")})
    return whole.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2("told", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
