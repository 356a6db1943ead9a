"""Chat formatting in budgeted windows of whole turns.  DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.llm.common import bare, cut, table

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
#: Control strings and how they stand inside a text, after each backslash there is doubled.
ESCAPES = [("</turn>", r"<\/turn>"), ("### ", r"#\## ")]
TOKEN = r"[^\x20\x09-\x0D]+"
BLOCK = 256      # turn numbers of one block of the prefix sums
CASES = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, and of the earlier turns that it may repeat."""

    window: int = 512
    history: int = 128
    target: str = "assistant"
    system: str = "system"

    @property
    def least(self) -> int:
        """Tokens left for new turns, however long the system turn is; at least the history."""
        return max(self.history, self.window // 4, 1)


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, inside in ESCAPES:
        text = F.replace(text, F.lit(control), F.lit(inside))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escaped_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(COLON), F.lit(":\\ "))


def _turns(conversations: DataFrame) -> DataFrame:
    rows = bare(conversations, "conv_id", "turn", "role", "text")
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    head = F.concat(F.lit(OPEN), _escaped_role(F.col("role")), F.lit(COLON))
    rows = rows.withColumns({
        # keys that are never null
        "conv": F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit("")),
        "block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1 << 62)),
        "head": head, "body": escape(F.col("text")),
    })
    return rows.withColumn("tokens", F.regexp_count(F.concat("head", "body", F.lit(CLOSE)), F.lit(TOKEN)).cast("long"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``no``, from 1, and ``start``, the tokens before the turn, in its conversation.

    Sums run inside blocks of turn numbers and over the blocks' sums, so that a conversation of any length is
    spread over tasks."""
    inside = W.partitionBy("conv", "block").orderBy("turn", "role", "text")
    rows = rows.withColumns({
        "in_no": F.row_number().over(inside),
        "in_start": F.sum("tokens").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens"),
    })
    before = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    zero = F.lit(0).cast("long")
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("n").over(before), zero).alias("n0"), F.coalesce(F.sum("t").over(before), zero).alias("t0"))
    return rows.join(blocks, ["conv", "block"]).withColumns({"no": F.col("n0") + F.col("in_no"), "start": F.col("t0") + F.col("in_start")}).drop("in_no", "in_start", "n0", "t0", "block")


def format_windows(conversations: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """conv_id, window, text, repeated, n_turns, n_tokens, loss of every window.

    Turns are laid on a line by the prefix sums of their tokens, the line is cut in cells of the budget less the
    system turn and the history.  The turns inside a cell are a window; a turn across an edge is a window of
    its own.  So every window holds whole turns and, unless one turn alone is longer, at most the budget.  A
    window begins with the conversation's first turn if that is a system turn, then the last turns before it that
    begin within the history; these ``repeated`` turns are context.  ``loss`` has the (start, stop) code points of
    the new assistant texts.  ``window`` orders a conversation's windows and has gaps.

    Turns are ordered by number, then role, then text, nulls first; repeated rows are turns of their own.  A null text
    or role is empty; rows with a null conv_id are one conversation.  Cells bound what meets in a group; only a
    single turn can make a window longer.
    """
    # the prefix sums are computed once; every later step reads the numbered turns
    turns = cut(_numbered(_turns(conversations)).drop("text", "turn"))
    first = turns.filter((F.col("no") == 1) & (F.col("role") == budget.system))
    first = first.select("conv", F.col("tokens").alias("system_tokens"), F.struct("head", "body").alias("system"))
    turns = turns.join(first.select("conv", "system_tokens"), "conv", "left")
    spent = F.coalesce("system_tokens", F.lit(0).cast("long"))
    size = F.greatest(F.lit(budget.window - budget.history) - spent, F.lit(budget.least).cast("long"))
    turns = turns.withColumns({"size": size, "is_system": (F.col("no") == 1) & F.col("system_tokens").isNotNull(), "start": F.col("start") - spent})
    others = turns.filter(~F.col("is_system"))
    cell, last = F.floor(F.col("start") / F.col("size")), F.floor((F.col("start") + F.col("tokens") - 1) / F.col("size"))
    others = others.withColumn("window", F.when(last > cell, 2 * last).otherwise(2 * cell + 1))
    turn = F.struct("no", "head", "body", (F.col("role") == budget.target).alias("target"), "tokens")
    fresh = others.select("conv", "conv_id", "window", F.lit(2).alias("part"), turn.alias("turn"))
    begins = others.groupBy("conv", "conv_id", "window", "size").agg(F.min("start").alias("begin"))
    places = begins.withColumn("cell", F.floor(F.col("begin") / F.col("size"))).drop("size")
    reach = F.explode(F.sequence(F.floor(F.col("start") / F.col("size")), F.floor((F.col("start") + budget.history) / F.col("size"))))
    earlier = others.select("conv", "start", reach.alias("cell"), turn.alias("turn")).join(places, ["conv", "cell"])
    earlier = earlier.filter((F.col("start") < F.col("begin")) & (F.col("start") >= F.col("begin") - budget.history))
    earlier = earlier.select("conv", "conv_id", "window", F.lit(1).alias("part"), "turn")
    opening = begins.groupBy("conv").agg(F.min("window").alias("first_window"))
    alone = turns.filter("is_system").join(opening, "conv", "left")
    # the system turn is new in the first window, or in one of its own if it has no other turns
    once = alone.select("conv", "conv_id", F.coalesce("first_window", F.lit(0)).alias("window"), F.lit(2).alias("part"), turn.alias("turn"))
    again = begins.join(alone.select("conv", "first_window", turn.alias("turn")), "conv").filter("window <> first_window")
    again = again.select("conv", "conv_id", "window", F.lit(0).alias("part"), "turn")
    every = fresh.unionByName(earlier).unionByName(once).unionByName(again)
    windows = every.groupBy("conv", "conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("part", "turn"))).alias("turns"))
    written = lambda x: F.concat(x["turn"]["head"], x["turn"]["body"], F.lit(CLOSE))

    def mask(a, x):
        begin = a["at"] + F.length(x["turn"]["head"])
        stop = begin + F.length(x["turn"]["body"])
        span = F.array(F.struct(begin.alias("start"), stop.alias("stop")))
        return F.struct(
            (stop + F.lit(len(CLOSE))).alias("at"),
            F.when((x["part"] == 2) & x["turn"]["target"], F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    none = F.expr("cast(array() AS array<struct<start:int,stop:int>>)")
    return windows.select(
        "conv_id", "window",
        F.array_join(F.transform("turns", written), "").alias("text"),
        F.size(F.filter("turns", lambda x: x["part"] < 2)).alias("repeated"),
        F.size("turns").alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["turn"]["tokens"]).alias("n_tokens"),
        F.aggregate("turns", F.struct(F.lit(0).alias("at"), none.alias("out")), mask, lambda a: a["out"]).alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """``windows`` with ``turns`` (role, text), the new turns parsed from the text, and ``targets``, the texts under the loss mask."""
    parts = F.split("text", r"</turn>\n", -1)
    new = F.slice(parts, F.col("repeated") + 1, F.col("n_turns") - F.col("repeated"))

    def parse(part):
        rest = F.substring(part, len(OPEN) + 1, 1 << 30)
        role = F.substring_index(rest, COLON, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(rest, F.length(role) + len(COLON) + 1, F.lit(1 << 30))).alias("text"))

    return windows.withColumns({
        "turns": F.transform(new, parse),
        "targets": F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["stop"] - s["start"]))),
    })


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what ``format_windows`` makes of all conversations and of two turns of control strings."""
    rows = bare(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    cases = spark.createDataFrame(CASES, "conv_id long, turn long, role string, text string")
    read = read_back(format_windows(rows.unionByName(cases)))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    each = read.select(
        "conv_id", "window", F.size("turns").cast("long").alias("n"), F.array_join(line, "").alias("said"),
        F.array_join("targets", "").alias("learned"), F.length("text").cast("long").alias("chars"))
    whole = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return (
        each.groupBy("conv_id")
        .agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"),
             F.array_sort(F.collect_list(F.struct("window", "said", "learned"))).alias("parts"))
        .select("conv_id", "n_turns", F.sha2(whole("said"), 256).alias("turns_sha256"), F.length(whole("learned")).cast("long").alias("loss_chars"),
                F.sha2(whole("learned"), 256).alias("loss_sha256"), "formatted_chars", "n_windows"))
