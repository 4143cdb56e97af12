"""Chat formatting in budgeted windows, as native expressions: one shuffle by conversation, no Python.

Prefix sums of turn tokens cut a conversation into spans of whole turns: a span ends where the sum passes a multiple of
half the room, and a turn of more than half the room has a span of its own. So a span fits into the room, unless one turn
alone doesn't (it is never cut; the window is then marked). Each window holds the system turn, the last turns of the
span before it within ``history`` tokens, and its span. Turns that a former window held already are repeated: they are
never under the loss mask. The prefix sums are window functions, which stream and spill; windows are small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TOKEN = "[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\r\\n]"
MARKUP = 4  # tokens that a turn takes besides its text


def escape(text: Column) -> Column:
    """A backslash more in every ``<\\...|``: control strings start with ``<|``, so none is left inside a text."""
    return F.regexp_replace(text, F.lit(r"<(\\*)\|"), F.lit(r"<\\$1|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<\\(\\*)\|"), F.lit("<$1|"))


def tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(0))).cast("long") + MARKUP


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 192, counts: str | None = None) -> DataFrame:
    """(conv_id, window, formatted, mask, fresh, n_tokens, over_budget), windows from 1.

    ``formatted`` marks turns as START role, newline, text, END, the role URL-encoded and the text escaped; ``mask`` has
    (start, length), in code points of ``formatted``, of each assistant text that isn't repeated; ``fresh`` tells for each
    turn whether it is there for the first time. A null role or text counts as empty, a null turn comes first, a null
    conv_id is a conversation; rows of one turn go by role, then text, and repeated rows are turns of their own. A system
    turn is kept for all windows if it is the first. Tokens are words and single marks (``TOKEN``), a stand-in for those of
    a model; a column ``counts`` of ``turns`` gives others. Texts of any length and conversations of any number of turns are taken
    whole. Other columns, of any names, aren't read; an empty table gives no rows.
    """
    n = tokens(F.coalesce(F.col("text").cast("string"), F.lit(""))) if counts is None else F.col(counts).cast("long") + MARKUP
    rows = turns.select("conv_id", "turn", n.alias("n"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    conv = W.partitionBy("conv_id")
    by_turn = conv.orderBy("turn", "role", "text")
    so_far = by_turn.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("at", F.row_number().over(by_turn))
    rows = rows.withColumn("system", (F.col("at") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("own", F.when(F.col("system"), 0).otherwise(F.col("n")))
    rows = rows.withColumn("after", F.sum("own").over(so_far)).withColumn("before", F.col("after") - F.col("own"))
    rows = rows.withColumn("head", F.max(F.when(F.col("system"), F.col("n")).otherwise(0)).over(so_far))
    rows = rows.withColumn("half", F.ceil(F.greatest(F.lit(budget - history) - F.col("head"), F.lit(2)) / 2))
    rows = rows.withColumn("bucket", F.floor(F.col("before") / F.col("half"))).withColumn("alone", F.col("own") > F.col("half"))
    cut = F.col("system") | F.coalesce((F.col("bucket") == F.lag("bucket").over(by_turn)) & ~F.col("alone") & ~F.lag("alone").over(by_turn) & ~F.lag("system").over(by_turn), F.lit(False))
    rows = rows.withColumn("cut", F.when(cut, 0).otherwise(1)).withColumn("span", F.greatest(F.sum("cut").over(so_far), F.lit(1)))
    rows = rows.withColumn("spans", F.max("span").over(conv)).withColumn("stop", F.max("after").over(W.partitionBy("conv_id", "span")))

    member = lambda s, fresh: F.struct(s.cast("long").alias("window"), fresh.alias("fresh"))
    again = ~F.col("system") & (F.col("span") < F.col("spans")) & (F.col("stop") - F.col("before") <= history)
    everywhere = F.transform(F.sequence(F.lit(1).cast("long"), F.col("spans")), lambda s: member(s, s == 1))
    here = F.array(member(F.col("span"), F.lit(True)))
    members = F.when(F.col("system"), everywhere).when(again, F.concat(here, F.array(member(F.col("span") + 1, F.lit(False))))).otherwise(here)
    dealt = rows.select("conv_id", "at", "role", "text", "n", F.explode(members).alias("m")).select("conv_id", "m.*", "at", "role", "text", "n")
    whole = dealt.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("at", "fresh", "role", "text"))).alias("turns"), F.sum("n").alias("n_tokens"))
    parts = F.transform("turns", lambda t: F.struct(t["fresh"].alias("fresh"), (t["role"] == "assistant").alias("target"), F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n")).alias("lead"), escape(t["text"]).alias("text")))
    whole = whole.select("conv_id", "window", "n_tokens", parts.alias("parts"))
    # a fold over the places of the few turns of a window
    span_type = "array<struct<start:int,length:int>>"

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["lead"])
        own = F.struct(start.alias("start"), F.length(p["text"]).alias("length"))
        return F.struct((start + F.length(p["text"]) + len(END)).alias("at"), F.when(p["fresh"] & p["target"], F.concat(acc["mask"], F.array(own))).otherwise(acc["mask"]).alias("mask"))

    mask = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.array().cast(span_type).alias("mask")), step, lambda acc: acc["mask"])
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["lead"], p["text"], F.lit(END))), "")
    return whole.select("conv_id", "window", formatted.alias("formatted"), mask.alias("mask"), F.transform("parts", lambda p: p["fresh"]).alias("fresh"), "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"))


def read_windows(windows: DataFrame) -> DataFrame:
    """What the formatted text says: (conv_id, window, formatted, turns, targets); turns are structs (role, text, fresh)."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)

    def turn(piece: Column, i: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END))
        return F.struct(F.url_decode(role).alias("role"), unescape(text).alias("text"), F.get("fresh", i).alias("fresh"))

    targets = F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"])))
    return windows.select("conv_id", "window", "formatted", F.transform(pieces, turn).alias("turns"), targets.alias("targets"))
