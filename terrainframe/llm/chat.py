"""Chat formatting in budgeted windows. DataFrame functions only.

Prefix sums of the turns' tokens choose spans of whole turns that fit the budget; every window after the first repeats the
system turn (a first turn with that role) and as many turns before its span as fit the history budget. A turn's tokens are
those of a column that the caller names (counted by any tokenizer, as ``token_counts`` does), or else an estimate: a word counts one for each
``LETTERS`` letters, a number one for each three digits, a mark one. Each turn costs ``OVERHEAD`` more for its marks. Targets are the texts of assistant turns; those that are repeated as history are masked, so each is a
target once. A turn larger than the budget is a window of its own, never cut.

Template: ``<turn>role<text>text</turn>``. Inside roles and texts a backslash becomes two and ``<`` becomes ``\\l``, so no
marker can appear there, and reading back is exact.

Plan: one exchange by conversation, shared by the prefix sums and the gathering of turns. A conversation is one training
unit whose digest needs it whole, so its turns meet in one row.

Edge cases: null role and null text are empty; turns with equal numbers go by role, then text; repeated rows are turns of
their own; a null conversation id is a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrainframe.llm.common import let

BUDGET, HISTORY, OVERHEAD, LETTERS = 2048, 256, 3, 5


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Double backslashes are split off first, so what is left of ``\\l`` is an escape."""
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\l"), F.lit("<"))), "\\")


def tokens(text: Column) -> Column:
    """Parts of words and numbers, and marks, as an estimate of length."""
    return F.regexp_count(text, F.lit(rf"\p{{L}}{{1,{LETTERS}}}|\p{{N}}{{1,3}}|[^\s\p{{L}}\p{{N}}]"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens_col: str | None = None) -> DataFrame:
    """conv_id, window, formatted, n_repeated (leading turns that are repeated), loss (start and length in code points)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = tokens(text).cast("long") if tokens_col is None else F.greatest(F.coalesce(F.col(f"`{tokens_col}`").cast("long"), F.lit(0)), F.lit(0))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (n + OVERHEAD).alias("n"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    summed = turns.withColumns({"after": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "i": F.row_number().over(order)})
    turn = F.struct("i", "role", F.concat(F.lit("<turn>"), escape(F.col("role")), F.lit("<text>")).alias("head"), escape(F.col("text")).alias("body"), "n", "after")
    gathered = summed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    system = F.col("t")[0]["role"] == "system"
    extra = F.when(system, F.col("t")[0]["n"]).otherwise(0) + history

    def step(done: Column, t: Column) -> Column:
        room = budget - F.when(F.size(done.starts) == 1, 0).otherwise(extra)
        fits = (t.after - done.base <= room) | (t.i - 1 == done.last)
        return F.when(fits, done).otherwise(F.struct(F.concat(done.starts, F.array(t.i - 1)).alias("starts"), (t.i - 1).alias("last"), (t.after - t.n).alias("base")))

    first = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("last"), F.lit(0).cast("long").alias("base"))
    chosen = gathered.withColumn("starts", F.aggregate("t", first, step, lambda done: done.starts))
    begin = lambda i: F.get(F.col("t"), i)["after"] - F.get(F.col("t"), i)["n"]

    def window(s: Column, k: Column) -> Column:
        low = F.greatest(F.when(system, 1).otherwise(0), s - history // OVERHEAD)
        near = F.filter(F.sequence(F.least(low, s), s), lambda j: begin(s) - begin(j) <= history)
        end = F.coalesce(F.get(F.col("starts"), k + 1), F.size("t"))
        back = F.slice(F.col("t"), near[0] + 1, s - near[0])
        again = F.when(k == 0, F.slice(F.col("t"), 1, 0)).otherwise(F.concat(F.when(system, F.slice(F.col("t"), 1, 1)).otherwise(F.slice(F.col("t"), 1, 0)), back))
        return F.struct(k.alias("window"), again.alias("again"), F.slice(F.col("t"), s + 1, end - s).alias("own"))

    exploded = chosen.select("conv_id", F.explode(F.transform("starts", window)).alias("w"))
    shown = lambda t: F.concat(t.head, t.body, F.lit("</turn>"))
    none = F.array().cast("array<struct<start:long,length:long>>")
    text_of = lambda turns: F.array_join(F.transform(turns, shown), "")

    def target(done: Column, t: Column) -> Column:
        at = done.at + F.length(t.head)
        own = F.struct(at.cast("long").alias("start"), F.length(t.body).cast("long").alias("length"))
        return F.struct((at + F.length(t.body) + 7).cast("long").alias("at"), F.when(t.role == "assistant", F.concat(done.loss, F.array(own))).otherwise(done.loss).alias("loss"))

    start = lambda lead: F.struct(F.length(lead).cast("long").alias("at"), none.alias("loss"))
    return exploded.select(
        "conv_id", "w.window", F.size("w.again").alias("n_repeated"),
        F.concat(text_of(F.col("w.again")), text_of(F.col("w.own"))).alias("formatted"),
        F.aggregate("w.own", start(text_of(F.col("w.again"))), target, lambda done: done.loss).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows hold, from their text and masks alone: conv_id, turns (role, text), loss_text, formatted_chars."""
    parts = F.slice(F.split("formatted", "</turn>", -1), F.col("n_repeated") + 1, F.size(F.split("formatted", "</turn>", -1)) - 1 - F.col("n_repeated"))
    parsed = F.transform(parts, lambda p: let(F.split(p, "<text>", 2), lambda x: F.struct(unescape(F.substring(x[0], 7, 1 << 30)).alias("role"), unescape(x[1]).alias("text"))))
    target = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int")))), "")
    each = formatted.select("conv_id", F.struct("window", parsed.alias("turns"), target.alias("target"), F.length("formatted").cast("long").alias("chars")).alias("w"))
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    return whole.select(
        "conv_id", F.flatten(F.transform("w", lambda x: x.turns)).alias("turns"), F.array_join(F.transform("w", lambda x: x.target), "").alias("loss_text"),
        F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + x.chars).alias("formatted_chars"),
    )
