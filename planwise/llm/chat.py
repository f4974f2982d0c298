"""Chat formatting in budgeted windows. DataFrame functions only.

A conversation's turns become `<|im_start|>role\\ntext<|im_end|>\\n`, with the characters that begin
control strings escaped inside roles and texts, reversibly. Prefix sums of the turns' tokens deal
them to spans of a token budget at turn boundaries: a turn belongs to the span in which it begins.
A window shows a span, after the conversation's system turn and those earlier turns that fit the
history budget; both are repeats. The loss mask covers an assistant text in its own span only, so
each is a target once. A turn longer than the budget is a window of its own, never cut.

Null roles and texts are empty ones. Turns with null numbers come first; equal numbers are ordered
by role and text. A null conv_id is a conversation of its own. Repeated rows are repeated turns.
Only a first turn of role system is retained. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, never_null, running_total

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens of a span and of the history before it, and turns that one window function orders at a time.
BUDGET, HISTORY, CHUNK = 1024, 256, 1024
#: Fixed values of the escape: every control string begins with < or [.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))


def escape(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    for plain, escaped in reversed(ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def tokens(text: Column) -> Column:
    """An estimate without a tokenizer: a token for every four characters begun."""
    return F.ceil(F.char_length(text) / 4).cast("long")


def turns(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, begins (tokens before the turn), place (its own number), role, body (formatted), span."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("body", F.concat(F.lit(START), escape(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END)))
    rows = rows.withColumns({"_t": tokens(F.col("body")), "_n": F.lit(1).cast("long")})
    rows = running_total(rows, ["conv_id"], F.floor(F.col("turn") / CHUNK), ["turn", "role", "text"], {"begins": "_t", "place": "_n"})
    return rows.withColumn("span", F.floor(F.col("begins") / budget)).select("conv_id", "begins", "place", "role", "body", "span")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, span, formatted, repeats (turns at its head that other windows have too), loss (array of start and end, in code points)."""
    assert history <= budget, "a turn is history of one window at most"
    rows = materialize(turns(conversations, budget, history), "chat-turns")  # texts are ordered once, whatever reads them
    spans = rows.groupBy("conv_id", "span").agg(F.min("begins").alias("_start"), F.min("place").alias("_first"))
    following = Window.partitionBy("conv_id").orderBy("span")
    spans = spans.select(F.col("conv_id").alias("_c"), F.col("span").alias("_s"), F.lead("span").over(following).alias("_next"), F.lead("_start").over(following).alias("_next_start"))
    rows = rows.join(spans, (never_null(F.col("conv_id")) == never_null(F.col("_c"))) & (F.col("span") == F.col("_s")))
    system = (F.col("place") == 0) & (F.col("role") == "system")
    recalled = F.col("_next").isNotNull() & (F.col("_next_start") - F.col("begins") <= history) & ~system
    shown = F.concat(
        F.array(F.struct(F.col("span").alias("window"), F.lit(False).alias("repeat"))),
        F.when(recalled, F.array(F.struct(F.col("_next").alias("window"), F.lit(True).alias("repeat")))).otherwise(F.array()),
    )
    shown_rows = rows.withColumn("_w", F.explode(shown)).select("conv_id", "_w.window", "_w.repeat", "place", "role", "body")
    # A system turn is shown again in every later window of its conversation.
    retained = rows.where(system).select(F.col("conv_id").alias("_c2"), F.col("span").alias("_own"), F.col("place"), "role", "body")
    later = spans.select("_c", "_s").join(retained, F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_s") > F.col("_own")))
    shown_rows = shown_rows.union(later.select(F.col("_c").alias("conv_id"), F.col("_s").alias("window"), F.lit(True).alias("repeat"), "place", "role", "body"))
    parts = shown_rows.groupBy("conv_id", F.col("window").alias("span")).agg(F.array_sort(F.collect_list(F.struct("place", "repeat", "role", "body"))).alias("_p"))
    # Where each turn starts in the window: a running sum of lengths.
    ends = F.aggregate("_p", F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.char_length(p["body"]))))
    loss = F.transform(
        F.filter(F.arrays_zip(F.col("_p").alias("p"), F.col("_e").alias("e")), lambda x: ~x["p"]["repeat"] & (x["p"]["role"] == "assistant")),
        lambda x: F.struct((x["e"] - F.char_length(x["p"]["body"]) + len(START) + len("assistant\n")).alias("start"), (x["e"] - len(END)).alias("end")),
    )
    return parts.withColumn("_e", ends).select(
        "conv_id", "span", F.array_join(F.transform("_p", lambda p: p["body"]), "").alias("formatted"), F.size(F.filter("_p", lambda p: p["repeat"])).alias("repeats"), loss.alias("loss")
    )


def read_turns(formatted: Column, repeats: Column) -> Column:
    """The window's own turns, from its text alone: an array of role and text."""
    bodies = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    own = F.slice(bodies, repeats + 1, F.greatest(F.size(bodies) - repeats, F.lit(0)))
    inner = F.transform(own, lambda b: F.substr(b, F.lit(len(START) + 1)))
    return F.transform(inner, lambda b: F.struct(unescape(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substr(b, F.instr(b, "\n") + 1)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digests(shown: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows: read back from the windows."""
    read = shown.select(
        "conv_id", "span", read_turns(F.col("formatted"), F.col("repeats")).alias("t"), read_loss(F.col("formatted"), F.col("loss")).alias("l"), F.char_length("formatted").cast("long").alias("c")
    )
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    whole = read.select("conv_id", "span", F.size("t").cast("long").alias("n"), said.alias("s"), "l", "c").groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("span", "s", "l"))).alias("w"), F.sum("c").alias("formatted_chars"), F.count("*").alias("n_windows")
    )
    all_turns, all_loss = (F.array_join(F.transform("w", lambda x: x[k]), "") for k in ("s", "l"))
    return whole.select(
        "conv_id", "n_turns", F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"), F.char_length(all_loss).cast("long").alias("loss_chars"),
        F.sha2(all_loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
