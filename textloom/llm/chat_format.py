"""Chat formatting: conversations rebuilt from event logs, and a template that can be read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running_sums

# The template: <s> role [INST] text [/INST] </s> for each turn.
OPEN, HEAD, TAIL, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (OPEN, CLOSE, HEAD, TAIL)

#: Turns folded into one string before a conversation's strings are joined.
BLOCK = 256
#: Characters of the pieces in which a conversation's string is read back.
PIECE = 4096


def escape(text: Column) -> Column:
    """text in which no control string occurs: backslashes doubled, one put after the first character of a control string."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    """What escape() was given."""
    for c in CONTROLS:
        text = F.replace(text, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def fold_events(events: DataFrame, *, conv: str = "conv_id", seq: str = "seq", message: str = "message", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """Final messages (conv, turn, role, text) of an event log.

    Kinds: ``message`` and ``edit`` set a message's text, ``delta`` adds to it,
    ``regenerate`` empties it for the deltas that follow, ``delete`` takes the
    message out. Events count in the order of their conversation's seq, ties in
    that of kind and text. The log is partitioned by conversation and message,
    so that a conversation of any length spreads over tasks, and each part is
    sorted by the conversation's sequence. A message's turn is the seq of its first event, its role the first
    that isn't null. Null texts are empty; unknown or null kinds add nothing;
    repeated rows count as often as they occur.
    """
    step = F.struct(F.col(seq).alias("seq"), F.col(kind).alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(role).alias("role"))
    folded = events.groupBy(F.col(conv).alias("_conv"), F.col(message).alias("_message")).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    resets = F.array(*[F.lit(x) for x in ("message", "edit", "regenerate", "delete")])
    last = F.array_max(F.transform("_steps", lambda x, k: F.when(F.array_contains(resets, x["kind"]), k)))
    live = folded.withColumn("_last", F.coalesce(last, F.lit(-1)))
    texts = F.filter(live["_steps"], lambda x, k: (k >= F.col("_last")) & x["kind"].isin("message", "edit", "delta"))
    gone = F.get("_steps", F.col("_last"))["kind"].eqNullSafe("delete")
    roles = F.filter("_steps", lambda x: x["role"].isNotNull())
    return live.where((F.col("_last") < 0) | ~gone).select(
        F.col("_conv").alias(conv), F.get("_steps", F.lit(0))["seq"].alias("turn"), F.get(roles, F.lit(0))["role"].alias("role"), F.array_join(F.transform(texts, lambda x: x["text"]), "").alias("text")
    )


def render(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: id, formatted, loss_spans.

    Turns follow each other by turn, then role and text. loss_spans has the
    (start, stop) code points of each assistant text in formatted. Null roles
    and texts are empty. Turns are first folded in blocks of BLOCK, so that a
    long conversation is put together from a few strings and no task gathers
    its rows; the strings themselves are as long as its text, which is what
    the result holds.
    """
    body = F.concat(F.lit(OPEN), escape(F.col(role)), F.lit(HEAD), escape(F.col(text)), F.lit(TAIL + CLOSE))
    rows = messages.select(F.col(conv).alias("_conv"), F.expr(f"`{turn}` div {BLOCK}").alias("_block"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), body.alias("body")).alias("_turn"))
    blocks = rows.groupBy("_conv", "_block").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    joined = F.array_join(F.transform("_turns", lambda x: x["body"]), "")
    turns = F.transform("_turns", lambda x: F.struct(x["role"].alias("role"), F.length(x["body"]).alias("n"), (F.length(escape(x["role"])) + len(OPEN + HEAD)).alias("lead")))
    blocks = blocks.select("_conv", F.struct(F.col("_block").alias("block"), joined.alias("text"), turns.alias("turns")).alias("_b"))
    whole = blocks.groupBy("_conv").agg(F.array_sort(F.collect_list("_b")).alias("_bs"))

    def masked(turns: Column) -> Column:
        starts = running_sums(F.transform(turns, lambda x: x["n"]))
        spot = lambda at: F.transform(turns, lambda x, k: F.struct(x["role"].alias("role"), (F.get(at, k) + x["lead"]).cast("int").alias("start"), (F.get(at, k) + x["n"] - len(TAIL + CLOSE)).cast("int").alias("stop")))
        learnt = lambda all_turns: F.filter(all_turns, lambda x: x["role"] == "assistant")
        return F.transform(let(starts, lambda at: learnt(spot(at))), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))

    formatted = F.array_join(F.transform("_bs", lambda b: b["text"]), "")
    return whole.select(F.col("_conv").alias(conv), formatted.alias("formatted"), masked(F.flatten(F.transform("_bs", lambda b: b["turns"]))).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of what render() made, from the string alone."""
    turns = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    inner = lambda x: F.split(F.substring(x, F.lit(len(OPEN) + 1), F.length(x) - len(OPEN + TAIL)), r"\[INST\]", 2)
    return F.transform(turns, lambda x: let(inner(x), lambda p: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(F.get(p, F.lit(1))).alias("text"))))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped: each span's, in order, nothing between.

    The string is first cut into pieces of PIECE characters, so that a span
    far behind in a long conversation isn't searched from the beginning.
    """
    over = lambda k: F.floor(k / PIECE).cast("int")

    def piece(parts: Column, x: Column) -> Column:
        first = over(x["start"])
        here = F.array_join(F.slice(parts, first + 1, over(x["stop"]) - first + 1), "")
        return unescape(F.substring(here, x["start"] - first * PIECE + 1, x["stop"] - x["start"]))

    cut = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(cut, lambda parts: F.array_join(F.transform(spans, lambda x: piece(parts, x)), ""))
