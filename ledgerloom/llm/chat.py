"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt; what remains of each
side is its completion, of which only the assistant's words bear loss.  Built-in functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The turn marks of the ChatML format.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def _role(turn: Column) -> Column:
    return F.coalesce(turn["role"], F.lit(""))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(TURN_START), _role(turn), F.lit("\n"))


def _tail(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(TURN_END))


def render(turns: Column) -> Column:
    """The text of an array of turns; a null role or text counts as empty."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _tail(t))), "")


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns two arrays share; role and text must be equal, nulls included."""
    n = F.least(F.size(a), F.size(b))
    same = F.aggregate(
        F.arrays_zip(a.alias("x"), b.alias("y")),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, p: F.struct(
            (s["n"] + F.when(s["on"] & p["x"].eqNullSafe(p["y"]), 1).otherwise(0)).alias("n"),
            (s["on"] & p["x"].eqNullSafe(p["y"])).alias("on"),
        ),
        lambda s: s["n"],
    )
    return F.least(n, same)


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """Half-open character ranges of ``render(turns)`` that bear loss: the words of ``role`` with the end mark."""
    step = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(_head(t)) + F.length(_tail(t))).alias("at"),
            F.when(_role(t) == role, F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(_head(t))).alias("start"), (s["at"] + F.length(_head(t)) + F.length(_tail(t))).alias("end"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return step


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` without the two arrays of turns, and with prompt_turns, prompt, chosen_text,
    chosen_spans, rejected_text and rejected_spans.

    A null array counts as no turns.  Equal conversations leave two empty completions, and
    conversations without a common turn leave an empty prompt.  Other columns stay.
    """
    none = F.expr(f"cast(array() as {TURNS})")
    a, b = F.coalesce(F.col(chosen), none), F.coalesce(F.col(rejected), none)
    named = pairs.withColumn("prompt_turns", common_turns(a, b))
    n = F.col("prompt_turns")
    rest = lambda side: F.slice(side, n + 1, F.greatest(F.size(side) - n, F.lit(0)))
    return named.select(
        *[F.col(f"`{c}`") for c in pairs.columns if c not in (chosen, rejected)], n, render(F.slice(a, 1, n)).alias("prompt"),
        render(rest(a)).alias("chosen_text"), loss_spans(rest(a)).alias("chosen_spans"),
        render(rest(b)).alias("rejected_text"), loss_spans(rest(b)).alias("rejected_spans"),
    )


def sibling_pairs(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, chosen, rejected): each conversation, and itself with its last answer replaced.

    The replacement is the last assistant turn of the sibling, the conversation whose id
    differs in the lowest bit only: an answer to another question.  Without one the
    rejected side ends before the answer.  Turns are ordered by turn, role and text;
    repeated turns stay; turns without a conversation id are left out.
    """
    key = F.col(id_col).cast("long")
    turn = F.struct("turn", "role", "text")
    odd = F.pmod(key, F.lit(2)) == 1
    both = conversations.where(key.isNotNull()).groupBy(F.shiftright(key, 1).alias("pair")).agg(F.array_sort(F.collect_list(F.when(~odd, turn))).alias("even"), F.array_sort(F.collect_list(F.when(odd, turn))).alias("odd"))
    sides = both.select("pair", F.inline(F.array(F.struct(F.lit(0).alias("bit"), F.col("even").alias("own"), F.col("odd").alias("sibling")), F.struct(F.lit(1).alias("bit"), F.col("odd").alias("own"), F.col("even").alias("sibling"))))).where(F.size("own") > 0)
    plain = lambda c: F.transform(c, lambda t: F.struct(t["role"].cast("string").alias("role"), t["text"].cast("string").alias("text")))
    sides = sides.select((F.col("pair") * 2 + F.col("bit")).alias(id_col), plain(F.col("own")).alias("own"), plain(F.col("sibling")).alias("sibling"))
    last = F.array_max(F.transform("own", lambda t, i: F.when(t["role"] == "assistant", i)))
    before = F.slice("own", 1, F.coalesce(last, F.size("own")))
    answer = F.slice(F.filter("sibling", lambda t: t["role"] == "assistant"), -1, 1)
    answer = F.when(F.size(F.filter("sibling", lambda t: t["role"] == "assistant")) > 0, answer).otherwise(F.expr(f"cast(array() as {TURNS})"))
    return sides.select(id_col, F.col("own").alias("chosen"), F.concat(before, answer).alias("rejected"))
