"""Preference formatting of chosen and rejected conversations, in DataFrame operations only.

The longest common prefix of turns is rendered once as the prompt; what follows on
either side is a completion, with the code-point ranges of its assistant texts as the
loss mask.  A conversation is bounded by its own length: no group spans conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def render(turns: Column) -> Column:
    """Turns (role, text) one after another: <|role|>, the text, <|end|>, each on lines of their own."""
    return F.array_join(F.transform(turns, _turn), "")


def _turn(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))


def loss_mask(turns: Column) -> Column:
    """start:end of each assistant text with its end mark inside ``render(turns)``, comma-joined."""
    step = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.char_length(_turn(t))).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(a["spans"], F.array(F.concat((a["at"] + F.char_length(t["role"]) + 5).cast("string"), F.lit(":"), (a["at"] + F.char_length(_turn(t)) - 1).cast("string")))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return F.array_join(step, ",")


def _rows() -> Column:
    return F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _side(which: Column) -> Column:
    """Aggregate: array<struct<role, text>> of the rows for which ``which`` holds, in order of turn, role, text."""
    return F.transform(F.array_sort(F.collect_list(F.when(which, _rows()))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _formatted(pairs: DataFrame) -> DataFrame:
    """Pairs (pair_id, c, r), c and r being arrays of turns, as ``preference_pairs`` returns them."""
    least = F.least(F.size("c"), F.size("r"))
    differ = F.array_position(F.zip_with(F.slice("c", 1, least), F.slice("r", 1, least), lambda a, b: a == b), False)
    pairs = pairs.withColumn("n", F.when(differ == 0, least).otherwise(differ - 1).cast("int"))
    after = lambda x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x), F.lit(1)))
    return pairs.select(
        "pair_id", F.col("n").cast("long").alias("n_common"), render(F.slice("c", 1, F.col("n"))).alias("prompt"),
        render(after("c")).alias("chosen"), render(after("r")).alias("rejected"),
        loss_mask(after("c")).alias("chosen_mask"), loss_mask(after("r")).alias("rejected_mask"),
    )


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Masked pairs from turns (pair_id, chosen boolean, turn, role, text).

    Returns pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask;
    masks count from the start of the completion.  Turns are ordered by turn, then role,
    then text (so ties have one order; a null turn comes first); a null role or text is
    empty.  Turns are common if role and text are equal.  A side that a pair lacks is an
    empty completion after an empty prompt.  Rows without pair_id or chosen are left
    out; repeated rows are turns of their own; other columns aren't looked at; an empty
    table gives an empty result.
    """
    rows = turns.where("pair_id is not null and chosen is not null").select("pair_id", "chosen", "turn", "role", "text")
    return _formatted(rows.groupBy("pair_id").agg(_side(F.col("chosen")).alias("c"), _side(~F.col("chosen")).alias("r")))


def forked_pairs(turns: DataFrame) -> DataFrame:
    """Masked pairs from plain conversations (conv_id, turn, role, text), a pair for each, as ``preference_pairs`` returns them.

    Chosen is the conversation itself.  Rejected forks from it at its last assistant
    turn, in whose place stands the last assistant turn of its partner: conversations 2k
    and 2k + 1 are each other's.  If either has no assistant turn, or the partner is
    missing, the rejected side is lacking.  pair_id is conv_id; rows without it are left
    out; order, nulls, repeats and the empty table are as in ``preference_pairs``.
    """
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    odd = F.pmod("conv_id", F.lit(2)) == 1
    two = rows.groupBy(F.shiftright("conv_id", 1).alias("k")).agg(_side(~odd).alias("even"), _side(odd).alias("odd"))
    each = F.struct(F.shiftleft("k", 1).alias("pair_id"), F.col("even").alias("c"), F.col("odd").alias("other")), F.struct((F.shiftleft("k", 1) + 1).alias("pair_id"), F.col("odd").alias("c"), F.col("even").alias("other"))
    both = two.select(F.explode(F.array(*each)).alias("x")).where("size(x.c) > 0").select("x.*")
    last = lambda c: F.aggregate(F.transform(c, lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    both = both.withColumns({"own": last("c"), "theirs": last("other")})
    forked = F.when((F.col("own") > 0) & (F.col("theirs") > 0), F.concat(F.slice("c", F.lit(1), F.col("own") - 1), F.slice("other", F.greatest("theirs", F.lit(1)), F.lit(1)))).otherwise(F.slice("c", 1, 0))
    return _formatted(both.select("pair_id", "c", forked.alias("r")))
