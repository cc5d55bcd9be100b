"""Chat formatting: preference pairs with a shared prompt.

The turns of the chosen and the rejected conversation of a pair are compared by their
content. The turns before the first difference are the longest common prefix: they are
rendered once, as the prompt. What follows on either side is that side's completion, in
which only assistant turns are trained on; all else is masked.

``preference_segments`` has one row per rendered segment, so that a conversation of any
length never has to fit into one task: the first difference is a map-side combined
minimum, and copies of a turn are counted, not gathered. ``preference_pairs`` puts the
segments of every pair into one row: the prompt, both completions, and for each the
character spans that are trained on. Such a row, and the task that makes it, holds its pair
whole. Only a caller who sets bounds gets the segments of longer pairs as rows of their own.

Defined cases: a null role is rendered as ``user``, a null text as empty; but null and
empty texts differ. Rows with a null conversation id belong to no pair, and a null turn
comes before all others. Repeated rows of a turn count as copies, and a turn is common
only if both sides have it equally often; several different rows of a turn are ordered by
role and text. A pair with one side has the whole conversation as that side's completion,
and ``sides`` says so: it is no preference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PROMPT, CHOSEN, REJECTED = "prompt", "chosen", "rejected"
BOTH = "both"
# Places a null turn before all others.
_NULL_TURN = -(2**63)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("user")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def preference_segments(turns: DataFrame) -> DataFrame:
    """Segments from rows ``(pair_id, chosen boolean, turn, role, text)``.

    Returns ``pair_id, part, turn, role, text, copies, rendered, n_chars, trained``.
    """
    counted = turns.groupBy("pair_id", "turn", "role", "text").agg(
        F.count_if(F.col("chosen")).alias("_chosen"), F.count_if(~F.col("chosen")).alias("_rejected")
    )
    place = F.coalesce(F.col("turn").cast("long"), F.lit(_NULL_TURN))
    # Pairs without a difference have no row here, and all their turns are prompt.
    splits = (
        counted.where(F.col("_chosen") != F.col("_rejected"))
        .groupBy(F.col("pair_id").alias("_pair"))
        .agg(F.min(place).alias("_split"))
    )
    joined = counted.join(splits, F.col("pair_id") == F.col("_pair"), "left")
    common = F.coalesce(place < F.col("_split"), F.lit(True))
    one = lambda part, n: F.struct(F.lit(part).alias("part"), n.alias("copies"))
    parts = F.when(common, F.array(one(PROMPT, F.col("_chosen")))).otherwise(
        F.filter(F.array(one(CHOSEN, F.col("_chosen")), one(REJECTED, F.col("_rejected"))), lambda p: p["copies"] > 0)
    )
    return (
        joined.withColumn("_part", F.explode(parts))
        .select(
            "pair_id",
            F.col("_part.part").alias("part"),
            "turn",
            "role",
            "text",
            F.col("_part.copies").alias("copies"),
            rendered(F.col("role"), F.col("text")).alias("rendered"),
            F.coalesce((F.col("_part.part") != PROMPT) & (F.col("role") == "assistant"), F.lit(False)).alias("trained"),
        )
        .withColumn("n_chars", F.length("rendered").cast("long") * F.col("copies"))
    )


def preference_pairs(turns: DataFrame, max_chars: int | None = None, max_segments: int | None = None) -> DataFrame:
    """Preference rows from the same input as ``preference_segments``.

    Returns ``pair_id, form, sides, turn, prompt, chosen, chosen_spans, rejected,
    rejected_spans``. A row of form ``pair`` is a whole pair: texts in the order of turns,
    and arrays of ``(start, length)``, in characters, of what is trained on; all else is
    masked. Pairs beyond the bounds, if any are set, have one row of form ``segment`` per segment, with its
    ``turn``, and only the column of its part filled. ``sides`` is ``both``, ``chosen`` or
    ``rejected``.
    """
    segments = stored(preference_segments(turns.where(F.col("pair_id").isNotNull())), "segments")
    has = lambda part: F.max(F.col("part") == part)
    sides = F.when(has(PROMPT) | (has(CHOSEN) & has(REJECTED)), BOTH).when(has(CHOSEN), CHOSEN).otherwise(REJECTED)
    bounded = F.lit(True)
    if max_chars is not None:
        bounded &= F.sum("n_chars") <= max_chars
    if max_segments is not None:
        bounded &= F.count(F.lit(1)) <= max_segments
    pairs = segments.groupBy(F.col("pair_id").alias("_pair")).agg(sides.alias("sides"), bounded.alias("_bounded"))
    placed = segments.join(pairs, F.col("pair_id") == F.col("_pair"))
    if max_chars is None and max_segments is None:
        return _whole_pairs(placed)
    return _whole_pairs(placed.where("_bounded")).unionByName(_loose_segments(placed.where("not _bounded")))


def _whole_pairs(segments: DataFrame) -> DataFrame:
    place = F.coalesce(F.col("turn").cast("long"), F.lit(_NULL_TURN))
    before = Window.partitionBy("pair_id", "part").orderBy(place, "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    start = F.coalesce(F.sum("n_chars").over(before), F.lit(0))
    rows = segments.repartition("pair_id").select(
        "pair_id", "sides", "part", "trained", "n_chars", start.alias("start"), F.expr("repeat(rendered, int(copies))").alias("shown")
    )
    mine = lambda part, *of: F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("start", *of))))
    spans = lambda part: F.array_sort(F.collect_list(F.when((F.col("part") == part) & F.col("trained"), F.struct("start", F.col("n_chars").alias("length")))))
    text = lambda part: F.array_join(F.transform(mine(part, "shown"), lambda s: s["shown"]), "").alias(part)
    made = rows.groupBy("pair_id").agg(
        F.max("sides").alias("sides"), text(PROMPT), text(CHOSEN), spans(CHOSEN).alias("chosen_spans"), text(REJECTED), spans(REJECTED).alias("rejected_spans")
    )
    return made.select("pair_id", F.lit("pair").alias("form"), "sides", F.lit(None).cast("long").alias("turn"), *made.columns[2:])


def _loose_segments(segments: DataFrame) -> DataFrame:
    shown = F.expr("repeat(rendered, int(copies))")
    span = F.struct(F.lit(0).cast("long").alias("start"), F.col("n_chars").alias("length"))
    text = lambda part: F.when(F.col("part") == part, shown).alias(part)
    spans = lambda part: F.when(F.col("part") == part, F.when(F.col("trained"), F.array(span)).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>")))
    return segments.select(
        "pair_id", F.lit("segment").alias("form"), "sides", F.col("turn").cast("long").alias("turn"), text(PROMPT),
        text(CHOSEN), spans(CHOSEN).alias("chosen_spans"), text(REJECTED), spans(REJECTED).alias("rejected_spans"),
    )


def cut_answers(conversations: DataFrame) -> DataFrame:
    """Pairs of a conversation, chosen, and the same with its last answers cut to half their
    characters, rejected. The pair id is the negative of the conversation's less one."""
    known = conversations.where(F.col("conv_id").isNotNull())
    answered = known.where(F.col("role") == "assistant").groupBy(F.col("conv_id").alias("_conv")).agg(F.max("turn").alias("_last"))
    joined = known.join(answered, F.col("conv_id") == F.col("_conv"), "left")
    cut = (F.col("role") == "assistant") & (F.col("turn") == F.col("_last"))
    half = F.when(cut, F.expr("left(text, int(length(text) div 2))")).otherwise(F.col("text"))
    side = F.explode(F.array(F.struct(F.lit(True).alias("chosen"), F.col("text")), F.struct(F.lit(False).alias("chosen"), half.alias("text"))))
    return joined.select((-F.col("conv_id") - 1).cast("long").alias("pair_id"), "turn", "role", side.alias("_side")).select("pair_id", "_side.chosen", "turn", "role", "_side.text")


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs of a table of conversations: id 2k is the chosen one, 2k + 1 the rejected."""
    even = F.pmod(F.col("conv_id"), F.lit(2)) == 0
    return conversations.where(F.col("conv_id").isNotNull()).select(
        ((F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(2))) / 2).cast("long").alias("pair_id"),
        even.alias("chosen"),
        "turn",
        "role",
        "text",
    )
