"""Mixing of sources to target weights.

The tokens of each source are summed, its target divided by them is its repetition
rate, and every document is taken floor(rate) times plus once more if its hash, read as
a number in [0, 1), is below the rest of the rate. The hash depends on document and seed
alone, so reruns and retried tasks agree.

Only one row per source is joined to the documents. Documents stay where they are if the
sources are few; else the join shuffles, and adaptive execution splits a hot source.

Defined cases: null text has size 0; the null source is a source of its own, the last in
order; rows with a null id share one draw per seed, as repeated rows do; if all sizes are
0, all targets are 0; a document of size 0 is taken as its rate says, which adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .common import WORD, free_name, small, stored

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"
_STEPS = 2**52


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """``(source, source_size, target)`` from rows ``(source, size)``.

    Sources in code point order, null last, get the weights in turn. A target over
    ``max_repeats`` times the source's size stops there and its excess goes to the others
    by weight, until none is above. Each round is one aggregate over the sources, of
    which the driver sees the sums only.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    placed = ranked(sums, order, "_rank")
    weight = F.array(*[F.lit(w) for w in weights])[((F.col("_rank") - 1) % len(weights)).cast("int")]
    sources = stored(placed.withColumn("_weight", weight.cast("long")), "sources")
    cap = max_repeats * F.col("source_size")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    # Share per unit of weight, as numerator and denominator: only whole numbers.
    over, under, stopped = total, sources.agg(F.coalesce(F.sum("_weight"), F.lit(0))).first()[0], -1
    while True:
        above = F.col("_weight") * F.lit(over) > cap * F.lit(under)
        n, held, rest = sources.agg(
            F.count_if(above),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0)),
        ).first()
        if n == stopped or rest == 0:
            break
        over, under, stopped = total - held, rest, n
    above = F.col("_weight") * F.lit(over) > cap * F.lit(under)
    target = F.when(above, cap.cast("double")).otherwise((F.col("_weight") * F.lit(over)).cast("double") / F.lit(float(max(under, 1))))
    return sources.select("source", "source_size", target.alias("target"))


def draw(key: Column, seed: str = SEED) -> Column:
    """Number in [0, 1) from the hash of key and seed."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(_STEPS))


def mixed(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """All rows and columns of ``docs`` and one struct ``(size, source_size, target,
    copies)``, named ``mix`` with underscores in front if that is taken."""
    out = free_name(docs.columns, "mix")
    sizes = docs.select(F.col(f"`{source}`").cast("string").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    targets = source_targets(sizes, weights, max_repeats)
    targets = targets.select(F.col("source").alias("_to"), "source_size", "target")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(f"`{source}`").cast("string").alias("_from"),
        word_count(F.col(f"`{text}`")).alias("_size"),
    )
    rows = rows.join(small(targets), F.col("_from").eqNullSafe(F.col("_to")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    once_more = draw(F.col(f"_row.`{key}`"), seed) < rate - whole
    mix = F.struct(
        F.col("_size").alias("size"), "source_size", "target", (whole + once_more.cast("int")).cast("long").alias("copies")
    )
    return rows.select("_row.*", mix.alias(out))


def emit(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    out = free_name(docs.columns, "mix")
    rows = mixed(docs, key, text, source, **options).where(F.col(f"{out}.copies") > 0)
    copies = F.explode(F.array_repeat(F.lit(0), F.col(f"{out}.copies").cast("int")))
    return rows.withColumn(free_name(rows.columns, "copy"), copies).select(*[F.col(f"`{c}`") for c in docs.columns])
