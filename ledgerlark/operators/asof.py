"""As-of join: the last right row at or before each left row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import SLICE, SLICES, SPLIT_ROWS, cut_heavy_keys, null_safe_join


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    split_rows: int = SPLIT_ROWS,
    slices: int = SLICES,
) -> DataFrame:
    """Left rows with the ``values`` of the last right row of the same keys whose
    time is not later; NULL if there is none.

    Both sides are stacked and one ordered pass carries the last right row
    forward, so no pairs are built. Of right rows with equal time the greatest
    ``values`` win.

    Heavy keys are cut into time slices, and each slice starts with the last right
    row of the slices before it. If even one instant is heavy, each side is first
    reduced to one row per key and time, and the answers are joined to the left
    rows.
    """
    taken = [c for c in values if c in left.columns]
    if taken:
        raise ValueError(f"columns on both sides: {taken}")
    known = right.where(F.col(right_time).isNotNull())
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    known = known.select(*keys, F.col(right_time).alias("_time"), F.struct(*values).alias("_right"))
    asked = left.select(
        *keys, F.col(left_time).alias("_time"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left")
    )
    answer = [F.col("_last")[v].alias(v) for v in values]
    both = _stack(known, asked)
    cut, heavy_moment = cut_heavy_keys(both, keys, ["_time"], split_rows, slices)
    if cut is None:
        return _carry(both, keys).select("_left.*", *answer)
    if not heavy_moment:
        return _carry_over_slices(cut, keys).select("_left.*", *answer)
    moment = [*keys, SLICE, "_time"]
    greatest = cut.where("_side = 0").groupBy(*moment).agg(F.max("_right").alias("_right"))
    found = _carry_over_slices(_stack(greatest, cut.where("_side = 1").select(*moment).distinct()), keys)
    found = found.select(*keys, "_time", "_last")
    return null_safe_join(asked, found, [*keys, "_time"], "left").select("_left.*", *answer)


def _stack(known: DataFrame, asked: DataFrame) -> DataFrame:
    """Right rows are side 0, so that they come before left rows of the same time."""
    return known.withColumn("_side", F.lit(0)).unionByName(
        asked.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )


def _carry(stacked: DataFrame, group: Sequence[str]) -> DataFrame:
    """Left rows with the last right row so far within the group."""
    so_far = (
        Window.partitionBy(*group)
        .orderBy("_time", "_side", "_right")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return stacked.withColumn("_last", F.last("_right", ignorenulls=True).over(so_far)).where("_side = 1")


def _carry_over_slices(cut: DataFrame, keys: Sequence[str]) -> DataFrame:
    group = [*keys, SLICE]
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    newest = F.max(F.when(F.col("_side") == 0, F.struct("_time", "_right"))).alias("_newest")
    carried = (
        cut.where(F.size(SLICE) > 0)
        .groupBy(*group)
        .agg(newest)
        .select(*group, F.last("_newest._right", ignorenulls=True).over(earlier).alias("_carried"))
    )
    return null_safe_join(_carry(cut, group), carried, group, "left").withColumn(
        "_last", F.coalesce("_last", "_carried")
    )
