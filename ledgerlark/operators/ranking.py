"""Sorted output: top-N and the position of each row in a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

# Most rows of a top-N that one task merges.
GATHERED = 10_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in the total order.

    A window without a partition key would move the table to one task. Here the
    rows are range-sorted and settled, then numbered per partition, and each
    partition adds the row count of those before it. The helper table has one
    row per sorted partition. The order must be total, so end it with a key.
    """
    placed = settle(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    in_part = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select(*df.columns, (F.col("_before") + in_part + 1).alias(name))
    )


def top_n(df: DataFrame, order: Sequence[Column], n: int, strict: bool = True, lazy: bool = False) -> DataFrame:
    """First ``n`` rows of the order; ``strict`` raises if there are fewer.

    Up to ``GATHERED`` rows come from one task that merges the best of each; more are
    taken from the range-sorted table. Both are settled, so that the rows counted are
    the rows returned. With ``lazy`` no job runs here for up to ``GATHERED`` rows: the plan
    carries the count and raises when it runs.
    """
    if n > GATHERED:
        best = ranked(df, order, "_rank").where(F.col("_rank") <= n).drop("_rank")
    else:
        best = df.orderBy(*order).limit(n)
    if not strict:
        return best
    if lazy and n <= GATHERED:
        return _guarded(best, n).orderBy(*order)
    best = settle(best)
    if best.count() < n:
        raise ValueError(_too_few(n))
    return best


def _too_few(n: int) -> str:
    return f"fewer than {n} rows; ask for fewer"


def _guarded(best: DataFrame, n: int) -> DataFrame:
    """The rows of ``best``, a task's worth, or an error in the plan if they are under ``n``.

    A row of its own carries the check, so that an empty table raises too.
    """
    check = best.sparkSession.range(1).select(F.lit(False).alias("_row"))
    rows = best.withColumn("_row", F.lit(True)).unionByName(check, allowMissingColumns=True)
    counted = rows.withColumn("_rows", F.count_if("_row").over(Window.partitionBy()))
    enough = F.when(F.col("_rows") < n, F.raise_error(_too_few(n)).cast("boolean")).otherwise(F.col("_row"))
    return counted.where(enough).drop("_row", "_rows")
