"""Lookup of values that hold from one time until the next, such as exchange rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .asof import asof_join
from .ordered import BROADCAST_ROWS, SPLIT_ROWS, lookback_window, row_bound

# Steps that one span of days should hold.
SPAN_STEPS = 32
_DATED = (T.DateType, T.TimestampType, T.TimestampNTZType)


def value_steps(
    table: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """The rows at which the ``values`` of a key change, as ``keys``, ``_time`` and ``_value``.

    Rows without key or time say nothing. Of rows with equal time the greatest values count.
    """
    return _changes(_moments(table, keys, time, values), keys, split_rows)


def _moments(table: DataFrame, keys: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    known = table.where(F.col(time).isNotNull())
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    return known.groupBy(*keys, F.col(time).alias("_time")).agg(F.max(F.struct(*values)).alias("_value"))


def _changes(moments: DataFrame, keys: Sequence[str], split_rows: int, heavy: bool | None = None) -> DataFrame:
    def before(window: WindowSpec) -> dict[str, Column]:
        return {"_before": F.lag("_value").over(window)}

    told = lookback_window(moments, keys, ["_time"], 1, before, split_rows, heavy=heavy)
    # A value of a row is never NULL itself, as it is a struct.
    return told.where(~F.col("_value").eqNullSafe(F.col("_before"))).drop("_before")


def step_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    split_rows: int = SPLIT_ROWS,
    max_steps: int = BROADCAST_ROWS,
) -> DataFrame:
    """The same rows as ``asof_join``, for a right side whose values change seldom.

    The right side is folded to steps. Up to ``max_steps`` of them become sorted arrays, one
    per key and span of days, each headed by the step before it. They are broadcast, and
    every left row finds its step by binary search, so left rows are neither shuffled nor
    sorted, however many belong to one key. More steps, values that are not of fixed width, and times without days
    go through ``asof_join``.
    """
    taken = [c for c in values if c in left.columns]
    if taken:
        raise ValueError(f"columns on both sides: {taken}")
    kinds = {f.name: f.dataType for f in right.schema.fields}
    wide = any(isinstance(kinds[v], (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)) for v in values)
    if wide or not isinstance(kinds[right_time], _DATED) or not isinstance(left.schema[left_time].dataType, _DATED):
        return asof_join(left, right, keys, left_time, right_time, values, split_rows)
    moments, seen = written(_moments(right, keys, right_time, values), {"rows": F.count(F.lit(1))})
    heavy = None if seen["rows"] > row_bound(moments, split_rows) else False
    figures = {
        "count": F.count(F.lit(1)),
        "groups": F.approx_count_distinct(F.struct(*keys)),
        "first": F.min(_day("_time")),
        "last": F.max(_day("_time")),
    }
    steps, told = written(_changes(moments, keys, split_rows, heavy), figures)
    count, groups, first, last = (told[name] for name in figures)
    if count > max_steps:
        fewer = steps.select(*keys, F.col("_time").alias(right_time), "_value.*")
        return asof_join(left, fewer, keys, left_time, right_time, values, split_rows)
    if not count:
        return left.select("*", *[F.lit(None).cast(kinds[v]).alias(v) for v in values])
    spans = max(1, -(-count // (max(groups, 1) * SPAN_STEPS)))
    days = max(1, -(-(last - first + 1) // spans))

    def span(time: str) -> Column:
        return F.least(F.greatest(F.floor((_day(time) - first) / days), F.lit(0)), F.lit(spans - 1))

    arrays, most = _step_arrays(steps.withColumn("_span", span("_time")), keys, spans)
    arrays = arrays.withColumnsRenamed({key: f"_step_{key}" for key in keys})
    same = [F.col(key) == F.col(f"_step_{key}") for key in keys]
    asked = left.withColumn("_asked_span", span(left_time))
    found = asked.join(F.broadcast(arrays), [*same, F.col("_asked_span") == F.col("_span")], "left")
    value = _last_step("_steps", left_time, most)["_value"]
    return found.withColumn("_found", value).select(*[F.col(f"`{c}`") for c in left.columns], *[F.col("_found")[v].alias(v) for v in values])


def _day(time: str) -> Column:
    return F.unix_date(F.col(time).cast("date"))


def _step_arrays(steps: DataFrame, keys: Sequence[str], spans: int) -> tuple[DataFrame, int]:
    """One row per key and span from the key's first span on, and the length of the longest array.

    There are at most about as many rows as steps over ``SPAN_STEPS``, plus one per key.
    """
    own = steps.groupBy(*keys, "_span").agg(F.sort_array(F.collect_list(F.struct("_time", "_value"))).alias("_own"))
    most = steps.groupBy(*keys, "_span").count().agg(F.max("count")).first()[0] + 1
    following = Window.partitionBy(*keys).orderBy("_span")
    until = F.coalesce(F.lead("_span").over(following) - 1, F.lit(spans - 1))
    ahead = F.lag(F.element_at("_own", -1)).over(following)
    headed = own.withColumns({"_until": until, "_ahead": ahead})
    at = headed.select(*keys, "_span", "_own", "_ahead", F.explode(F.sequence("_span", "_until")).alias("_at"))
    # Spans without a step have only the last one before them.
    head = F.when(F.col("_ahead").isNull(), F.expr("slice(_own, 1, 0)")).otherwise(F.array("_ahead"))
    last = F.array(F.element_at("_own", -1))
    filled = F.when(F.col("_at") == F.col("_span"), F.concat(head, "_own")).otherwise(last)
    return at.select(*keys, F.col("_at").alias("_span"), filled.alias("_steps")), most


def _last_step(steps: str, time: str, most: int) -> Column:
    """The last of at most ``most`` sorted steps that is not after ``time``, or NULL."""
    strides = F.array(*[F.lit(1 << bit) for bit in reversed(range(most.bit_length()))])

    def forward(at: Column, stride: Column) -> Column:
        further = (at + stride <= F.size(steps)) & (F.get(steps, at + stride - 1)["_time"] <= F.col(time))
        return F.when(further, at + stride).otherwise(at)

    return F.get(steps, F.aggregate(strides, F.lit(0), forward) - 1)
