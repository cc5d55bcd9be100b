"""Price history: truncation, rolling averages and sampling at statement dates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import iso_timestamp
from ..operators.asof import asof_join
from ..operators.ordered import SPLIT_ROWS, chunked_window, has_heavy_keys, plain_window, row_bound, slice_heavy_keys

# Default window length in rows and first day of the history.
PERIOD = 120
START = "2017-01-01"

_ROLLED = "_rolled_"


def truncate_before(history: DataFrame, start: str = START, date: str = "date") -> DataFrame:
    """Rows dated ``start`` or later."""
    return history.where(F.col(date) >= iso_timestamp(start))


def _prices(history: DataFrame, keys: Sequence[str]) -> list[str]:
    return [
        f.name for f in history.schema.fields if f.name not in keys and isinstance(f.dataType, T.NumericType)
    ]


def rolling_average(
    history: DataFrame,
    period: int = PERIOD,
    values: Sequence[str] | None = None,
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("date",),
    split_rows: int = SPLIT_ROWS,
    symbols: DataFrame | None = None,
) -> DataFrame:
    """Replace each value column by its mean over the last ``period`` rows.

    NULL until the window is full, and NULL if it holds a NULL. Rows that tie in
    ``order`` follow in the order of their values. ``values`` defaults to all
    numeric columns. With ``symbols``, a table of keys, only those
    keys are computed; the semi-join uses the exchange of the window unless
    ``symbols`` is broadcast.
    """
    values = list(values) if values is not None else _prices(history, [*keys, *order])
    order = [*order, *[v for v in values if v not in order]]

    def averages(window: WindowSpec) -> list[dict[str, Column]]:
        return _window_means(window, values, period)

    # Heavy keys are measured before the semi-join, so that this stays a plain aggregate.
    cut = slice_heavy_keys(history, keys, order, split_rows)
    rows = history if cut is None else cut
    if symbols is not None:
        rows = rows.join(symbols.select(*keys).distinct(), list(keys), "left_semi")
    if cut is None:
        rolled = plain_window(rows, keys, order, averages)
    else:
        rolled = chunked_window(rows, keys, order, period - 1, averages, split_rows)
    return rolled.select(*[F.col(_ROLLED + c).alias(c) if c in values else F.col(c) for c in history.columns])


def _window_means(window: WindowSpec, values: Sequence[str], period: int) -> list[dict[str, Column]]:
    """Means over the last ``period`` rows in two stages.

    A frame of ``period`` rows would be summed up anew at every row. Instead short
    frames of about the square root of that are summed, and the sums that line up
    to the whole frame are added. Nothing is subtracted, so no digits are lost. A
    short sum with a NULL or without all its rows is NULL, and so is the mean.
    """
    length = max(1, round(period**0.5))
    whole, rest = divmod(period, length)

    def short_sum(value: str, rows: int) -> Column:
        frame, number = window.rowsBetween(-(rows - 1), 0), F.col(value).cast("double")
        return F.when(F.count(number).over(frame) == rows, F.sum(number).over(frame))

    sums, means = {}, {}
    for v in values:
        sums[f"_short_{v}"] = short_sum(v, length)
        parts = [F.lag(f"_short_{v}", length * at).over(window) for at in range(1, whole)]
        if rest:
            sums[f"_rest_{v}"] = short_sum(v, rest)
            parts.append(F.lag(f"_rest_{v}", length * whole).over(window))
        means[_ROLLED + v] = reduce(Column.__add__, parts, F.col(f"_short_{v}")) / F.lit(period)
    return [sums, means]


def at_dates(history: DataFrame, dates: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """History rows whose symbol and date occur in ``dates``."""
    return history.join(dates.select(*keys).distinct(), list(keys), "left_semi")


def _stacked_rolled(recent: DataFrame, asked: DataFrame, values: Sequence[str], period: int) -> DataFrame:
    """History rows with rolling means, and among them the rows of ``asked``, marked by
    ``_asked``. All windows on symbol that follow use the one exchange made here."""
    known = recent.where(F.col("symbol").isNotNull()).withColumn("_asked", F.lit(False))
    stacked = known.unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True).repartition("symbol")
    order = ["date", *[v for v in values if v != "date"]]
    return plain_window(stacked, ["symbol", "_asked"], order, lambda w: _window_means(w, values, period))


def average_history(
    history: DataFrame,
    kpi_dates: DataFrame,
    period: int = PERIOD,
    start: str = START,
    values: Sequence[str] | None = None,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Rolling average of the truncated history at the KPI dates, all symbols at once.

    ``kpi_dates`` has ``symbol`` and ``date``. The dates are stacked with the history before
    its only exchange. If a symbol is heavy, the rolled history is cut and joined instead.
    """
    recent = truncate_before(history, start)
    values = list(values) if values is not None else _prices(recent, ["symbol", "date"])
    if has_heavy_keys(recent.select("symbol").unionByName(kpi_dates.select("symbol")), ["symbol"], row_bound(recent, split_rows)):
        rolled = rolling_average(recent, period, values, split_rows=split_rows, symbols=kpi_dates)
        return at_dates(rolled, kpi_dates)
    asked = kpi_dates.select("symbol", F.col("date").cast(recent.schema["date"].dataType)).where("symbol IS NOT NULL AND date IS NOT NULL")
    rolled = _stacked_rolled(recent, asked, values, period)
    met = F.max("_asked").over(Window.partitionBy("symbol", "date"))
    found = rolled.withColumn("_met", met).where(F.col("_met") & ~F.col("_asked"))
    return found.select(*[F.col(_ROLLED + c).alias(c) if c in values else F.col(c) for c in history.columns])


def average_history_asof(
    history: DataFrame,
    kpi_dates: DataFrame,
    period: int = PERIOD,
    start: str = START,
    values: Sequence[str] | None = None,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """As ``average_history``, but each KPI date takes the last trading day at or before it;
    of several rows of that day the greatest means count."""
    values = list(values) if values is not None else _prices(history, ["symbol", "date"])
    recent = truncate_before(history, start)
    if has_heavy_keys(recent.select("symbol").unionByName(kpi_dates.select("symbol")), ["symbol"], row_bound(recent, split_rows)):
        rolled = rolling_average(recent, period, values, split_rows=split_rows, symbols=kpi_dates)
        return asof_join(kpi_dates, rolled, ["symbol"], "date", "date", values, split_rows)
    taken = [c for c in values if c in kpi_dates.columns]
    if taken:
        raise ValueError(f"columns on both sides: {taken}")
    row = F.struct(*[F.col(f"`{c}`") for c in kpi_dates.columns]).alias("_row")
    asked = kpi_dates.select("symbol", F.col("date").cast(recent.schema["date"].dataType), row)
    rolled = _stacked_rolled(recent.select("symbol", "date", *values), asked, values, period)
    means = F.when(~F.col("_asked"), F.struct(*[F.col(_ROLLED + v).alias(v) for v in values]))
    so_far = Window.partitionBy("symbol").orderBy("date", "_asked", "_means").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = rolled.withColumn("_means", means).withColumn("_last", F.last("_means", ignorenulls=True).over(so_far))
    return carried.where("_asked").select("_row.*", *[F.col("_last")[v].alias(v) for v in values])
