"""Fundamental screen, column program and ranked views."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import drop_all_null_columns, rearrange
from ..sources.writers import write_filtered_metrics

# Strict upper bounds of the safe-metrics screen.
SAFE_THRESHOLDS = {"shortRatio": 3.0, "pegRatio": 1.5, "payoutRatio": 0.6, "debtToEquity": 200.0}

# The column program, in order.
COLUMN_PROGRAM = (
    ("move", 4, 126),
    ("drop", "address2"),
    ("drop", "uuid"),
    ("drop", "companyOfficers"),
    ("drop", "maxAge"),
    ("drop", "tradeable"),
    ("drop", "fax"),
    ("drop", "messageBoardId"),
    ("drop", "quoteType"),
    ("drop", "gmtOffSetMilliseconds"),
    ("drop", "isEsgPopulated"),
    ("move", 27, 0),
    ("move", 41, 0),
    ("move", 44, 116),
    ("move", 44, 116),
    ("move", 43, 116),
    ("move", 42, 116),
    ("move", 41, 116),
    ("move", 2, 0),
    ("move", 3, 116),
    ("move", 3, 0),
    ("move", 9, 116),
    ("move", 8, 116),
    ("move", 7, 116),
    ("move", 7, 116),
    ("move", 6, 116),
    ("move", 6, 116),
    ("move", 4, 116),
    ("move", 13, 116),
    ("move", 31, 0),
    ("move", 53, 0),
    ("move", 101, 116),
)


def recommendation_order() -> list:
    """Ascending recommendation, missing last, ties by symbol."""
    return [F.nanvl(F.col("recommendationMean"), F.lit(None)).asc_nulls_last(), F.col("symbol").asc()]


def beta_order() -> list:
    """Ascending beta, missing last, ties by symbol."""
    return [F.nanvl(F.col("beta"), F.lit(None)).asc_nulls_last(), F.col("symbol").asc()]


def safe_metrics(metrics: DataFrame, thresholds: Mapping[str, float] = SAFE_THRESHOLDS) -> DataFrame:
    """Rows strictly below every threshold; a missing value fails, a negative passes."""
    passing = F.lit(True)
    for name, bound in thresholds.items():
        passing = passing & (F.col(name) < F.lit(bound))
    return metrics.where(passing)


def reorder_columns(metrics: DataFrame, program: Iterable[tuple] = COLUMN_PROGRAM, strict: bool = False) -> DataFrame:
    """Run the column program, then sort by recommendation."""
    return rearrange(metrics, program, strict).orderBy(*recommendation_order())


def screen(
    metrics: DataFrame,
    thresholds: Mapping[str, float] = SAFE_THRESHOLDS,
    program: Iterable[tuple] = COLUMN_PROGRAM,
    csv_path: str | None = None,
) -> DataFrame:
    """Safe companies without empty columns, rearranged and ranked by recommendation.

    With ``csv_path`` the symbol-sorted table is also written there.
    """
    kept = drop_all_null_columns(safe_metrics(metrics, thresholds))
    if csv_path is not None:
        write_filtered_metrics(kept.orderBy("symbol"), csv_path)
    return reorder_columns(kept, program)


def beta_view(metrics: DataFrame) -> DataFrame:
    """Table view sorted by beta."""
    return metrics.orderBy(*beta_order())


def scatter_data(metrics: DataFrame) -> DataFrame:
    """Columns of the beta scatter: x, y, colour and facet, marker."""
    return metrics.select("symbol", "beta", "sector", "recommendationKey")
