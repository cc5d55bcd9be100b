"""Recompute only the KPI rows that changed statements reach.

A statement's KPIs read the statement itself, the total debt of the one before, and whether
any EBIT of the symbol is 0. So a changed statement reaches its own row, the row after
it, and all rows of its symbol if that flag flips. Which rows these are is found from a few
narrow columns of the touched symbols; only the rows reached are computed in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..operators.columns import conform
from ..operators.joins import left_lookup, upsert
from ..operators.ordered import SPLIT_ROWS, lookback_window, null_safe_join
from ..schema import KEY_COLUMNS, STATEMENT_SCHEMA
from ..session import written
from .kpis import DEBT_ORDER, kpi_columns, quote_figures

REASONS = ("changed", "after a change", "EBIT rule")


def _written(df: DataFrame) -> DataFrame:
    return written(df, {"rows": F.count(F.lit(1))})[0]


def restated(old: DataFrame, landed: DataFrame) -> DataFrame:
    """Rows of ``landed`` that are new or differ from the old row of their key."""
    values = [F.col(f"`{name}`") for name in STATEMENT_SCHEMA.names]
    # Structs of all columns are compared by value, NULL matching NULL.
    before = conform(old, STATEMENT_SCHEMA).select(*KEY_COLUMNS, F.struct(*values).alias("_before"))
    after = conform(landed, STATEMENT_SCHEMA)
    joined = null_safe_join(after, before, KEY_COLUMNS, "left")
    return _written(joined.where(~F.struct(*values).eqNullSafe(F.col("_before"))).select(*after.columns))


def reached_rows(old: DataFrame, changed: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Keys of the rows that ``changed`` reaches, with ``reason``, ``_debt_change`` and
    ``_use_income``: all that their KPIs need from other rows.

    ``old`` has one row per key, and ``changed`` the rows that are new or restated.
    """
    narrow = [*KEY_COLUMNS, "total_debt", "ebit"]
    symbols = changed.select("symbol").distinct()
    before = _written(null_safe_join(conform(old, STATEMENT_SCHEMA).select(*narrow), symbols, ["symbol"], "left_semi"))
    after = conform(changed, STATEMENT_SCHEMA).select(*narrow, F.lit(True).alias("_changed"))
    merged = upsert(before.withColumn("_changed", F.lit(False)), after, KEY_COLUMNS)
    zero = lambda name: F.coalesce(F.max(F.col("ebit") == 0), F.lit(False)).alias(name)
    flags = null_safe_join(
        merged.groupBy("symbol").agg(zero("_use_income")), before.groupBy("symbol").agg(zero("_used_income")), ["symbol"], "left"
    )
    flips = F.col("_use_income") != F.coalesce("_used_income", F.lit(False))
    flags = flags.select("symbol", "_use_income", flips.alias("_flips"))

    def looked_back(window: WindowSpec) -> dict[str, Column]:
        return {
            "_debt_change": F.col("total_debt") - F.lag("total_debt").over(window),
            "_follows": F.coalesce(F.lag("_changed").over(window), F.lit(False)),
        }

    rows = lookback_window(merged, ["symbol"], DEBT_ORDER, 1, looked_back, split_rows)
    rows = null_safe_join(rows, flags, ["symbol"], "left")
    reason = F.when(F.col("_changed"), REASONS[0]).when(F.col("_follows"), REASONS[1]).when(F.col("_flips"), REASONS[2])
    found = rows.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return found.select(*KEY_COLUMNS, "reason", "_debt_change", "_use_income")


def recomputed_kpis(
    old: DataFrame, changed: DataFrame, quotes: DataFrame, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """KPI rows of the statements that ``changed`` reaches, and of no others."""
    return _kpis_of(old, changed, quotes, reached_rows(old, changed, split_rows))


def _kpis_of(old: DataFrame, changed: DataFrame, quotes: DataFrame, reached: DataFrame) -> DataFrame:
    reached = reached.drop("reason")
    old, changed = conform(old, STATEMENT_SCHEMA), conform(changed, STATEMENT_SCHEMA)
    kept = null_safe_join(old, changed.select(*KEY_COLUMNS).distinct(), KEY_COLUMNS, "left_anti")
    # Both parts are met with the few keys reached before they are stacked.
    wide = null_safe_join(kept, reached, KEY_COLUMNS, "inner").unionByName(null_safe_join(changed, reached, KEY_COLUMNS, "inner"))
    return kpi_columns(left_lookup(wide, quote_figures(quotes), "symbol"))


def propagate(
    old: DataFrame, landed: DataFrame, quotes: DataFrame, kpis: DataFrame, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """The KPI table ``kpis`` of ``old`` after ``landed`` statements, whose newest versions
    these are, one per key. Landed rows that change nothing cause no work."""
    changed = restated(old, landed)
    reached = _written(reached_rows(old, changed, split_rows))
    fresh = _kpis_of(old, changed, quotes, reached)
    # The keys of fresh rows are those reached, so rows need not be computed to tell which go.
    kept = null_safe_join(kpis, reached.select(*KEY_COLUMNS).distinct(), KEY_COLUMNS, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)
