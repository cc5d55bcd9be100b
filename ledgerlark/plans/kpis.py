"""KPI table: statements and quotes to 184 columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import finite, finite_sql, is_floating
from ..functions.ratios import QUOTE_COLUMNS, derived_columns
from ..operators.columns import conform
from ..operators.joins import left_lookup
from ..operators.ordered import (
    SPLIT_ROWS,
    chunked_window,
    has_heavy_keys,
    lookback_window,
    null_safe_join,
    plain_window,
    slice_heavy_keys,
)
from ..schema import LANDED, QUOTE_SCHEMA, STATEMENT_SCHEMA

EBIT_FALLBACKS = ("any_zero", "missing")
STATEMENT_ORDER = ("as_of_date", "period_type")
# The debt change reads total debt, so its window ends with it: ties then change nothing.
DEBT_ORDER = (*STATEMENT_ORDER, "total_debt")


def zero_ebit_symbols(statements: DataFrame) -> DataFrame:
    """Symbols with an EBIT of exactly 0 in any row: a filtered two-column scan, one row per symbol."""
    found = statements.where(F.col("ebit") == 0).select("symbol").distinct()
    return found.withColumn("_use_income", F.lit(True))


def with_ebit(statements: DataFrame, fallback: str = "any_zero", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """EBIT with operating income as its stand-in.

    ``any_zero``: if any EBIT of a symbol is 0, all its rows take operating
    income. ``missing``: only rows without EBIT do.
    """
    if _checked(fallback) == "missing":
        return _fill_missing_ebit(statements)
    if has_heavy_keys(statements, ["symbol"], split_rows):
        return _join_zero_ebit(statements, zero_ebit_symbols(statements))
    return _window_zero_ebit(statements)


def _checked(fallback: str) -> str:
    if fallback not in EBIT_FALLBACKS:
        raise ValueError(f"fallback must be one of {EBIT_FALLBACKS}")
    return fallback


def _fill_missing_ebit(statements: DataFrame) -> DataFrame:
    kept = F.nanvl(F.col("ebit"), F.lit(None))
    return statements.withColumn("ebit", F.coalesce(kept, F.col("operating_income")))


def _window_zero_ebit(statements: DataFrame) -> DataFrame:
    """The flag as a window, on the exchange that other windows on symbol use too."""
    any_zero = F.max(F.col("ebit") == 0).over(Window.partitionBy("symbol"))
    return _use_income(statements.withColumn("_use_income", any_zero))


def _join_zero_ebit(statements: DataFrame, flagged: DataFrame) -> DataFrame:
    """The flag as a join with one row per symbol, so the rows of a heavy symbol can be
    split. Rows without a symbol are one group here, as they are in a window."""
    return _use_income(null_safe_join(statements, flagged, ["symbol"], "left"))


def _use_income(marked: DataFrame) -> DataFrame:
    value = F.when(F.col("_use_income"), F.col("operating_income")).otherwise(F.col("ebit"))
    return marked.withColumn("ebit", value).drop("_use_income")


def with_quotes(statements: DataFrame, quotes: DataFrame) -> DataFrame:
    """Both quote figures on every row of the symbol, NULL if there is no quote."""
    return left_lookup(statements, quote_figures(quotes), "symbol")


def newest_quotes(quotes: DataFrame) -> DataFrame:
    """One quote per symbol: the one landed last, if ``landed_at`` tells; of equals
    the greatest. Quotes without a symbol are left out."""
    fields = T.StructType([STATEMENT_SCHEMA["symbol"], *QUOTE_SCHEMA.fields])
    landed = [c for c in (LANDED,) if c in quotes.columns]
    known = conform(quotes, T.StructType([*fields.fields, *[quotes.schema[c] for c in landed]]))
    figures = F.struct(*QUOTE_SCHEMA.names)
    newest = F.max_by(figures, F.struct(*landed, figures)).alias("_quote")
    return known.where(F.col("symbol").isNotNull()).groupBy("symbol").agg(newest).select("symbol", "_quote.*")


def quote_figures(quotes: DataFrame) -> DataFrame:
    """The newest quote per symbol under the names of the KPI columns."""
    return newest_quotes(quotes).select("symbol", *[F.col(field).alias(name) for name, field in QUOTE_COLUMNS.items()])


def _debt_change(window: WindowSpec) -> dict[str, Column]:
    return {"_debt_change": F.col("total_debt") - F.lag("total_debt").over(window)}


def with_debt_change(statements: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Change of total debt from the row before, in order of date and period."""
    return lookback_window(statements, ["symbol"], DEBT_ORDER, 1, _debt_change, split_rows)


def compute_kpis(
    statements: DataFrame,
    quotes: DataFrame,
    ebit_fallback: str = "any_zero",
    split_rows: int = SPLIT_ROWS,
    symbols: DataFrame | None = None,
    heavy: bool | None = None,
) -> DataFrame:
    """One KPI row per statement row: 157 base and 27 derived columns.

    ``statements`` has snake_case names; ``quotes`` has ``symbol`` and the vendor
    quote fields. With ``symbols`` only the statements of those symbols are taken.
    Unless a symbol is heavy, both windows share one exchange on symbol, and so do
    the joins with tables too big to broadcast. All columns are computed in one
    projection. NaN and infinity become NULL. ``heavy`` tells whether a symbol is
    heavy, where that was measured before.
    """
    _checked(ebit_fallback)
    base = conform(statements, STATEMENT_SCHEMA)
    # Heavy symbols are measured before the semi-join, so that this stays a plain aggregate.
    cut = slice_heavy_keys(base, ["symbol"], DEBT_ORDER, split_rows, heavy=heavy)
    rows = base if cut is None else cut
    if symbols is not None:
        rows = rows.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    if cut is None:
        rows = plain_window(rows, ["symbol"], DEBT_ORDER, _debt_change)
    else:
        rows = chunked_window(rows, ["symbol"], DEBT_ORDER, 1, _debt_change, split_rows)
    facts = quote_figures(quotes)
    if ebit_fallback == "missing":
        rows = _fill_missing_ebit(rows)
    elif cut is None:
        rows = _window_zero_ebit(rows)
    else:
        # All facts of a symbol in one table first: adaptive execution does not
        # split a heavy symbol in two joins that follow one another.
        flags = zero_ebit_symbols(base).withColumnRenamed("symbol", "_flagged")
        joined = facts.join(flags, F.col("symbol") == F.col("_flagged"), "full")
        facts = joined.withColumn("symbol", F.coalesce("symbol", "_flagged")).drop("_flagged")
    if cut is None:
        rows = left_lookup(rows, facts, "symbol")
    else:  # the rows without a symbol have a flag, though no quote
        rows = null_safe_join(rows, facts, ["symbol"], "left")
    return kpi_columns(rows)


def kpi_columns(rows: DataFrame) -> DataFrame:
    """The 184 columns from statement rows with the quote columns, ``_debt_change`` and, if
    the EBIT rule is still open, its flag ``_use_income``."""
    if "_use_income" in rows.columns:
        rows = _use_income(rows)
    derived = derived_columns(F.col("ebit"), F.col("_debt_change"))
    return rows.select(
        *[F.expr(finite_sql(f.name)) if is_floating(f.dataType) else f.name for f in STATEMENT_SCHEMA.fields],
        *[finite(value).alias(name) for name, value in derived.items()],
    )
