"""Extensions: figures that are only wished for, with their standard definitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.numbers import finite, ratio
from ..operators.joins import left_lookup
from ..operators.ordered import BROADCAST_ROWS, SPLIT_ROWS, lookback_window, running_total
from ..operators.steps import step_join
from .kpis import STATEMENT_ORDER, newest_quotes


_RATE = "_usd_rate"
GROWING = ("free_cash_flow", "earnings_per_share")


def growth_and_yields(kpis: DataFrame, split_rows: int = SPLIT_ROWS, heavy: bool | None = None) -> DataFrame:
    """Add growth, margin, yield and valuation figures to KPI rows. ``heavy`` tells
    whether a symbol is heavy, as it is if it was among the statements."""
    col = F.col
    market_value, value = col("market_value"), col("enterprise_value")

    def growth(window: WindowSpec) -> dict[str, Column]:
        return {
            f"{name}_growth": ratio(col(name), F.lag(name).over(window)) - 1
            for name in GROWING
        }

    grown = lookback_window(kpis, ["symbol"], [*STATEMENT_ORDER, *GROWING], 1, growth, split_rows, heavy=heavy)
    price_to_earnings = ratio(col("two_hundred_day_avg_share_price"), col("earnings_per_share"))
    figures = {
        "net_cash": col("cash_cash_equivalents_and_short_term_investments") - col("total_debt"),
        "free_cash_flow_margin": ratio(col("free_cash_flow"), col("total_revenue")),
        "peg_ratio": ratio(price_to_earnings, col("earnings_per_share_growth") * 100),
        "ev_to_sales": ratio(value, col("total_revenue")),
        "ev_to_ebitda": ratio(value, col("normalized_ebitda")),
        "free_cash_flow_yield": ratio(col("free_cash_flow"), market_value),
        "buyback_yield": ratio(-col("repurchase_of_capital_stock"), market_value),
        "return_on_invested_capital": ratio(col("ebit") * (1 - col("tax_rate_for_calcs")), col("invested_capital")),
        "payout_ratio": ratio(-col("cash_dividends_paid"), col("net_income")),
    }
    return grown.select("*", *[finite(v).alias(name) for name, v in figures.items()])


def short_interest(metrics: DataFrame) -> DataFrame:
    """Add shares sold short over the float and over all shares."""
    return metrics.select(
        "*",
        ratio(F.col("sharesShort"), F.col("floatShares")).alias("shortToFloat"),
        ratio(F.col("sharesShort"), F.col("sharesOutstanding")).alias("shortToShares"),
    )


def with_order_sizes(kpis: DataFrame, quotes: DataFrame) -> DataFrame:
    """Add today's bid and ask size of the symbol to KPI rows."""
    sizes = newest_quotes(quotes).select("symbol", F.col("bidSize").alias("bid_size"), F.col("askSize").alias("ask_size"))
    return left_lookup(kpis, sizes, "symbol")


def split_effect(history: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Add the cumulative split factor per symbol; 0 and NULL mean no split that day."""
    logs = history.withColumn("_log", F.when(F.col("splits") > 0, F.ln("splits")).otherwise(F.lit(0.0)))
    summed = running_total(logs, ["symbol"], ["date"], "_log", "_logs", split_rows)
    return summed.select(*history.columns, F.exp("_logs").alias("split_effect"))


def to_usd(
    table: DataFrame,
    rates: DataFrame,
    money: Sequence[str],
    date: str = "as_of_date",
    split_rows: int = SPLIT_ROWS,
    max_steps: int = BROADCAST_ROWS,
) -> DataFrame:
    """Convert the money columns with the last rate at or before the row's date.

    ``rates`` has ``currency_code``, ``date`` and ``usd_rate``. Dollars keep their
    value; a row without a rate gets NULL. Rates are folded to the days at which they change;
    up to ``max_steps`` of these are broadcast as sorted arrays, and rows stay where they are.
    """
    rated = step_join(table, rates.withColumnRenamed("usd_rate", _RATE), ["currency_code"], date, "date", [_RATE], split_rows, max_steps)
    rate = F.when(F.col("currency_code") == "USD", F.lit(1.0)).otherwise(F.col(_RATE))
    return rated.select(*[(F.col(f"`{c}`") * rate).alias(c) if c in money else F.col(f"`{c}`") for c in table.columns])


def insider_purchases(kpis: DataFrame, purchases: DataFrame) -> DataFrame:
    """Add the shares that insiders bought per symbol and period.

    ``purchases`` has ``symbol``, ``as_of_date`` and ``shares``.
    """
    bought = purchases.groupBy("symbol", "as_of_date").agg(F.sum("shares").alias("insider_shares_bought"))
    return kpis.join(bought, ["symbol", "as_of_date"], "left").select(*kpis.columns, "insider_shares_bought")
