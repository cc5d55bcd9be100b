"""The 27 derived KPI columns as one ordered set of expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import ratio

# Vendor field behind each of the two quote columns.
QUOTE_COLUMNS = {
    "two_hundred_day_avg_share_price": "twoHundredDayAverage",
    "shares_outstanding": "sharesOutstanding",
}


def derived_columns(ebit: Column, debt_change: Column) -> dict[str, Column]:
    """Derived columns in output order, over base columns and the quote columns.

    ``ebit`` is EBIT after its fallback, ``debt_change`` the year-on-year change
    of total debt. Quirks kept on purpose: ``quick_ratio`` is current liabilities
    over equity, ``enterprise_value`` does not subtract cash,
    ``price_to_free_cash_flow`` divides a per-share price by total cash flow, and
    today's two quote figures apply to all past years.
    """
    col = F.col
    price, shares = col("two_hundred_day_avg_share_price"), col("shares_outstanding")
    assets, debt, equity = col("total_assets"), col("total_debt"), col("stockholders_equity")
    liabilities = col("total_liabilities_net_minority_interest")
    cash, income = col("cash_and_cash_equivalents"), col("net_income")
    current_assets, current_liabilities = col("current_assets"), col("current_liabilities")

    net_liabilities = liabilities - cash
    book_value = assets - liabilities
    market_value = shares * price
    debt_service = debt_change + col("interest_expense")

    return {
        "two_hundred_day_avg_share_price": price,
        "shares_outstanding": shares,
        "total_liabilities": liabilities,
        "total_net_liabilities": net_liabilities,
        "tax_expense": col("pretax_income") - income,
        "debt_to_equity": ratio(debt, equity),
        "net_debt_to_equity": ratio(net_liabilities, equity),
        "quick_ratio": ratio(current_liabilities, equity),
        "current_ratio": ratio(current_assets, current_liabilities),
        "intangible_assets": assets - col("net_tangible_assets"),
        "book_value": book_value,
        "market_value": market_value,
        "price_to_book": ratio(market_value, book_value),
        "cash_to_current_assets": ratio(cash, current_assets),
        "cash_per_share": ratio(cash, shares),
        "debt_quality_ratio": ratio(debt, liabilities),
        "debt_ratio": ratio(debt, assets),
        "debt_service": debt_service,
        "debt_service_coverage_ratio": ratio(income, debt_service),
        "earnings_per_share": ratio(income, shares),
        "return_on_capital_employed": ratio(ebit, assets - current_liabilities),
        "return_on_equity": ratio(income, equity),
        "return_on_assets": ratio(income, assets),
        "return_on_net_assets": ratio(income, col("net_tangible_assets")),
        "free_cash_flow_per_share": ratio(col("free_cash_flow"), shares),
        "price_to_free_cash_flow": ratio(price, col("free_cash_flow")),
        "enterprise_value": market_value + debt,
    }


def derived_names() -> tuple[str, ...]:
    """Names of the derived columns in output order; needs a session."""
    return tuple(derived_columns(F.lit(0.0), F.lit(0.0)))
