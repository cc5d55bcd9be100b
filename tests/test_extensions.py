from __future__ import annotations

import datetime as dt
import math

import pytest

from ledgerlark.plans import compute_kpis
from ledgerlark.plans.extensions import growth_and_yields, insider_purchases, short_interest, split_effect, to_usd

from .conftest import rows


def day(y, m=1, d=1):
    return dt.datetime(y, m, d)


@pytest.mark.parametrize("split_rows", [1000, 1])
def test_growth_and_yields(spark, split_rows):
    names = (
        "free_cash_flow net_income total_revenue total_debt cash_cash_equivalents_and_short_term_investments"
        " normalized_ebitda repurchase_of_capital_stock ebit tax_rate_for_calcs invested_capital cash_dividends_paid"
    ).split()
    data = [
        ("A", day(2019), "12M", 10.0, 100.0, 50.0, 20.0, 30.0, 40.0, -8.0, 12.0, 0.25, 90.0, -25.0),
        ("A", day(2020), "12M", 15.0, 150.0, 0.0, 20.0, 30.0, 0.0, None, 12.0, 0.25, 90.0, -25.0),
    ]
    statements = spark.createDataFrame(
        data, "symbol string, as_of_date timestamp_ntz, period_type string, " + ", ".join(f"{n} double" for n in names)
    )
    quotes = spark.createDataFrame([("A", 2.0, 100.0)], "symbol string, twoHundredDayAverage double, sharesOutstanding double")
    first, second = growth_and_yields(compute_kpis(statements, quotes), split_rows).orderBy("as_of_date").collect()
    assert first["free_cash_flow_growth"] is None and second["free_cash_flow_growth"] == pytest.approx(0.5)
    assert first["net_cash"] == 10.0
    assert first["free_cash_flow_margin"] == 0.2 and second["free_cash_flow_margin"] is None
    assert first["ev_to_sales"] == 4.4 and first["ev_to_ebitda"] == 5.5 and second["ev_to_ebitda"] is None
    assert first["free_cash_flow_yield"] == 0.05
    assert first["buyback_yield"] == 0.04 and second["buyback_yield"] is None
    assert first["return_on_invested_capital"] == pytest.approx(0.1)
    assert first["payout_ratio"] == 0.25
    assert second["peg_ratio"] == pytest.approx((2.0 / 1.5) / 50)


def test_short_interest(spark):
    df = spark.createDataFrame([(1.0, 4.0, 8.0), (1.0, 0.0, None)], "sharesShort double, floatShares double, sharesOutstanding double")
    assert rows(short_interest(df), "shortToFloat", "shortToShares") == [(0.25, 0.125), (None, None)]


@pytest.mark.parametrize("split_rows", [1000, 2])
def test_split_effect(spark, split_rows):
    splits = [0.0, 2.0, None, 3.0, 0.5, 0.0]
    data = [(s, day(2020, 1, n + 1), v) for s in "ab" for n, v in enumerate(splits)]
    df = spark.createDataFrame(data, "symbol string, date timestamp_ntz, splits double")
    out = split_effect(df, split_rows).where("symbol = 'b'").orderBy("date").collect()
    assert [r["split_effect"] for r in out] == pytest.approx([1, 2, 2, 6, 3, 3])
    assert not any(math.isnan(r["split_effect"]) for r in out)


@pytest.mark.parametrize("split_rows", [1000, 2])
def test_to_usd(spark, split_rows):
    table = spark.createDataFrame(
        [("A", "EUR", day(2020, 6), 10.0), ("B", "USD", day(2020, 6), 7.0), ("C", "EUR", day(2019), 1.0), ("D", None, day(2020), 1.0)],
        "symbol string, currency_code string, as_of_date timestamp_ntz, total_debt double",
    )
    rates = spark.createDataFrame(
        [("EUR", day(2020), 1.1), ("EUR", day(2020, 5), 1.2), ("EUR", day(2021), 9.0)],
        "currency_code string, date timestamp_ntz, usd_rate double",
    )
    out = to_usd(table, rates, ["total_debt"], split_rows=split_rows)
    assert out.columns == table.columns
    assert rows(out, "symbol", "total_debt") == [("A", 12.0), ("B", 7.0), ("C", None), ("D", None)]


def test_insider_purchases(spark):
    kpis = spark.createDataFrame([("A", day(2020)), ("B", day(2020))], "symbol string, as_of_date timestamp_ntz")
    bought = spark.createDataFrame([("A", day(2020), 5), ("A", day(2020), 6)], "symbol string, as_of_date timestamp_ntz, shares bigint")
    out = insider_purchases(kpis, bought)
    assert rows(out, "symbol", "insider_shares_bought") == [("A", 11), ("B", None)]
