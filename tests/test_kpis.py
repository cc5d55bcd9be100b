from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions import derived_names
from ledgerlark.plans import compute_kpis, with_debt_change, with_ebit
from ledgerlark.schema import BASE_COLUMNS, STATEMENT_SCHEMA

from .conftest import rows

INPUTS = (
    "total_liabilities_net_minority_interest",
    "cash_and_cash_equivalents",
    "pretax_income",
    "net_income",
    "total_debt",
    "stockholders_equity",
    "current_liabilities",
    "current_assets",
    "total_assets",
    "net_tangible_assets",
    "interest_expense",
    "ebit",
    "operating_income",
    "free_cash_flow",
)


def over(a, b):
    return None if a is None or b is None or b == 0 else a / b


def combine(function, *parts):
    return None if any(p is None for p in parts) else function(*parts)


def expected_row(s, quote, ebit, debt_change):
    price, shares = quote
    minus = lambda a, b: combine(lambda x, y: x - y, a, b)
    plus = lambda a, b: combine(lambda x, y: x + y, a, b)
    liabilities, cash = s["total_liabilities_net_minority_interest"], s["cash_and_cash_equivalents"]
    book, market = minus(s["total_assets"], liabilities), combine(lambda x, y: x * y, shares, price)
    service = plus(debt_change, s["interest_expense"])
    return [
        price,
        shares,
        liabilities,
        minus(liabilities, cash),
        minus(s["pretax_income"], s["net_income"]),
        over(s["total_debt"], s["stockholders_equity"]),
        over(minus(liabilities, cash), s["stockholders_equity"]),
        over(s["current_liabilities"], s["stockholders_equity"]),
        over(s["current_assets"], s["current_liabilities"]),
        minus(s["total_assets"], s["net_tangible_assets"]),
        book,
        market,
        over(market, book),
        over(cash, s["current_assets"]),
        over(cash, shares),
        over(s["total_debt"], liabilities),
        over(s["total_debt"], s["total_assets"]),
        service,
        over(s["net_income"], service),
        over(s["net_income"], shares),
        over(ebit, minus(s["total_assets"], s["current_liabilities"])),
        over(s["net_income"], s["stockholders_equity"]),
        over(s["net_income"], s["total_assets"]),
        over(s["net_income"], s["net_tangible_assets"]),
        over(s["free_cash_flow"], shares),
        over(price, s["free_cash_flow"]),
        plus(market, s["total_debt"]),
    ]


def make_panel(spark, seed=0, symbols=6, years=5):
    rng = random.Random(seed)
    panel = []
    for n in range(symbols):
        for year in range(years):
            figure = lambda: rng.choice([None, 0.0, rng.uniform(-50, 50), rng.uniform(1, 99)])
            panel.append((f"S{n}", dt.datetime(2015 + year, 12, 31), "12M", *[figure() for _ in INPUTS]))
    schema = "symbol string, as_of_date timestamp_ntz, period_type string, "
    return panel, spark.createDataFrame(panel, schema + ", ".join(f"{c} double" for c in INPUTS))


QUOTES = {"S0": (10.0, 1000.0), "S1": (None, 5.0), "S2": (3.5, 0.0), "S3": (2.0, None), "S4": (7.0, 20.0)}


def make_quotes(spark):
    data = [(s, *q) for s, q in QUOTES.items()]
    return spark.createDataFrame(data, "symbol string, twoHundredDayAverage double, sharesOutstanding double")


@pytest.mark.parametrize("split_rows", [4_000_000, 2])
def test_all_columns_against_plain_python(spark, split_rows):
    panel, df = make_panel(spark)
    out = compute_kpis(df, make_quotes(spark), split_rows=split_rows)
    assert out.columns == [*BASE_COLUMNS, *derived_names()]
    got = {(r["symbol"], r["as_of_date"]): r for r in out.collect()}
    assert len(got) == len(panel)
    names = ("symbol", "as_of_date", "period_type", *INPUTS)
    statements = [dict(zip(names, row)) for row in panel]
    for s in statements:
        same = [x for x in statements if x["symbol"] == s["symbol"]]
        ebit = s["operating_income"] if any(x["ebit"] == 0 for x in same) else s["ebit"]
        before = [x for x in same if x["as_of_date"] < s["as_of_date"]]
        change = combine(lambda a, b: a - b, s["total_debt"], before[-1]["total_debt"]) if before else None
        row = got[s["symbol"], s["as_of_date"]]
        wanted = expected_row(s, QUOTES.get(s["symbol"], (None, None)), ebit, change)
        for name, value in zip(derived_names(), wanted):
            assert row[name] == (None if value is None else pytest.approx(value)), name
        assert row["ebit"] == ebit
        assert row["accounts_payable"] is None


def test_ebit_fallback(spark):
    data = [("a", 0.0, 5.0), ("a", None, 6.0), ("b", None, 7.0), ("b", 3.0, 8.0), ("c", math.nan, 9.0)]
    df = spark.createDataFrame(data, "symbol string, ebit double, operating_income double")
    literal = [("a", 5.0), ("a", 6.0), ("b", 3.0), ("b", None)]
    for split_rows in (100, 1):  # as a window, as a join
        out = with_ebit(df.where("symbol <> 'c'"), split_rows=split_rows)
        assert out.columns == df.columns
        assert rows(out, "symbol", "ebit") == sorted(literal, key=repr)
    missing = rows(with_ebit(df, "missing"), "symbol", "ebit")
    assert missing == [("a", 0.0), ("a", 6.0), ("b", 3.0), ("b", 7.0), ("c", 9.0)]
    with pytest.raises(ValueError):
        with_ebit(df, "other")


def test_debt_change_ignores_row_order(spark):
    data = [(4, 4.0), (3, None), (2, 2.0), (1, 1.0)]
    df = spark.createDataFrame(
        [("a", dt.datetime(2000 + y, 1, 1), "12M", d) for y, d in data],
        "symbol string, as_of_date timestamp_ntz, period_type string, total_debt double",
    )
    out = with_debt_change(df).orderBy("as_of_date").collect()
    assert [r["_debt_change"] for r in out] == [None, 1.0, None, None]


def test_ingested_infinity_and_nan_become_null(spark):
    df = spark.createDataFrame(
        [("a", dt.datetime(2020, 1, 1), "12M", math.inf, 2.0, math.nan)],
        "symbol string, as_of_date timestamp_ntz, period_type string,"
        " total_debt double, stockholders_equity double, total_assets double",
    )
    row = compute_kpis(df, make_quotes(spark)).first()
    assert row["total_debt"] is None and row["total_assets"] is None
    assert row["debt_to_equity"] is None and row["debt_ratio"] is None


def test_schema_of_the_result(spark):
    _, df = make_panel(spark)
    out = compute_kpis(df.limit(0), make_quotes(spark))
    assert len(out.columns) == 184
    assert out.select(*BASE_COLUMNS).schema.simpleString() == STATEMENT_SCHEMA.simpleString()
    assert all(isinstance(out.schema[c].dataType, T.DoubleType) for c in derived_names())
    assert out.count() == 0


def test_partitioning_does_not_change_results(spark):
    _, df = make_panel(spark, seed=3)
    picked = ["symbol", "as_of_date", "debt_service", "return_on_capital_employed"]
    one = rows(compute_kpis(df.coalesce(1), make_quotes(spark)), *picked)
    many = rows(compute_kpis(df.repartition(13, F.rand(1)), make_quotes(spark)), *picked)
    assert one == many
