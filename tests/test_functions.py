from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import (
    camel_to_snake,
    derived_columns,
    derived_names,
    host_port,
    market_cap_millions,
    nan_to_null,
    ratio,
    snake_name,
    stamp_text,
)
from ledgerlark.functions.numbers import infinity_to_null

from ledgerlark.schema import BASE_COLUMNS

from .conftest import ordered

NAMES = {
    "asOfDate": "as_of_date",
    "NetPPE": "net_ppe",
    "EBIT": "ebit",
    "BasicEPS": "basic_eps",
    "TradeandOtherPayablesNonCurrent": "tradeand_other_payables_non_current",
    "DilutedNIAvailtoComStockholders": "diluted_ni_availto_com_stockholders",
    "already_snake": "already_snake",
}


def test_snake_case_of_values_and_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string").select(
        "name", camel_to_snake(F.col("name")).alias("snake")
    )
    assert dict(ordered(df)) == NAMES
    assert {name: snake_name(name) for name in NAMES} == NAMES


CAPS = {
    "$1.5B": 1500.0,
    "$250M": 250.0,
    "$3000000": 3.0,
    "": 0.0,
    "1234567": 0.234567,
    None: None,
    "$1M2B": None,
    "M": None,
    "$xM": None,
}


@pytest.mark.parametrize("empty_as_zero", [True, False])
def test_market_cap(spark, empty_as_zero):
    df = spark.createDataFrame([(t,) for t in CAPS], "t string").select(
        "t", market_cap_millions(F.col("t"), empty_as_zero).alias("cap")
    )
    expected = dict(CAPS) if empty_as_zero else CAPS | {"": None}
    got = dict(ordered(df))
    for text, value in expected.items():
        assert got[text] == (pytest.approx(value) if value is not None else None), text


def test_ratio_is_null_for_zero_and_missing(spark):
    df = spark.createDataFrame(
        [(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (None, 1.0), (1.0, None), (1.0, -0.0), (3.0, 2.0)], "a double, b double"
    )
    assert ordered(df.select(ratio(F.col("a"), F.col("b")))) == [(None,)] * 6 + [(1.5,)]


def test_nan_and_infinity(spark):
    values = [float("nan"), float("inf"), float("-inf"), 1.0, None]
    df = spark.createDataFrame([(v, "x") for v in values], "v double, `odd name` string")
    nan_free = [v for v, _ in ordered(nan_to_null(df))]
    assert nan_free == [None, math.inf, -math.inf, 1.0, None]
    assert [v for v, _ in ordered(infinity_to_null(df))] == [None, None, None, 1.0, None]
    assert nan_to_null(df).columns == df.columns


def test_host_port(spark):
    df = spark.createDataFrame([("h", "1"), (None, "1"), ("h", None)], "h string, p string")
    assert ordered(df.select(host_port(F.col("h"), F.col("p")))) == [("h:1",), (None,), (None,)]


def test_stamp_text(spark):
    stamp = dt.datetime(2024, 1, 2, 3, 4, 5, 678)
    df = spark.createDataFrame([(stamp,)], "t timestamp_ntz")
    assert ordered(df.select(stamp_text(F.col("t")))) == [("2024-01-02-03-04-05",)]


def test_derived_column_order():
    assert len(derived_names()) == 27


def test_derived_names(spark):
    assert tuple(derived_columns(F.col("ebit"), F.lit(0.0))) == derived_names()


def test_snake_name_equals_the_expression(spark):
    names = ["NetPPE", "EBIT", "BasicEPS", "TradeandOtherPayablesNonCurrent", "A", "", "aB", "ABc", "x9Y", "X_Yz", "HTTPServerError2Go", "camelCase", "ÄbC", "A1B2c"]
    names += ["".join(part.capitalize() for part in name.split("_")) for name in BASE_COLUMNS]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert ordered(df.select(camel_to_snake(F.col("n")))) == [(snake_name(n),) for n in names]


def test_market_cap_is_finite(spark):
    df = spark.createDataFrame([("$NaN",), ("$Infinity",), ("$NaNB",), ("$1.5B",)], "t string")
    assert ordered(df.select(market_cap_millions(F.col("t")))) == [(None,), (None,), (None,), (1500.0,)]
