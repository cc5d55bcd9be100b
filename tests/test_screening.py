from __future__ import annotations

import math

import pytest

from ledgerlark.plans import beta_view, reorder_columns, safe_metrics, scatter_data, screen

from .conftest import ordered, rows

SCHEMA = "symbol string, shortRatio double, pegRatio double, payoutRatio double, debtToEquity double"


def test_safe_metrics_bounds(spark):
    data = [
        ("in", 2.9, 1.4, 0.5, 199.0),
        ("negative", 1.0, -5.0, -1.0, -3.0),
        ("edge_short", 3.0, 1.0, 0.1, 1.0),
        ("edge_peg", 1.0, 1.5, 0.1, 1.0),
        ("edge_payout", 1.0, 1.0, 0.6, 1.0),
        ("edge_debt", 1.0, 1.0, 0.1, 200.0),
        ("null", None, 1.0, 0.1, 1.0),
        ("nan", math.nan, 1.0, 0.1, 1.0),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    kept = safe_metrics(df)
    assert rows(kept, "symbol") == [("in",), ("negative",)]
    assert kept.exceptAll(df).count() == 0
    assert rows(safe_metrics(df, {"pegRatio": 0.0}), "symbol") == [("negative",)]


def ranked_table(spark):
    data = [("b", 2.0, 1.0), ("c", None, 0.5), ("z", 1.0, None), ("a", 1.0, 0.5), ("d", math.nan, -1.0)]
    return spark.createDataFrame(data, "symbol string, recommendationMean double, beta double")


def test_reorder_sorts_by_recommendation(spark):
    out = reorder_columns(ranked_table(spark), [("move", 2, 0), ("drop", "fax")])
    assert out.columns == ["beta", "symbol", "recommendationMean"]
    assert [r["symbol"] for r in out.collect()] == ["a", "z", "b", "c", "d"]


def test_beta_view(spark):
    assert [r["symbol"] for r in beta_view(ranked_table(spark)).collect()] == ["d", "a", "c", "b", "z"]


def test_scatter_data(spark):
    df = spark.createDataFrame([(1, "x", 1.0, "s", "buy")], "n int, symbol string, beta double, sector string, recommendationKey string")
    assert ordered(scatter_data(df)) == [("x", 1.0, "s", "buy")]


def test_screen(spark, tmp_path):
    data = [("b", 1.0, 1.0, 0.1, 1.0, 2.0, None), ("a", 1.0, 1.0, 0.1, 1.0, 1.0, None), ("out", 9.0, 1.0, 0.1, 1.0, 0.5, "x")]
    df = spark.createDataFrame(data, SCHEMA + ", recommendationMean double, fax string")
    path = str(tmp_path / "kept")
    out = screen(df, program=[("move", 0, 9)], csv_path=path)
    assert out.columns == ["shortRatio", "pegRatio", "payoutRatio", "debtToEquity", "recommendationMean", "symbol"]
    assert [r["symbol"] for r in out.collect()] == ["a", "b"]
    written = spark.read.option("header", True).csv(path)
    assert written.columns[0] == "symbol" and "fax" not in written.columns
    assert rows(written, "symbol") == [("a",), ("b",)]


def test_column_program_needs_a_wide_table(spark):
    with pytest.raises(IndexError):
        reorder_columns(ranked_table(spark))
