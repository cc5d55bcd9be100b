"""Shape of the physical plans."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from ledgerlark import sources
from ledgerlark.plans import average_history, average_history_asof, biggest_n, compute_kpis, rolling_average, safe_metrics

from .conftest import plan_text, rows
from .test_kpis import make_panel, make_quotes

def test_both_windows_share_one_exchange(spark, tmp_path):
    _, df = make_panel(spark)
    df.write.parquet(str(tmp_path / "s"))
    make_quotes(spark).write.parquet(str(tmp_path / "q"))
    plan = plan_text(compute_kpis(spark.read.parquet(str(tmp_path / "s")), spark.read.parquet(str(tmp_path / "q"))))
    # One for both windows, one to find the newest quote of each symbol.
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
    assert "BroadcastHashJoin" in plan


def test_rolling_average_sorts_once(spark, tmp_path):
    path = str(tmp_path / "h")
    spark.range(10).select(F.lit("A").alias("symbol"), F.current_date().alias("date"), F.rand(1).alias("close")).write.parquet(path)
    plan = plan_text(rolling_average(spark.read.parquet(path), 120))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert len(re.findall(r"Sort \[", plan)) == 1


def test_unused_kpis_cost_nothing(spark, tmp_path):
    _, df = make_panel(spark)
    df.write.parquet(str(tmp_path / "s"))
    kpis = compute_kpis(spark.read.parquet(str(tmp_path / "s")), make_quotes(spark)).select("symbol", "debt_ratio")
    plan = plan_text(kpis)
    assert "Window" not in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["symbol", "total_assets", "total_debt"]


def test_bucketed_statements_need_no_exchange(spark, tmp_path):
    _, df = make_panel(spark)
    sources.write_bucketed(df, "bucketed_statements", 4)
    make_quotes(spark).write.parquet(str(tmp_path / "q"))
    kpis = compute_kpis(spark.table("bucketed_statements"), spark.read.parquet(str(tmp_path / "q")))
    assert "Window" in plan_text(kpis)
    # Only the quotes move.
    assert len(re.findall(r"Exchange hashpartitioning", plan_text(kpis))) == 1
    assert kpis.count() == df.count()


def test_lookup_and_window_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "h")
    spark.range(10).select(F.lit("A").alias("symbol"), F.current_date().alias("date"), F.rand(1).alias("close")).write.parquet(path)
    history = spark.read.parquet(path)
    assert "EqualTo(symbol,A)" in plan_text(sources.lookup(history, "A"))
    assert "EqualTo(symbol,A)" in plan_text(sources.lookup(rolling_average(history, 3, ["close"]), "A"))


def test_screen_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "m")
    schema = "symbol string, shortRatio double, pegRatio double, payoutRatio double, debtToEquity double"
    spark.createDataFrame([("A", 1.0, 1.0, 0.1, 1.0)], schema).write.parquet(path)
    plan = plan_text(safe_metrics(spark.read.parquet(path)))
    for bound in ("LessThan(shortRatio,3.0)", "LessThan(pegRatio,1.5)", "LessThan(payoutRatio,0.6)", "LessThan(debtToEquity,200.0)"):
        assert bound in plan


def test_top_n_takes_ordered(spark):
    schema = "exchange string, symbol string, marketCap string, sector string"
    df = spark.createDataFrame([("nyse", "A", "$1B", "Energy")], schema)
    assert "TakeOrderedAndProject" in plan_text(biggest_n(df, 1, strict=False))


@pytest.mark.parametrize("form", [average_history, average_history_asof])
def test_dates_and_rolling_means_share_one_exchange(spark, form):
    day = F.timestamp_add("DAY", "id", F.lit("2024-01-01").cast("timestamp_ntz"))
    history = spark.range(400).select(F.concat(F.lit("S"), F.col("id") % 5).alias("symbol"), day.alias("date"), F.col("id").cast("double").alias("close"))
    dates = history.where("id % 7 = 0").select("symbol", "date")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        out = form(history, dates, period=4)
        assert len(re.findall("Exchange hashpartitioning", plan_text(out))) == 1
        split = form(history, dates, period=4, split_rows=20)
        assert rows(out, "symbol", "date", "close") == rows(split, "symbol", "date", "close")
    finally:
        spark.conf.set(threshold, before)
