"""Changed statements reach few KPI rows; the table must equal one computed anew."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlark import plans

from .conftest import rows

SCHEMA = "symbol string, as_of_date timestamp_ntz, period_type string, total_debt double, interest_expense double, ebit double, operating_income double"


def frame(spark, data):
    return spark.createDataFrame([(s, None if y is None else dt.datetime(y, 12, 31), p, d, 1.0, e, 50.0) for s, y, p, d, e in data], SCHEMA)


def quotes(spark):
    return spark.createDataFrame([("A", 2.0, 3.0), ("B", 1.0, 5.0)], "symbol string, twoHundredDayAverage double, sharesOutstanding double")


OLD = [(s, y, "12M", float(y - 2000), 4.0) for s in "ABC" for y in range(2010, 2020)] + [(None, 2010, "12M", 1.0, 2.0), (None, 2011, "12M", 1.5, 2.0)]


def reasons(spark, old, new, **split):
    old, new = frame(spark, old), frame(spark, new)
    found = plans.reached_rows(old, plans.restated(old, new), **split).collect()
    return sorted((r.symbol or "", r.as_of_date.year, r.reason) for r in found)


def test_reach_of_each_kind_of_change(spark):
    assert reasons(spark, OLD, OLD[:12]) == []  # the same again
    assert reasons(spark, OLD, [("A", 2012, "12M", 99.0, 4.0)]) == [("A", 2012, "changed"), ("A", 2013, "after a change")]
    assert reasons(spark, OLD, [("B", 2019, "12M", 99.0, 4.0)]) == [("B", 2019, "changed")]
    assert reasons(spark, OLD, [("B", 2009, "12M", 1.0, 4.0)]) == [("B", 2009, "changed"), ("B", 2010, "after a change")]
    assert reasons(spark, OLD, [("D", 2009, "12M", 1.0, 0.0)]) == [("D", 2009, "changed")]
    flip = reasons(spark, OLD, [("C", 2015, "12M", 15.0, 0.0)])
    assert len(flip) == 10 and [r[2] for r in flip].count("EBIT rule") == 8
    assert reasons(spark, OLD, [(None, 2010, "12M", 7.0, 2.0)]) == [("", 2010, "changed"), ("", 2011, "after a change")]


@pytest.mark.parametrize("split", [{}, {"split_rows": 4}])
def test_table_equals_one_computed_anew(spark, split):
    rng = random.Random(5)
    for _ in range(2):
        new = {}
        for _ in range(12):
            key = (rng.choice(["A", "B", "C", "D", None]), rng.choice([2008, 2010, 2014, 2019, 2021, None]), rng.choice(["12M", "TTM"]))
            new[key] = (*key, rng.choice([1.0, 10.0, None, float("nan")]), rng.choice([0.0, 4.0, None]))
        merged = {r[:3]: r for r in OLD} | new
        old, landed = frame(spark, OLD), frame(spark, new.values())
        table = plans.propagate(old, landed, quotes(spark), plans.compute_kpis(old, quotes(spark)), **split)
        anew = plans.compute_kpis(frame(spark, merged.values()), quotes(spark))
        assert table.columns == anew.columns
        assert rows(table) == rows(anew)


def test_only_reached_rows_are_computed(spark):
    many = [(f"S{i}", y, "12M", float(y), 4.0) for i in range(200) for y in range(2000, 2010)]
    old, new = frame(spark, many), frame(spark, [("S3", 2004, "12M", 1.0, 4.0), ("S7", 2009, "12M", 2009.0, 4.0)])
    fresh = plans.recomputed_kpis(old, plans.restated(old, new), quotes(spark))
    assert rows(fresh, "symbol", "total_debt", "debt_service") == [("S3", 1.0, -2001.0), ("S3", 2005.0, 2005.0)]


def test_shared_steps_are_run_once(spark):
    """The old panel is read by a bounded number of steps, and changed rows are not joined again for each of them."""
    runs = spark.sparkContext.accumulator(0)

    def seen(symbol):
        runs.add(1)
        return symbol

    mark = F.udf(seen, "string").asNondeterministic()
    source = spark.range(50).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("symbol"), F.to_timestamp_ntz(F.lit("2024-12-31")).alias("as_of_date"), F.lit("12M").alias("period_type"), F.col("id").cast("double").alias("total_debt"))
    landed = source.withColumn("symbol", mark("symbol")).withColumn("total_debt", F.col("total_debt") + 1)
    fresh = plans.propagate(source, landed, quotes(spark), plans.compute_kpis(source, quotes(spark)))
    assert fresh.count() == 50 and fresh.where("total_debt >= 1").count() == 50
    assert runs.value == 50
