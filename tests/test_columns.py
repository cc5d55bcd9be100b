from __future__ import annotations

import pytest
from pyspark.sql import types as T

from ledgerlark.operators import (
    column_difference,
    concat_tables,
    conform,
    drop_all_null_columns,
    drop_columns,
    move_column,
    rearrange,
    rename_snake,
    sort_columns,
)
from ledgerlark.plans.screening import COLUMN_PROGRAM

from .conftest import ordered, rows


@pytest.fixture()
def five(spark):
    return spark.createDataFrame([(1, 2, 3, 4, 5)], "a int, b int, c int, d int, e int")


def test_rename_snake(spark):
    df = spark.createDataFrame([(1, 2)], "asOfDate int, NetPPE int")
    assert rename_snake(df).columns == ["as_of_date", "net_ppe"]


def test_conform(spark):
    schema = T.StructType().add("x", "double").add("gone", "string").add("s", "string")
    out = conform(spark.createDataFrame([("t", 1, 9)], "s string, x int, extra int"), schema)
    assert out.schema.simpleString() == "struct<x:double,gone:string,s:string>"
    assert ordered(out) == [(1.0, None, "t")]


def test_drop_columns(five):
    assert drop_columns(five, ["b", "zzz"]).columns == ["a", "c", "d", "e"]
    with pytest.raises(KeyError):
        drop_columns(five, ["b", "zzz"], strict=True)


def test_move_column(five):
    assert move_column(five, 1, 126).columns == ["a", "c", "d", "e", "b"]
    assert move_column(five, 3, 0).columns == ["d", "a", "b", "c", "e"]
    assert move_column(five, 0, 2).columns == ["b", "c", "a", "d", "e"]
    assert ordered(move_column(five, 3, 0)) == [(4, 1, 2, 3, 5)]
    with pytest.raises(IndexError):
        move_column(five, 5, 0)


def test_rearrange_equals_steps_one_by_one(five):
    steps = [("move", 4, 0), ("drop", "b"), ("move", 1, 9)]
    assert rearrange(five, steps).columns == move_column(drop_columns(move_column(five, 4, 0), ["b"]), 1, 9).columns
    with pytest.raises(KeyError):
        rearrange(five, [("drop", "zzz")], strict=True)
    with pytest.raises(ValueError):
        rearrange(five, [("swap", 1, 2)])


def test_column_program_on_a_wide_table(spark):
    """The whole program against list operations on 130 columns."""
    names = [f"c{n}" for n in range(120)] + [name for action, name, *_ in COLUMN_PROGRAM if action == "drop"]
    expected = list(names)
    for action, first, *second in COLUMN_PROGRAM:
        if action == "drop":
            expected.remove(first)
        else:
            expected.insert(second[0], expected.pop(first))
    df = spark.createDataFrame([tuple(range(len(names)))], ", ".join(f"{n} int" for n in names))
    assert rearrange(df, COLUMN_PROGRAM, strict=True).columns == expected


def test_drop_all_null_columns(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, None, nan, nan), (None, None, nan, 2.0)], "a int, b string, c double, d double")
    assert drop_all_null_columns(df).columns == ["a", "d"]
    assert drop_all_null_columns(df.limit(0)).columns == []


def test_sorted_and_difference(five, spark):
    other = spark.createDataFrame([(1, 2)], "c int, z int")
    assert sort_columns(five.select("d", "a", "c")).columns == ["a", "c", "d"]
    assert column_difference(five, other) == ["a", "b", "d", "e"]


def test_concat_keeps_duplicates(spark):
    one = spark.createDataFrame([("A",), ("A",)], "symbol string")
    two = spark.createDataFrame([(1, "A")], "n int, symbol string")
    assert rows(concat_tables(one, two)) == [("A", 1), ("A", None), ("A", None)]


def test_input_of_all_null_check_runs_once(spark):
    """The rows are counted while they are written: one job, and each row is made once."""
    made = spark.sparkContext.accumulator(0)

    def tracked(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    df = spark.range(0, 100, numPartitions=3).selectExpr("id", "cast(null as string) AS nothing")
    df = df.mapInPandas(tracked, "id long, nothing string").selectExpr("*", "null AS untyped")
    spark.sparkContext.setJobGroup("once", "all-null check")
    try:
        filled = drop_all_null_columns(df)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("once")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert filled.columns == ["id"] and filled.count() == 100
    assert len(jobs) == 1
    assert made.value == 100
