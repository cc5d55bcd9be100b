from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import latest_rows, merge_new_columns, outer_merge, pending, ranked, top_n, upsert
from ledgerlark.operators.copies import repeat_rows

from .conftest import ordered, rows


def pairs(spark, data):
    return spark.createDataFrame(data, "a int, b int")


def test_outer_merge_is_null_safe(spark):
    old = pairs(spark, [(1, 1), (1, None), (2, 3)])
    new = pairs(spark, [(1, None), (1, None), (3, 4)])
    assert rows(outer_merge(old, new)) == sorted([(1, 1), (1, None), (1, None), (2, 3), (3, 4)], key=repr)


def test_outer_merge_multiplies_copies(spark):
    old = pairs(spark, [(1, 1)] * 3 + [(None, None)] * 2 + [(5, 5)] * 2)
    new = pairs(spark, [(1, 1)] * 2 + [(None, None)] + [(6, 6)] * 2).select("b", "a")
    expected = [(1, 1)] * 6 + [(None, None)] * 2 + [(5, 5)] * 2 + [(6, 6)] * 2
    assert rows(outer_merge(old, new)) == sorted(expected, key=repr)


def test_outer_merge_on_floats(spark):
    nan = float("nan")
    old = spark.createDataFrame([("x", nan), ("y", 0.0), ("z", None)], "s string, v double")
    new = spark.createDataFrame([("x", nan), ("y", -0.0), ("z", None)], "s string, v double")
    assert outer_merge(old, new).count() == 3


def test_outer_merge_with_other_columns(spark):
    old = spark.createDataFrame([(1, None, "o1"), (2, 2, "o2")], "a int, b int, c string")
    new = spark.createDataFrame([(1, None, "n1"), (3, 3, "n3")], "a int, b int, d string")
    assert rows(outer_merge(old, new)) == [(1, None, "o1", "n1"), (2, 2, "o2", None), (3, 3, None, "n3")]
    with pytest.raises(ValueError):
        outer_merge(old, new.select("d"))


def test_pending_is_an_anti_join(spark):
    listed = spark.createDataFrame([("a",), ("b",), ("c",)], "symbol string")
    done = spark.createDataFrame([("b",), ("b",), (None,)], "symbol string")
    assert rows(pending(listed, done)) == [("a",), ("c",)]
    assert rows(pending(listed, done.limit(0))) == [("a",), ("b",), ("c",)]
    both = pending(listed, done).union(listed.join(done, "symbol", "left_semi"))
    assert rows(both) == rows(listed)


def test_merge_new_columns(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, shared string")
    right = spark.createDataFrame([(1, "other", 7)], "k int, shared string, added int")
    out = merge_new_columns(left, right, ["k"])
    assert out.columns == ["added", "k", "shared"]
    assert rows(out) == sorted([(7, 1, "x"), (None, 2, "y")], key=repr)


def test_upsert_is_idempotent_and_newest_wins(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), (None, 1, 3.0)], "s string, y int, v double")
    new = spark.createDataFrame([("a", 2, 20.0), ("b", 1, 5.0), (None, 1, 30.0)], "s string, y int, v double")
    once = upsert(old, new, ["s", "y"])
    assert rows(once) == sorted([("a", 1, 1.0), ("a", 2, 20.0), ("b", 1, 5.0), (None, 1, 30.0)], key=repr)
    assert rows(upsert(once, new, ["s", "y"])) == rows(once)
    assert rows(upsert(old.limit(0), new, ["s", "y"])) == rows(new)


def test_latest_rows(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 3, "x"), ("b", 2, "y")], "k string, at int, v string")
    assert rows(latest_rows(df, ["k"], ["at"])) == [("a", 3, "x"), ("b", 2, "y")]
    assert latest_rows(df, ["k"], ["at"]).columns == df.columns


def test_ranked_over_many_partitions(spark):
    rng = random.Random(4)
    data = [(n, rng.choice([None, 1.0, 2.0, 2.0, 2.0])) for n in range(500)]
    df = spark.createDataFrame(data, "id int, v double").repartition(7)
    expected = sorted(data, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    got = ordered(ranked(df, [F.col("v").asc_nulls_last(), F.col("id")]).orderBy("rank"), "rank", "id", "v")
    assert got == [(at + 1, *row) for at, row in enumerate(expected)]


def test_ranked_empty(spark):
    assert ranked(spark.range(0).toDF("id"), [F.col("id")]).count() == 0


def test_top_n(spark):
    df = spark.range(10).toDF("id")
    order = [F.col("id").desc()]
    full = ordered(df.orderBy(*order))
    assert ordered(top_n(df, order, 4)) == full[:4]
    with pytest.raises(ValueError):
        top_n(df, order, 11)
    assert top_n(df, order, 11, strict=False).count() == 10


def test_repeat_rows_in_blocks(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 10), ("d", 11), ("e", 35)], "k string, n int")
    out = repeat_rows(df, F.col("n"), ["k"], block=10).groupBy("k").count()
    assert rows(out) == [("b", 1), ("c", 10), ("d", 11), ("e", 35)]
