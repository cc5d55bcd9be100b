"""Windows and as-of joins with heavy keys must equal their plain forms."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import asof_join, lookback_window, running_total, slice_heavy_keys
from ledgerlark.operators import ordered as ordered_module
from ledgerlark.operators.ordered import SLICE
from ledgerlark.plans import rolling_average

from .conftest import plan_text, rows

DAY0 = dt.datetime(2020, 1, 1)


def history(spark, seed, n=400, kind="even"):
    """One key holds most rows; ids break ties; some keys, dates and values are NULL."""
    rng = random.Random(seed)
    data = []
    for at in range(n):
        key = rng.choice(["hot"] * 6 + ["a", "b", None])
        if kind == "even":
            day = DAY0 + dt.timedelta(hours=rng.randrange(5 * n), microseconds=rng.randrange(10**6))
        elif kind == "burst":  # almost all rows in one minute, one row 100 years away
            day = DAY0 + dt.timedelta(seconds=rng.random() * 60) if at else dt.datetime(1920, 1, 1)
        else:  # all on one instant
            day = DAY0
        if rng.random() < 0.02:
            day = None
        data.append((key, day, at, None if rng.random() < 0.05 else round(rng.uniform(0, 100), 2)))
    return spark.createDataFrame(data, "k string, t timestamp_ntz, id bigint, v double")


def rolled(df, reach, **split):
    frame = lambda w: w.rowsBetween(-reach, 0)
    return lookback_window(
        df,
        ["k"],
        ["t", "id"],
        reach,
        lambda w: {
            "lagged": F.lag("v", reach).over(w),
            "n": F.count("v").over(frame(w)),
            "top": F.max("v").over(frame(w)),
        },
        **split,
    )


@pytest.mark.parametrize(
    "kind,reach,split_rows,slices",
    [("even", 1, 7, 16), ("burst", 9, 20, 64), ("instant", 30, 5, 64), ("even", 3, 60, 4), ("instant", 2, 20, 8)],
)
def test_split_window_equals_plain_window(spark, kind, reach, split_rows, slices):
    df = history(spark, seed=reach, kind=kind)
    plain = rolled(df, reach)
    split = rolled(df, reach, split_rows=split_rows, slices=slices)
    assert split.columns == plain.columns
    assert rows(split) == rows(plain)


def test_split_window_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ordered_module, "broadcast_if_small", lambda table, counted=None: table)
    df = history(spark, seed=5)
    assert rows(rolled(df, 4, split_rows=10, slices=32)) == rows(rolled(df, 4))


@pytest.mark.parametrize("kind", ["date", "timestamp", "bigint", "int"])
def test_other_order_types(spark, kind):
    base = history(spark, seed=11)
    moment = F.col("t").cast("timestamp")
    value = {
        "date": F.col("t").cast("date"),
        "timestamp": moment,
        "bigint": F.unix_micros(moment),
        "int": F.unix_date(F.col("t").cast("date")),
    }[kind]
    df = base.withColumn("t", value)
    assert rows(rolled(df, 2, split_rows=10, slices=16)) == rows(rolled(df, 2))


def test_slices_are_bounded_and_ordered(spark):
    df = history(spark, seed=3, n=600, kind="burst").where("t IS NOT NULL")
    cut = slice_heavy_keys(df, ["k"], ["t", "id"], split_rows=15, slices=16)
    biggest = cut.groupBy("k", SLICE).count().agg(F.max("count")).first()[0]
    assert biggest <= 15
    spans = (
        cut.where(F.size(SLICE) > 0)
        .groupBy("k", SLICE)
        .agg(F.min(F.struct("t", "id")).alias("low"), F.max(F.struct("t", "id")).alias("high"))
        .orderBy("k", SLICE)
        .collect()
    )
    for before, after in zip(spans, spans[1:]):
        assert before["k"] != after["k"] or before["high"] < after["low"]


def test_no_heavy_key(spark):
    assert slice_heavy_keys(history(spark, 1), ["k"], ["t"], split_rows=10_000) is None


def test_order_that_cannot_be_cut_is_refused(spark):
    df = history(spark, seed=2).withColumn("t", F.array("t"))
    with pytest.raises(TypeError, match="cannot be cut"):
        slice_heavy_keys(df, ["k"], ["t"], split_rows=5)
    assert slice_heavy_keys(df, ["k"], ["t"]) is None


def largest_slice(df, order, split_rows):
    cut = slice_heavy_keys(df, ["k"], order, split_rows=split_rows, slices=64)
    return cut.groupBy("k", SLICE).count().agg(F.max("count")).first()[0]


def test_slices_along_texts_and_fractions_are_bounded(spark):
    """Texts that share a long prefix, doubles of all sizes, decimals."""
    df = history(spark, seed=8, n=500)
    date = F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:"), F.lpad("id", 5, "0"))
    fraction = F.when(F.col("id") % 9 == 0, F.lit(float("nan"))).when(F.col("id") % 7 == 0, -F.exp(F.col("id") / 3)).otherwise(F.col("v") / 1e9)
    for order in (date, fraction, F.col("v").cast("decimal(12,4)")):
        placed = df.withColumn("t", order)
        assert largest_slice(placed, ["t", "id"], 20) <= 20
        texts = [rolled(placed, 3, **split).withColumn("t", F.col("t").cast("string")) for split in ({"split_rows": 20, "slices": 32}, {})]
        assert rows(texts[0]) == rows(texts[1])


def test_only_ties_read_other_columns(spark):
    """Without ties that are too many, the row hash and with it all other columns stay unread; maps do not matter."""
    df = history(spark, seed=3).withColumn("m", F.create_map(F.lit("a"), F.col("v")))
    assert "_tie" not in slice_heavy_keys(df, ["k"], ["t", "id"], split_rows=15).columns
    ties = df.withColumn("t", F.lit("same"))
    assert largest_slice(ties, ["t"], 15) <= 15


@pytest.mark.parametrize("kind", ["even", "instant"])
def test_text_order(spark, kind):
    """Text is cut by the bytes after those that all texts of a group share."""
    df = history(spark, seed=6, kind=kind)
    for text in (F.col("t").cast("string"), F.concat(F.lit("Zü"), F.col("id").cast("string"))):
        texts = df.withColumn("t", text)
        assert rows(rolled(texts, 3, split_rows=8, slices=32)) == rows(rolled(texts, 3))


def test_copies_of_one_row(spark):
    """Copies of a row are folded and unfolded; they may outnumber the rest."""
    rng = random.Random(8)
    data = [("hot", 5, 1.0)] * 300 + [("hot", 5, 2.0)] * 90 + [("hot", rng.randrange(10), 3.0) for _ in range(60)]
    data += [(None, None, 4.0)] * 70 + [("a", 1, 5.0)] * 4
    df = spark.createDataFrame(data, "k string, t int, v double").repartition(5)
    columns = lambda w: {
        "n": F.count("v").over(w.rowsBetween(-6, 0)),
        "total": F.sum("v").over(w.rowsBetween(-6, 0)),
        "lagged": F.lag("v", 6).over(w),
    }
    cut = slice_heavy_keys(df, ["k"], ["t"], 20, 4)
    assert cut.count() == len(data)
    ties = cut.select("k", "t", "v", "_tie")
    expected = lookback_window(ties, ["k"], ["t", "_tie"], 6, columns).drop("_tie")
    got = lookback_window(df, ["k"], ["t"], 6, columns, split_rows=20, slices=4)
    assert rows(got) == rows(expected)


def test_key_of_mere_copies(spark):
    df = spark.createDataFrame([("hot", 5, 1.0)] * 100 + [("a", 1, 2.0)], "k string, t int, v double")
    columns = lambda w: {"n": F.count("v").over(w.rowsBetween(-3, 0))}
    plain = lookback_window(df, ["k"], ["t"], 3, columns)
    assert rows(lookback_window(df, ["k"], ["t"], 3, columns, split_rows=10)) == rows(plain)


@pytest.mark.parametrize("split", [{}, {"split_rows": 15, "slices": 8}])
def test_running_total(spark, split):
    df = history(spark, seed=9).withColumn("v", F.col("v").cast("decimal(8,2)"))
    got = {r["id"]: r["sum"] for r in running_total(df, ["k"], ["t", "id"], "v", "sum", **split).collect()}
    sums = {}
    for r in sorted(df.collect(), key=lambda r: (r["t"] is not None, r["t"] or DAY0, r["id"])):
        before = sums.get(r["k"])
        sums[r["k"]] = before if r["v"] is None else r["v"] + (before or 0)
        assert got[r["id"]] == sums[r["k"]]


def brute_asof(left, right):
    out = []
    for k, t in left:
        best = [(u, v) for j, u, v in right if j == k and k is not None and u is not None and t is not None and u <= t]
        out.append((k, t, max(best, key=lambda p: (p[0], p[1] is not None, p[1] or 0))[1] if best else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(
    "kind,split",
    [
        ("even", {}),
        ("instant", {}),
        ("even", {"split_rows": 12, "slices": 8}),
        ("burst", {"split_rows": 5, "slices": 512}),
        ("instant", {"split_rows": 12, "slices": 8}),
    ],
)
def test_asof_against_brute_force(spark, kind, split):
    right = history(spark, seed=21, n=250, kind=kind).select("k", "t", "v")
    left = history(spark, seed=22, n=150, kind=kind).select("k", F.col("t").alias("asked"))
    expected = brute_asof([tuple(r) for r in left.collect()], [tuple(r) for r in right.collect()])
    assert rows(asof_join(left, right, ["k"], "asked", "t", ["v"], **split)) == expected


def test_asof_keeps_null_values_and_duplicates(spark):
    day = lambda n: DAY0 + dt.timedelta(days=n)
    left = spark.createDataFrame([("a", day(5)), ("a", day(5)), ("z", day(5))], "k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", day(1), 1.0), ("a", day(4), None)], "k string, t timestamp_ntz, v double")
    got = rows(asof_join(left, right, ["k"], "t", "t", ["v"]))
    assert got == [("a", day(5), None), ("a", day(5), None), ("z", day(5), None)]
    with pytest.raises(ValueError):
        asof_join(left, right, ["k"], "t", "t", ["t"])


@pytest.mark.parametrize("kind", ["decimal(20,0)", "decimal(38,2)", "double", "text", "binary", "negative"])
def test_values_that_differ_in_their_last_digits(spark, kind):
    """Figures of rows cut along close values equal those of the plain forms."""
    at = F.col("id")
    place = {
        "decimal(20,0)": F.lit("10000000000000000000").cast("decimal(20,0)") + at,
        "decimal(38,2)": F.lit("999999999999999999999999999999999000").cast("decimal(38,2)") + (at / 100).cast("decimal(38,2)"),
        "double": F.lit(1.7e9) + at / 1e6,
        "text": F.concat(F.lit("p" * 400), F.lpad(at.cast("string"), 6, "0")),
        "binary": F.concat(F.lit("p" * 40), F.lpad(at.cast("string"), 6, "0")).cast("binary"),
        "negative": -F.lit("10000000000000000000").cast("decimal(20,0)") - at,
    }[kind]
    df = spark.range(200).select(F.lit("k").alias("k"), "id", place.alias("place"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    df = df.unionByName(df.limit(3).withColumn("k", F.lit(None).cast("string"))).repartition(3)

    def figures(**split):
        lagged = lookback_window(df, ["k"], ["place"], 7, lambda w: {"lagged": F.lag("v", 7).over(w)}, **split)
        total = running_total(df, ["k"], ["place"], "v", "total", **split)
        mean = rolling_average(df, 12, ["v"], ["k"], ["place"], **split)
        return [rows(f.drop("place")) for f in (lagged, total, mean)]

    assert figures(split_rows=20) == figures()


def test_heavy_keys_are_cut_once(spark):
    """One broadcast of the fences, whatever the number of slices; the source is not read per round."""
    df = history(spark, seed=3, n=600).where("t IS NOT NULL")
    cut = slice_heavy_keys(df, ["k"], ["t", "id"], split_rows=3)
    plan = plan_text(cut)
    assert plan.count("BroadcastHashJoin") == 1 and "Exchange hashpartitioning" not in plan


def test_sampled_fences(spark):
    """A sample of the rows cuts about as evenly, and the figures stay the same."""
    df = spark.range(60_000).select(F.lit("k").alias("k"), F.xxhash64("id").alias("t"), "id", F.col("id").cast("double").alias("v"))
    cut = slice_heavy_keys(df, ["k"], ["t"], split_rows=2000)
    sizes = [r["count"] for r in cut.groupBy(SLICE).count().collect()]
    assert 60 < len(sizes) < 240 and max(sizes) < 2500
    assert rows(rolled(df, 3, split_rows=2000).agg(F.sum("n"), F.sum(F.hash("id", "lagged", "top").cast("long")))) == rows(
        rolled(df, 3).agg(F.sum("n"), F.sum(F.hash("id", "lagged", "top").cast("long")))
    )


def test_many_slices_need_no_long_arrays(spark, monkeypatch):
    """However many slices a key needs, a row is compared with few fences."""
    lengths, search = [], ordered_module._fences_before
    monkeypatch.setattr(ordered_module, "_fences_before", lambda place, fences, most: lengths.append(most) or search(place, fences, most))
    df = spark.range(6_000).select(F.lit("k").alias("k"), F.xxhash64("id").alias("t"), "id", F.col("id").cast("double").alias("v"))
    cut = slice_heavy_keys(df, ["k"], ["t"], split_rows=8)
    sizes = [r["count"] for r in cut.groupBy(SLICE).count().collect()]
    assert max(lengths) <= 512 and len(sizes) >= 3000 and max(sizes) <= 8
    assert rows(rolled(df, 3, split_rows=8)) == rows(rolled(df, 3))


@pytest.mark.parametrize("kind", ["even", "burst", "instant"])
def test_slices_counted_in_groups(spark, monkeypatch, kind):
    """Windows, sums and as-of joins over keys that are cut into groups first; some heavy keys have no sampled row."""
    monkeypatch.setattr(ordered_module, "FENCES", 4)
    monkeypatch.setattr(ordered_module, "GROUPS", 3)
    df = history(spark, seed=31, kind=kind)
    assert rows(rolled(df, 5, split_rows=9, slices=4)) == rows(rolled(df, 5))
    sums = df.withColumn("v", F.col("v").cast("decimal(8,2)"))
    total = lambda **split: rows(running_total(sums, ["k"], ["t", "id"], "v", "sum", **split))
    assert total(split_rows=9) == total()
    right = history(spark, seed=32, n=250, kind=kind).select("k", "t", "v")
    asked = df.select("k", F.col("t").alias("asked"))
    expected = brute_asof([tuple(r) for r in asked.collect()], [tuple(r) for r in right.collect()])
    assert rows(asof_join(asked, right, ["k"], "asked", "t", ["v"], split_rows=9)) == expected
