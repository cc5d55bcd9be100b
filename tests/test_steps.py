"""Values looked up by steps equal the as-of join."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from ledgerlark.operators import asof_join, step_join, value_steps
from ledgerlark.plans.extensions import to_usd

from .conftest import plan_text, rows

START = dt.datetime(2020, 1, 1)


def frames(spark, seed, days=900, asked_kind="timestamp_ntz", known_kind="timestamp_ntz"):
    """Rows and values with ties, repeated rows, NULLs and keys that only one side has."""
    rng = random.Random(seed)
    time = lambda: rng.choice([None, *[START + dt.timedelta(days=rng.randrange(-90, days), hours=rng.choice([0, 0, 7])) for _ in range(30)]])
    known = [(rng.choice(["A", "A", "A", "B", "C", None]), time(), rng.choice([None, 1.0, 1.5, 2.0])) for _ in range(700)]
    known.append(("E", START, 3.0))
    asked = [(n // 2, rng.choice(["A", "A", "B", "C", "D", "E", None]), time()) for n in range(400)]
    left = spark.createDataFrame(asked, "_span int, key string, at timestamp_ntz").withColumnsRenamed({"_span": "n"})
    right = spark.createDataFrame(known, "key string, since timestamp_ntz, rate double")
    return left.withColumn("at", left["at"].cast(asked_kind)), right.withColumn("since", right["since"].cast(known_kind))


NTZ = "timestamp_ntz"


@pytest.mark.parametrize(
    "days, kinds, max_steps",
    [
        (900, (NTZ, NTZ), 1_000_000),
        (1, (NTZ, NTZ), 1_000_000),
        (40, ("date", NTZ), 1_000_000),
        (900, ("timestamp", "date"), 1_000_000),
        (40, ("string", "string"), 1_000_000),
        (900, (NTZ, NTZ), 0),
    ],
)
def test_equals_the_asof_join(spark, days, kinds, max_steps):
    left, right = frames(spark, days, days, *kinds)
    arguments = (left, right, ["key"], "at", "since", ["rate"])
    assert rows(step_join(*arguments, split_rows=50, max_steps=max_steps)) == rows(asof_join(*arguments))


def test_steps_are_changes(spark):
    day = lambda n: START + dt.timedelta(days=n)
    data = [("A", day(0), 1.0), ("A", day(1), 1.0), ("A", day(2), None), ("A", day(3), None), ("A", day(4), 1.0), ("A", day(4), 2.0), (None, day(0), 1.0), ("A", None, 1.0)]
    steps = value_steps(spark.createDataFrame(data, "key string, since timestamp_ntz, rate double"), ["key"], "since", ["rate"])
    assert rows(steps.select("key", "_time", "_value.rate")) == [("A", day(0), 1.0), ("A", day(2), None), ("A", day(4), 2.0)]


def test_empty_sides_and_clashing_names(spark):
    left, right = frames(spark, 3)
    assert rows(step_join(left, right.limit(0), ["key"], "at", "since", ["rate"]), "n", "rate") == rows(left.selectExpr("n", "CAST(NULL AS double)"))
    assert step_join(left.limit(0), right, ["key"], "at", "since", ["rate"]).isEmpty()
    with pytest.raises(ValueError):
        step_join(left.withColumnRenamed("n", "rate"), right, ["key"], "at", "since", ["rate"])


def test_rows_to_convert_are_not_shuffled(spark):
    left, right = frames(spark, 5)
    table = left.selectExpr("n", "key AS currency_code", "at AS as_of_date", "1.0D AS total_debt")
    rates = right.selectExpr("key AS currency_code", "since AS date", "rate AS usd_rate")
    plan = plan_text(to_usd(table, rates, ["total_debt"]))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
    # The only exchanges are below the broadcast arrays.
    assert plan.index("BroadcastExchange") < plan.index("Exchange hashpartitioning")
