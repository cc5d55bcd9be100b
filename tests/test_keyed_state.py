"""KPI refresh from keyed state equals a batch over all landed files."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest

from ledgerlark.operators import latest_rows
from ledgerlark.plans import compute_kpis
from ledgerlark.sources import current_table, parse_statements
from ledgerlark.streaming import keyed_refresh, read_statement_stream, use_keyed_state

from .conftest import rows

SCHEMA = "symbol string, asOfDate timestamp_ntz, periodType string, TotalDebt double, InterestExpense double, EBIT double, OperatingIncome double, TotalAssets double"
PICKED = ("symbol", "as_of_date", "total_debt", "debt_service", "return_on_capital_employed", "market_value")


@pytest.fixture
def keyed(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    use_keyed_state(spark)
    yield spark
    spark.conf.set(name, before)


def landed(seed: int) -> list[list[tuple]]:
    """Files of statements; later files restate, flip the EBIT rule and bring old years."""
    rng = random.Random(seed)
    files = []
    for at in range(4):
        seen = {}
        for _ in range(14):
            key = (rng.choice(["A", "B", "C", None]), rng.choice([None, *range(2010, 2018)]), rng.choice(["12M", "12M", "3M"]))
            seen[key] = (*key, rng.choice([None, float("nan"), 1.0, 2.5, 1 / 3]), rng.choice([0.0, 3.0, None] if at else [3.0, None]))
        files.append(list(seen.values()))
    return files


def write(spark, folder, at, data):
    """One file, whose time follows from ``at``."""
    day = lambda y: None if y is None else dt.datetime(y, 12, 31, 1, 2, 3, 456789)
    out = folder / f"day={at}"
    spark.createDataFrame([(s, day(y), p, d, 1.0, e, 7.0, 100.0) for s, y, p, d, e in data], SCHEMA).coalesce(1).write.parquet(str(out))
    for file in out.glob("part-*"):
        file.rename(folder / f"{at:02}-{file.name}")
        os.utime(folder / f"{at:02}-{file.name}", (1_700_000_000 + 100 * at,) * 2)
    for file in [*out.iterdir()]:
        file.unlink()
    out.rmdir()


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 1, 0, 2]])
def test_files_in_any_order_equal_the_batch(keyed, tmp_path, order):
    landing = tmp_path / "landing"
    landing.mkdir()
    quotes = keyed.createDataFrame([("A", 2.0, 3.0)], "symbol string, twoHundredDayAverage double, sharesOutstanding double")
    schema = keyed.createDataFrame([], SCHEMA).schema
    files = landed(len(order) + order[0])
    for step, at in enumerate(order):
        write(keyed, landing, at, files[at])
        if step in (0, 2):
            continue  # two files in one run
        stream = read_statement_stream(keyed, str(landing), schema, max_files=1)
        keyed_refresh(stream, lambda: quotes, str(tmp_path / "table"), str(tmp_path / "checkpoint")).awaitTermination()
    newest = keyed.read.parquet(str(landing)).selectExpr("*", "_metadata.file_modification_time AS _at")
    newest = latest_rows(newest, ["symbol", "asOfDate", "periodType"], ["_at"]).drop("_at")
    batch = compute_kpis(parse_statements(newest), quotes)
    assert rows(current_table(keyed, str(tmp_path / "table")), *PICKED) == rows(batch, *PICKED)
