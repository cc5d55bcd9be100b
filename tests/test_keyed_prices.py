"""Rolling means from keyed state equal a batch over all landed files."""

from __future__ import annotations

import datetime as dt
import os
import random

import numpy as np
import pytest

from ledgerlark.operators import latest_rows
from ledgerlark.plans import rolling_average, truncate_before
from ledgerlark.schema import HISTORY_SCHEMA
from ledgerlark.sources import current_table, read_version
from ledgerlark.streaming import keyed_averages, read_statement_stream, use_keyed_state
from ledgerlark.streaming import keyed_prices
from ledgerlark.streaming.keyed_prices import rolling_means

from .conftest import rows

PERIOD = 5


@pytest.fixture
def keyed(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    use_keyed_state(spark)
    yield spark
    spark.conf.set(name, before)


def landed(seed: int, files: int = 4) -> list[list[tuple]]:
    """Price files, mostly of days in order; each also restates and brings some old days."""
    rng = random.Random(seed)
    out = []
    for at in range(files):
        seen = {}
        for symbol in ("A", "B", None):
            recent = [dt.datetime(2020, 1, 1) + dt.timedelta(days=12 * at + n) for n in rng.sample(range(12), 8)]
            older = [dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randrange(12 * at + 1)) for _ in range(2)]
            for day in [*recent, *older, dt.datetime(2016, 5, 5)]:
                seen[symbol, day] = (symbol, day, *[rng.choice([1 / 3, 2.7, 100.1, rng.random()]) for _ in range(4)], rng.choice([5.0, None, float("nan")] if at == 1 else [5.0]), 1.0, None, 0.0)
        out.append(list(seen.values()))
    return out


def write(spark, folder, at, data):
    out = folder / f"day={at}"
    spark.createDataFrame(data, HISTORY_SCHEMA).coalesce(1).write.parquet(str(out))
    for file in out.glob("part-*"):
        file.rename(folder / f"{at:02}-{file.name}")
        os.utime(folder / f"{at:02}-{file.name}", (1_700_000_000 + 100 * at,) * 2)
    for file in [*out.iterdir()]:
        file.unlink()
    out.rmdir()


def batch(spark, landing):
    newest = spark.read.parquet(str(landing)).selectExpr("*", "_metadata.file_modification_time AS _at")
    newest = latest_rows(newest, ["symbol", "date"], ["_at"]).drop("_at").replace(float("nan"), None)
    return rolling_average(truncate_before(newest), PERIOD)


def means(table):
    return table.select("symbol", "date", *[table[keyed_prices.mean_name(p)].alias(p) for p in keyed_prices.PRICES])


@pytest.mark.parametrize(
    "order, lateness", [([0, 1, 2, 3], 3), ([3, 1, 2, 0], 0)]
)
def test_files_in_any_order_equal_the_batch(keyed, tmp_path, order, lateness):
    landing = tmp_path / "landing"
    landing.mkdir()
    files = landed(sum(order[:2]) + lateness)
    for step, at in enumerate(order):
        write(keyed, landing, at, files[at])
        if step == 0:
            continue  # two files in one run
        stream = read_statement_stream(keyed, str(landing), HISTORY_SCHEMA, max_files=1)
        keyed_averages(stream, str(tmp_path / "table"), str(tmp_path / "checkpoint"), PERIOD, lateness=lateness).awaitTermination()
    table = current_table(keyed, str(tmp_path / "table"))
    assert rows(means(table)) == rows(batch(keyed, landing))


def test_a_batch_in_time_reads_no_stored_row(keyed, tmp_path, monkeypatch):
    landing, read, passed = tmp_path / "landing", [], []
    landing.mkdir()
    plain_read, plain_upsert = keyed_prices.current_table, keyed_prices.upsert_version
    monkeypatch.setattr(keyed_prices, "current_table", lambda *a: read.append(a) or plain_read(*a))
    monkeypatch.setattr(keyed_prices, "upsert_version", lambda new, *a: passed.append(new.count()) or plain_upsert(new, *a))
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    price = lambda n, close: ("A", day(n), 1.0, 1.0, 1.0, close, 5.0, close, None, 0.0)
    for at, data in enumerate([[price(n, n / 7) for n in range(40)], [price(40, 9.0)], [price(30, 2.0)], [price(3, 8.0)]]):
        write(keyed, landing, at, data)
        stream = read_statement_stream(keyed, str(landing), HISTORY_SCHEMA)
        keyed_averages(stream, str(tmp_path / "table"), str(tmp_path / "checkpoint"), PERIOD, lateness=15, buckets=2).awaitTermination()
        assert len(read) == (1 if at == 3 else 0)
    # All rows, the new day, the restated day with those its frame reaches, and all of a late symbol.
    assert passed == [40, 1, PERIOD, 41]
    assert read_version(keyed, str(tmp_path / "table")).buckets == 2
    assert rows(means(current_table(keyed, str(tmp_path / "table")))) == rows(batch(keyed, landing))


@pytest.mark.parametrize("period", [1, 2, 5, 7, 120])
def test_means_equal_plain_windows_to_the_last_digit(spark, period):
    rng = random.Random(period)
    values = [rng.choice([None, *[rng.random() * 10**rng.randrange(9) for _ in range(60)]]) for _ in range(300)]
    df = spark.createDataFrame([("A", n, v) for n, v in enumerate(values)], "symbol string, date int, close double")
    expected = [r["close"] for r in rolling_average(df, period, ["close"]).orderBy("date").collect()]
    got = rolling_means(np.array([[np.nan if v is None else v] for v in values]), period)[:, 0]
    assert [None if np.isnan(v) else v for v in got] == expected


def test_calls_of_the_state_follow_the_slots_and_not_the_symbols(keyed, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    price = lambda s, n: (None if s == 7 else f"S{s}", day(n), 1.0, None, float("nan"), s + n / 7, 5.0, 1.0 * n, None, 0.0)
    symbols = 2 * keyed_prices.SLOTS
    # Days in order; a restated day in time; late days, and a late symbol that is new.
    files = [[price(s, n) for s in range(symbols) for n in range(7)], [price(s, 7) for s in range(symbols)]]
    files.append([price(s, n)[:5] + (9.0,) + price(s, n)[6:] for s, n in [(1, 6), (2, 2), (7, 0), (7, 5), (symbols, 0)]])
    for at, data in enumerate(files):
        write(keyed, landing, at, data)
        stream = read_statement_stream(keyed, str(landing), HISTORY_SCHEMA)
        run = keyed_averages(stream, str(tmp_path / "table"), str(tmp_path / "checkpoint"), 3, lateness=2)
        run.awaitTermination()
        assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= keyed_prices.SLOTS
    newest = keyed.read.parquet(str(landing)).selectExpr("*", "_metadata.file_modification_time AS _at")
    newest = latest_rows(newest, ["symbol", "date"], ["_at"]).drop("_at").replace(float("nan"), None)
    assert rows(means(current_table(keyed, str(tmp_path / "table")))) == rows(rolling_average(truncate_before(newest), 3))
