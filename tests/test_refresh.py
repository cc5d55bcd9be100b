from __future__ import annotations

import datetime as dt

from ledgerlark.plans import compute_kpis, pending_kpis, refresh_kpis, refresh_table, store_kpis

from .conftest import rows

PICKED = ("symbol", "as_of_date", "total_debt", "debt_service", "market_value")


def panel(spark, data):
    return spark.createDataFrame(
        [(s, dt.datetime(y, 12, 31), "12M", d, 1.0) for s, y, d in data],
        "symbol string, as_of_date timestamp_ntz, period_type string, total_debt double, interest_expense double",
    )


def quotes(spark):
    return spark.createDataFrame([("A", 2.0, 3.0)], "symbol string, twoHundredDayAverage double, sharesOutstanding double")


def tickers(spark, *symbols):
    return spark.createDataFrame([(s,) for s in symbols], "symbol string")


DATA = [("A", 2019, 1.0), ("A", 2020, 5.0), ("B", 2019, 7.0), ("C", 2019, 9.0)]


def test_only_pending_tickers_are_computed(spark):
    statements = panel(spark, DATA)
    existing = compute_kpis(panel(spark, DATA[:2]), quotes(spark))
    fresh = pending_kpis(tickers(spark, "A", "B", "B"), statements, quotes(spark), existing)
    assert rows(fresh, "symbol") == [("B",)]
    table = refresh_kpis(tickers(spark, "A", "B"), statements, quotes(spark), existing)
    assert rows(table, "symbol") == [("A",), ("A",), ("B",)]
    assert rows(table.where("symbol = 'A'"), *PICKED) == rows(existing, *PICKED)


def test_first_run_with_empty_table(spark):
    statements = panel(spark, DATA)
    empty = compute_kpis(statements.limit(0), quotes(spark))
    table = refresh_kpis(tickers(spark, "A", "B", "C"), statements, quotes(spark), empty)
    assert rows(table, *PICKED) == rows(compute_kpis(statements, quotes(spark)), *PICKED)


def test_restated_rows_replace_old_ones(spark):
    existing = compute_kpis(panel(spark, DATA), quotes(spark))
    restated = panel(spark, [("A", 2019, 1.0), ("A", 2020, 6.0), ("A", 2021, 8.0)])
    table = refresh_kpis(tickers(spark, "A"), restated, quotes(spark), existing, only_pending=False)
    assert [r[2] for r in rows(table.where("symbol = 'A'"), *PICKED)] == [1.0, 6.0, 8.0]
    assert table.count() == 5


def test_stored_table(spark, tmp_path):
    path = str(tmp_path / "kpis")
    store_kpis(compute_kpis(panel(spark, DATA), quotes(spark)), path)
    changed = compute_kpis(panel(spark, [("A", 2019, 1.0), ("A", 2020, 50.0)]), quotes(spark))
    for _ in range(2):
        store_kpis(changed, path)
        stored = spark.read.parquet(path)
        assert stored.count() == 4
        assert rows(stored.where("symbol = 'A'"), "total_debt") == [(1.0,), (50.0,)]


def test_refresh_of_a_stored_table(spark, tmp_path):
    path = str(tmp_path / "kpis")
    statements = panel(spark, DATA)
    refresh_table(tickers(spark, "A", "C"), statements, quotes(spark), path)
    assert rows(spark.read.parquet(path), "symbol") == [("A",), ("A",), ("C",)]
    for _ in range(2):
        refresh_table(tickers(spark, "A", "B"), statements, quotes(spark), path)
        stored = spark.read.parquet(path)
        assert rows(stored, *PICKED) == rows(compute_kpis(statements, quotes(spark)), *PICKED)


def files(path):
    return {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_rows_without_date_or_symbol_survive(spark, tmp_path):
    path = tmp_path / "kpis"
    data = [("A", None, 1.0), ("C", None, 2.0), (None, None, 3.0), ("A", 2019, 4.0)]
    undated = spark.createDataFrame(
        [(s, None if y is None else dt.datetime(y, 12, 31), "12M", d) for s, y, d in data],
        "symbol string, as_of_date timestamp_ntz, period_type string, total_debt double",
    )
    store_kpis(compute_kpis(undated, quotes(spark)), str(path))
    store_kpis(compute_kpis(undated.where("symbol = 'C'").withColumn("total_debt", undated.total_debt + 5), quotes(spark)), str(path))
    assert rows(spark.read.parquet(str(path)), "symbol", "total_debt") == [("A", 1.0), ("A", 4.0), ("C", 7.0), (None, 3.0)]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = tmp_path / "kpis"
    many = panel(spark, [(f"S{i}", y, float(i)) for i in range(40) for y in (2019, 2020)])
    refresh_table(tickers(spark, *[f"S{i}" for i in range(39)]), many, quotes(spark), str(path))
    before = files(path)
    refresh_table(tickers(spark, "S0", "S39"), many, quotes(spark), str(path))
    after = files(path)
    assert before.items() <= after.items() and len(after) > len(before)
    store_kpis(compute_kpis(panel(spark, [("S3", 2020, 99.0)]), quotes(spark)), str(path))
    kept = files(path)
    bucket = spark.sql("SELECT pmod(hash('S3'), 64)").first()[0]
    assert {f for f in after if f not in kept} == {f for f in after if f"symbol_bucket={bucket}/" in str(f)}
    assert rows(spark.read.parquet(str(path)).where("symbol = 'S3'"), "total_debt") == [(3.0,), (99.0,)]


def test_newest_quote_counts_once(spark):
    replies = spark.createDataFrame(
        [("A", 1.0, 5.0, 1), ("A", 9.0, 6.0, 3), ("A", 2.0, 7.0, 2), (None, 4.0, 4.0, 9)],
        "symbol string, twoHundredDayAverage double, sharesOutstanding double, landed_at int",
    )
    kpis = compute_kpis(panel(spark, DATA[:2]), replies)
    assert rows(kpis, "symbol", "market_value") == [("A", 54.0), ("A", 54.0)]
