from __future__ import annotations

import datetime as dt
import time

from ledgerlark.plans import compute_kpis
from ledgerlark.sources import parse_statements
from ledgerlark.streaming import read_statement_stream, refresh_stream

from .conftest import rows

SCHEMA = "symbol string, asOfDate timestamp_ntz, periodType string, TotalDebt double, InterestExpense double"
PICKED = ("symbol", "as_of_date", "total_debt", "debt_service", "market_value")


def land(spark, path, data):
    statements = [(s, dt.datetime(y, 12, 31), p, d, 1.0) for s, y, p, d in data]
    spark.createDataFrame(statements, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch(spark, tmp_path):
    landing, state, table, checkpoint = (str(tmp_path / n) for n in ("landing", "state", "table", "checkpoint"))
    quotes = spark.createDataFrame(
        [("A", 2.0, 3.0)], "symbol string, twoHundredDayAverage double, sharesOutstanding double"
    )

    def run():
        stream = read_statement_stream(spark, landing, spark.createDataFrame([], SCHEMA).schema, max_files=1)
        refresh_stream(stream, state, lambda: quotes, table, checkpoint).awaitTermination()
        stored = spark.read.parquet(table)
        batch = compute_kpis(parse_statements(spark.read.parquet(landing)), quotes)
        assert rows(stored, *PICKED) == rows(batch, *PICKED)
        return stored

    land(spark, landing, [("A", 2019, "12M", 1.0), ("B", 2019, "12M", 4.0), ("B", 2019, "3M", 9.0)])
    land(spark, landing, [("A", 2020, "12M", 5.0)])
    assert run().count() == 3
    land(spark, landing, [("A", 2021, "12M", 6.5), ("C", 2020, "12M", 2.0)])
    assert run().count() == 5
    assert run().count() == 5  # nothing new


def test_newest_file_of_a_restated_statement(spark, tmp_path):
    landing, state, table, checkpoint = (str(tmp_path / n) for n in ("landing", "state", "table", "checkpoint"))
    quotes = spark.createDataFrame(
        [("A", 2.0, 3.0)], "symbol string, twoHundredDayAverage double, sharesOutstanding double"
    )
    land(spark, landing, [("A", 2019, "12M", 1.0), ("A", 2020, "12M", 4.0)])
    time.sleep(1.1)
    land(spark, landing, [("A", 2019, "12M", 3.0)])
    stream = read_statement_stream(spark, landing, spark.createDataFrame([], SCHEMA).schema, max_files=1)
    refresh_stream(stream, state, lambda: quotes, table, checkpoint).awaitTermination()
    stored = spark.read.parquet(table).orderBy("as_of_date").collect()
    assert [(r["total_debt"], r["debt_service"]) for r in stored] == [(3.0, None), (4.0, 2.0)]


def test_batches_leave_other_partitions_alone(spark, tmp_path):
    landing, state, table, checkpoint = (str(tmp_path / n) for n in ("landing", "state", "table", "checkpoint"))
    quotes = spark.createDataFrame([], "symbol string, twoHundredDayAverage double, sharesOutstanding double")

    def run():
        stream = read_statement_stream(spark, landing, spark.createDataFrame([], SCHEMA).schema)
        refresh_stream(stream, state, lambda: quotes, table, checkpoint).awaitTermination()
        return {f: f.stat().st_mtime_ns for part in ("state", "table") for f in (tmp_path / part).rglob("*.parquet")}

    land(spark, landing, [(f"S{i}", y, "12M", float(i)) for i in range(30) for y in (2019, 2020)])
    before = run()
    land(spark, landing, [("S4", 2021, "12M", 9.0)])
    after = run()
    bucket = spark.sql("SELECT pmod(hash('S4'), 64)").first()[0]
    assert {f for f in before if before[f] != after.get(f)} == {f for f in before if f"symbol_bucket={bucket}/" in str(f)}
    assert rows(spark.read.parquet(table).where("symbol = 'S4'"), "total_debt", "debt_service")[-1] == (9.0, 6.0)
