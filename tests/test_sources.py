from __future__ import annotations

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark import sources
from ledgerlark.schema import BASE_COLUMNS, HISTORY_SCHEMA

from .conftest import ordered, rows


def test_ticker_list(spark, tmp_path):
    file = tmp_path / "tickers.csv"
    file.write_bytes("﻿MSFT\nGOOG\nNAN\nNA\nTRUE\nECC   \nBRK/A\n".encode())
    listed = sources.read_tickers(spark, str(file))
    assert [r.symbol for r in listed.collect()] == ["MSFT", "GOOG", "NAN", "NA", "TRUE", "ECC", "BRK/A"]
    assert sources.read_tickers(spark, str(file), dash_classes=True).where("symbol = 'BRK-A'").count() == 1


def test_ticker_table(spark):
    assert ordered(sources.ticker_table(spark, ["MSFT", "GOOG"])) == [("MSFT",), ("GOOG",)]


def test_metrics_by_header_name(spark, tmp_path):
    file = tmp_path / "metrics.csv"
    file.write_text('beta,symbol,companyOfficers,pegRatio\n1.5,A,"[{""n"": 1}, 2]",nan\nx,B,,2\n')
    df = sources.read_metrics(spark, str(file))
    assert df.columns == ["beta", "symbol", "companyOfficers", "pegRatio"]
    assert ordered(df) == [(1.5, "A", '[{"n": 1}, 2]', None), (None, "B", None, 2.0)]


def test_statements(spark, tmp_path):
    path = str(tmp_path / "s")
    raw = spark.createDataFrame(
        [("A", dt.datetime(2020, 1, 1), "12M", "USD", 1.0, math.nan, 5), ("A", dt.datetime(2020, 1, 1), "3M", "USD", 2.0, 2.0, 5)],
        "symbol string, asOfDate timestamp_ntz, periodType string, currencyCode string, NetPPE double, EBIT double, Unknown int",
    )
    raw.write.parquet(path)
    annual = sources.read_statements(spark, path)
    assert tuple(annual.columns) == BASE_COLUMNS
    assert rows(annual, "symbol", "net_ppe", "ebit", "accounts_payable") == [("A", 1.0, None, None)]
    assert sources.read_statements(spark, path, period_type=None).count() == 2


def test_landed_statements_split_rejects(spark, tmp_path):
    file = tmp_path / "s.json"
    file.write_text('{"symbol": "A", "asOfDate": "2020-01-01T00:00:00", "EBIT": 1.5}\n"no data"\n{broken\n')
    schema = T.StructType().add("symbol", "string").add("asOfDate", "timestamp_ntz").add("EBIT", "double")
    good, bad = sources.landed_statements(spark, str(file), schema)
    assert ordered(good) == [("A", dt.datetime(2020, 1, 1), 1.5)]
    assert bad.count() == 2


def test_quotes(spark, tmp_path):
    file = tmp_path / "q.json"
    replies = [
        {"A": {"twoHundredDayAverage": 1.5, "sharesOutstanding": 10, "bid": 3}, "B": {"sharesOutstanding": 7}},
        {"C": {}},
    ]
    file.write_text("\n".join(json.dumps(r) for r in replies))
    quotes = sources.read_quotes(spark, str(file))
    fields = ("symbol", "twoHundredDayAverage", "sharesOutstanding")
    assert rows(quotes, *fields) == [("A", 1.5, 10.0), ("B", None, 7.0), ("C", None, None)]
    assert quotes.columns[3:] == ["bidSize", "askSize"]


def test_screener(spark, tmp_path):
    reply = {"data": {"headers": {"symbol": "Symbol"}, "rows": [{"symbol": "A", "marketCap": "$1B", "sector": "Energy", "url": "/a"}, {"symbol": "B"}]}}
    for name in ("nyse", "amex"):
        folder = tmp_path / f"exchange={name}"
        folder.mkdir()
        (folder / "reply.json").write_text(json.dumps(reply, indent=1))
    df = sources.read_screener(spark, str(tmp_path))
    assert rows(df, "exchange", "symbol", "marketCap") == [
        ("amex", "A", "$1B"), ("amex", "B", None), ("nyse", "A", "$1B"), ("nyse", "B", None)
    ]
    one = sources.read_screener(spark, str(tmp_path / "exchange=nyse"), "nyse")
    assert rows(one, "exchange", "symbol") == [("nyse", "A"), ("nyse", "B")]


def test_region_companies(spark, tmp_path):
    folder = tmp_path / "region=ASIA"
    folder.mkdir()
    (folder / "list.csv").write_text("Symbol,Name\nA ,x\nB.C,y\n")
    assert rows(sources.read_region_companies(spark, str(tmp_path))) == [("A", "ASIA"), ("B.C", "ASIA")]


def test_history_round_trip(spark, tmp_path):
    path = str(tmp_path / "h")
    one = [("A", dt.datetime(2019, 12, 31), 1.0), ("A", dt.datetime(2020, 1, 2), math.nan)]
    df = spark.createDataFrame(one, "symbol string, date timestamp_ntz, close double")
    sources.append_history(df, path)
    sources.append_history(df.limit(1), path)
    back = sources.read_history(spark, path)
    assert back.schema.simpleString() == HISTORY_SCHEMA.simpleString()
    assert rows(back, "symbol", "date", "close") == [("A", one[0][1], 1.0), ("A", one[0][1], 1.0), ("A", one[1][1], None)]
    assert {r.year for r in spark.read.parquet(path).select("year").collect()} == {2019, 2020}


def test_lookup(spark):
    df = spark.createDataFrame([("A", 1), ("A'; --", 2)], "symbol string, n int")
    assert ordered(sources.lookup(df, "A'; --")) == [("A'; --", 2)]


def test_snapshot_and_append(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(3)
    sources.write_snapshot(df, path)
    sources.write_snapshot(df, path, "a")
    sources.append_table(df, path)
    assert sources.read_table(spark, path).count() == 9
    sources.write_snapshot(df, path, "w")
    assert sources.read_table(spark, path).count() == 3
    with pytest.raises(ValueError):
        sources.write_snapshot(df, path, "x")


def test_upsert_table_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    keys, parts = ["symbol", "year"], ["year"]
    first = spark.createDataFrame([("A", 2019, 1.0), ("A", 2020, 2.0), ("B", 2020, 3.0)], "symbol string, year int, v double")
    new = spark.createDataFrame([("B", 2020, 30.0), ("C", 2021, 4.0)], "symbol string, year int, v double")
    sources.upsert_table(first, path, keys, parts)
    untouched = sorted(p.name for p in (tmp_path / "t" / "year=2019").iterdir())
    for _ in range(2):
        sources.upsert_table(new, path, keys, parts)
        assert rows(spark.read.parquet(path), "symbol", "year", "v") == [
            ("A", 2019, 1.0), ("A", 2020, 2.0), ("B", 2020, 30.0), ("C", 2021, 4.0)
        ]
    assert sorted(p.name for p in (tmp_path / "t" / "year=2019").iterdir()) == untouched


def test_snapshot_of_nothing(spark, tmp_path):
    empty = spark.range(0).withColumn("x", F.lit("a"))
    sources.write_snapshot(empty, str(tmp_path / "e"))
    assert sources.read_table(spark, str(tmp_path / "e")).columns == ["id", "x"]
