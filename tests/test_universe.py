from __future__ import annotations

import pytest

from ledgerlark.plans import (
    biggest_n,
    chosen_exchanges,
    save_tickers,
    save_tickers_by_region,
    tickers,
    tickers_by_region,
    tickers_filtered,
)
from ledgerlark.plans.universe import REGIONS, SECTORS

from .conftest import ordered, rows


@pytest.fixture(scope="module")
def screener(spark):
    data = [
        ("nyse", "A", "$1.5B", "Finance"),
        ("nyse", "B.C", "$9B", "Finance"),
        ("nyse", "D^E", "$9B", "Energy"),
        ("nasdaq", "BRK/A", "$250M", "Energy"),
        ("nasdaq", "BRK-A", "", "Technology"),
        ("nasdaq", "NOCAP", None, "Technology"),
        ("amex", "A", "$3000000", None),
        ("amex", "BAD", "$1M2B", "Finance"),
        ("amex", None, "$1B", "Finance"),
        ("other", "X", "$1B", "Finance"),
    ]
    return spark.createDataFrame(data, "exchange string, symbol string, marketCap string, sector string")


def test_symbol_filter_and_flags(screener):
    everything = [("A",), ("A",), ("BAD",), ("BRK-A",), ("BRK/A",), ("NOCAP",)]
    assert rows(tickers(screener)) == sorted(everything)
    assert rows(tickers(screener, chosen_exchanges(nasdaq=False))) == [("A",), ("A",), ("BAD",)]
    assert rows(tickers(screener, chosen_exchanges(nyse=False, nasdaq=False, amex=False))) == []


def test_filtered(screener):
    assert rows(tickers_filtered(screener)) == [("A",), ("A",), ("BAD",), ("BRK-A",), ("BRK/A",)]
    assert rows(tickers_filtered(screener, mktcap_min=3)) == [("A",), ("BRK/A",)]
    assert rows(tickers_filtered(screener, mktcap_max=250)) == [("A",), ("BRK-A",)]
    assert rows(tickers_filtered(screener, mktcap_min=0, mktcap_max=1500)) == [("A",), ("BRK/A",)]
    assert rows(tickers_filtered(screener, sectors="Finance")) == [("A",), ("BAD",)]
    assert rows(tickers_filtered(screener, sectors=["Energy", "Technology"])) == [("BRK-A",), ("BRK/A",)]


def test_biggest(screener):
    assert ordered(biggest_n(screener, 2)) == [("A", 1500.0), ("BRK/A", 250.0)]
    assert ordered(biggest_n(screener, 5)) == [("A", 1500.0), ("BRK/A", 250.0), ("A", 3.0), ("BAD", None), ("BRK-A", None)]
    assert ordered(biggest_n(screener, 1, sectors="Energy")) == [("BRK/A", 250.0)]
    with pytest.raises(ValueError):
        biggest_n(screener, 6)
    assert biggest_n(screener, 6, strict=False).count() == 5


def test_argument_checks_run_no_job(screener):
    with pytest.raises(ValueError):
        tickers_filtered(screener, sectors=["Finance", "Foo"])
    with pytest.raises(ValueError):
        biggest_n(screener, 1, sectors="Foo")
    with pytest.raises(ValueError):
        tickers_by_region(screener, "MOON")
    assert len(SECTORS) == 12 and len(REGIONS) == 8


def test_regions_and_saved_lists(spark, screener, tmp_path):
    companies = spark.createDataFrame([("A", "ASIA"), ("B.X", "ASIA"), ("C", "EUROPE")], "symbol string, region string")
    assert rows(tickers_by_region(companies, "ASIA")) == [("A",)]
    save_tickers(screener, str(tmp_path / "t"), ["nyse"])
    save_tickers_by_region(companies, "EUROPE", str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["A"]
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["C"]
