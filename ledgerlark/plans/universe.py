"""Ticker universes from screener rows."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import market_cap_millions
from ..operators.ranking import top_n
from ..sources.writers import write_ticker_list

# Exchanges, sectors and regions of the screener.
EXCHANGES = ("nyse", "nasdaq", "amex")
SECTORS = (
    "Consumer Non-Durables",
    "Capital Goods",
    "Health Care",
    "Energy",
    "Technology",
    "Basic Industries",
    "Finance",
    "Consumer Services",
    "Public Utilities",
    "Miscellaneous",
    "Consumer Durables",
    "Transportation",
)
REGIONS = (
    "AFRICA",
    "EUROPE",
    "ASIA",
    "AUSTRALIA+AND+SOUTH+PACIFIC",
    "CARIBBEAN",
    "SOUTH+AMERICA",
    "MIDDLE+EAST",
    "NORTH+AMERICA",
)


def is_plain_symbol(symbol: Column) -> Column:
    """True for symbols without a dot or a caret; NULL symbols fail."""
    return ~symbol.rlike("[.^]")


def sector_names(sectors: str | Collection[str], valid: Collection[str] = SECTORS) -> list[str]:
    """Checked list of sectors; one name may be given as plain text."""
    wanted = [sectors] if isinstance(sectors, str) else list(sectors)
    unknown = sorted(set(wanted) - set(valid))
    if unknown:
        raise ValueError(f"invalid sectors: {unknown}")
    return wanted


def region_name(region: str, valid: Collection[str] = REGIONS) -> str:
    """Checked region."""
    if region not in valid:
        raise ValueError(f"invalid region: {region}; choose one of {sorted(valid)}")
    return region


def on_exchanges(screener: DataFrame, exchanges: Collection[str] = EXCHANGES) -> DataFrame:
    """Rows of the chosen exchanges."""
    return screener.where(F.col("exchange").isin(list(exchanges)))


def chosen_exchanges(nyse: bool = True, nasdaq: bool = True, amex: bool = True) -> list[str]:
    """Exchange names for the three include flags."""
    return [name for name, wanted in zip(EXCHANGES, (nyse, nasdaq, amex), strict=True) if wanted]


def tickers(screener: DataFrame, exchanges: Collection[str] = EXCHANGES) -> DataFrame:
    """Plain symbols of the chosen exchanges; duplicates stay."""
    return on_exchanges(screener, exchanges).where(is_plain_symbol(F.col("symbol"))).select("symbol")


def _capitalised(
    screener: DataFrame,
    sectors: str | Collection[str] | None,
    valid_sectors: Collection[str],
    empty_as_zero: bool,
) -> DataFrame:
    rows = screener.where(F.col("marketCap").isNotNull() & is_plain_symbol(F.col("symbol")))
    if sectors is not None:
        rows = rows.where(F.col("sector").isin(sector_names(sectors, valid_sectors)))
    return rows.withColumn("market_cap", market_cap_millions(F.col("marketCap"), empty_as_zero))


def tickers_filtered(
    screener: DataFrame,
    mktcap_min: float | None = None,
    mktcap_max: float | None = None,
    sectors: str | Collection[str] | None = None,
    exchanges: Collection[str] = EXCHANGES,
    valid_sectors: Collection[str] = SECTORS,
) -> DataFrame:
    """Plain symbols with a market cap, in millions, inside the open range."""
    rows = _capitalised(on_exchanges(screener, exchanges), sectors, valid_sectors, empty_as_zero=True)
    if mktcap_min is not None:
        rows = rows.where(F.col("market_cap") > F.lit(float(mktcap_min)))
    if mktcap_max is not None:
        rows = rows.where(F.col("market_cap") < F.lit(float(mktcap_max)))
    return rows.select("symbol")


def biggest_n(
    screener: DataFrame,
    n: int,
    sectors: str | Collection[str] | None = None,
    exchanges: Collection[str] = EXCHANGES,
    valid_sectors: Collection[str] = SECTORS,
    strict: bool = True,
    lazy: bool = False,
) -> DataFrame:
    """The ``n`` largest companies by market cap, ties by symbol. With ``lazy`` too large an
    ``n`` is found by the plan itself, not by a job before it."""
    rows = _capitalised(on_exchanges(screener, exchanges), sectors, valid_sectors, empty_as_zero=False)
    order = [F.col("market_cap").desc_nulls_last(), F.col("symbol").asc()]
    return top_n(rows.select("symbol", "market_cap"), order, n, strict, lazy)


def tickers_by_region(companies: DataFrame, region: str, valid: Collection[str] = REGIONS) -> DataFrame:
    """Plain symbols of one region."""
    region = region_name(region, valid)
    return companies.where((F.col("region") == region) & is_plain_symbol(F.col("symbol"))).select("symbol")


def save_tickers(screener: DataFrame, path: str, exchanges: Collection[str] = EXCHANGES) -> None:
    """Write the ticker list of the chosen exchanges as headerless CSV."""
    write_ticker_list(tickers(screener, exchanges), path)


def save_tickers_by_region(
    companies: DataFrame, region: str, path: str, valid: Collection[str] = REGIONS
) -> None:
    """Write the ticker list of one region as headerless CSV."""
    write_ticker_list(tickers_by_region(companies, region, valid), path)
