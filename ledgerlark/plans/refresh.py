"""Incremental refresh of the KPI table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import pending, upsert
from ..operators.ordered import SPLIT_ROWS
from ..schema import KEY_COLUMNS
from ..sources.writers import append_table, stored_table, upsert_table
from .kpis import compute_kpis

# Partition column of a stored table: a hash of the symbol, so that a refresh of some
# symbols touches few partitions. The number of buckets belongs to the table.
BUCKET = "symbol_bucket"
BUCKETS = 64


def pending_kpis(
    tickers: DataFrame,
    statements: DataFrame,
    quotes: DataFrame,
    existing: DataFrame,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """KPI rows of the tickers that the existing table lacks."""
    return compute_kpis(statements, quotes, split_rows=split_rows, symbols=pending(tickers, existing))


def refresh_kpis(
    tickers: DataFrame,
    statements: DataFrame,
    quotes: DataFrame,
    existing: DataFrame,
    only_pending: bool = True,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """The KPI table after a refresh.

    ``only_pending`` computes just the tickers without KPI rows. Otherwise all
    given tickers are computed and their rows replace the old ones of the same
    symbol, date and period.
    """
    if only_pending:
        return existing.unionByName(
            pending_kpis(tickers, statements, quotes, existing, split_rows), allowMissingColumns=True
        )
    fresh = compute_kpis(statements, quotes, split_rows=split_rows, symbols=tickers)
    return upsert(existing, fresh, KEY_COLUMNS)


def in_buckets(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows with the partition column; without a symbol they have a bucket too."""
    return rows.withColumn(BUCKET, F.pmod(F.hash("symbol"), F.lit(buckets)))


def store_kpis(kpis: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Upsert KPI rows into the table at ``path``; only the buckets of their symbols
    are rewritten."""
    upsert_table(in_buckets(kpis, buckets), path, KEY_COLUMNS, [BUCKET])


def refresh_table(
    tickers: DataFrame,
    statements: DataFrame,
    quotes: DataFrame,
    path: str,
    split_rows: int = SPLIT_ROWS,
    buckets: int = BUCKETS,
) -> None:
    """Compute the tickers that the KPI table at ``path`` lacks and append their rows.

    Only the symbols of the stored table are read, and no stored file is rewritten.
    The first run makes the table.
    """
    existing = stored_table(tickers.sparkSession, path)
    done = tickers.limit(0) if existing is None else existing
    fresh = in_buckets(pending_kpis(tickers, statements, quotes, done, split_rows), buckets)
    append_table(fresh.hint("rebalance", BUCKET), path, [BUCKET])
