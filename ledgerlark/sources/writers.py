"""Writers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import latest_rows, upsert
from ..session import settle

# One-letter write modes of a snapshot.
SNAPSHOT_MODES = {"w": "overwrite", "a": "append"}


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append rows to a Parquet table."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_history(history: DataFrame, path: str) -> None:
    """Append price rows, partitioned by year. Rows are first spread over year
    and symbol hash by a rebalance, which splits big years and joins small ones."""
    dated = history.withColumn("year", F.year("date"))
    append_table(dated.hint("rebalance", "year"), path, ["year"])


def write_filtered_metrics(metrics: DataFrame, path: str) -> None:
    """Screened metrics as CSV with a header."""
    metrics.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_ticker_list(symbols: DataFrame, path: str) -> None:
    """Symbols as headerless CSV."""
    symbols.select("symbol").write.mode("overwrite").option("header", False).csv(path)


def write_snapshot(df: DataFrame, path: str, mode: str = "w") -> None:
    """Table snapshot: ``"w"`` replaces, ``"a"`` appends."""
    if mode not in SNAPSHOT_MODES:
        raise ValueError(f"mode must be one of {sorted(SNAPSHOT_MODES)}")
    df.write.mode(SNAPSHOT_MODES[mode]).parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "symbol") -> None:
    """Managed table bucketed and sorted by key; later joins and windows on the
    key then read it without an exchange."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def touched_partitions(stored: DataFrame, new: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Stored rows in the partitions that ``new`` has rows in. The driver sees one row
    per partition folder of the batch, and the predicate prunes the other folders."""
    found = new.select(*parts).distinct().collect()
    same = [reduce(and_, [F.col(p).eqNullSafe(F.lit(row[p])) for p in parts]) for row in found]
    return stored.where(reduce(or_, same)) if same else stored.limit(0)


def upsert_table(
    new: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str], version: Sequence[str] = ()
) -> None:
    """Upsert into a partitioned Parquet table, rewriting only the touched partitions.
    NULL is a partition like any other. With ``version`` columns the newest row of a
    key stays, else the new one.

    The partition columns must follow from the keys, so that a key never changes
    its partition. A repeated run leaves the same table. There is one writer at a
    time; readers should read between runs.
    """
    spark = new.sparkSession
    parts = list(partition_by)
    new = settle(new)
    stored = stored_table(spark, path)
    merged = new
    if stored is not None:
        touched = touched_partitions(stored, new, parts)
        merged = latest_rows(touched.unionByName(new), keys, version) if version else upsert(touched, new, keys)
    (
        merged.hint("rebalance", *parts)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(path)
    )
