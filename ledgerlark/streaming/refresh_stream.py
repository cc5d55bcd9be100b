"""KPI refresh driven by landed statement files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import latest_rows
from ..operators.ordered import SPLIT_ROWS
from ..plans.kpis import compute_kpis
from ..plans.refresh import BUCKET, in_buckets, store_kpis
from ..session import settle
from ..sources.readers import ANNUAL, parse_statements
from ..sources.writers import touched_partitions, upsert_table

# Key of a landed statement, and what tells its versions apart.
STATEMENT_KEYS = ["symbol", "asOfDate", "periodType"]
VERSION = ["_landed", "_file"]


def read_statement_stream(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    """Stream of landed statement files (Parquet, camelCase columns)."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def refresh_stream(
    landed: DataFrame,
    state_path: str,
    quotes: Callable[[], DataFrame],
    table_path: str,
    checkpoint_path: str,
    period_type: str | None = ANNUAL,
    split_rows: int = SPLIT_ROWS,
    **trigger,
) -> StreamingQuery:
    """Keep the KPI table at ``table_path`` up to date with ``landed``.

    The newest version of every statement is kept in a table at ``state_path``,
    partitioned by a hash of the symbol; of a statement that landed more than once,
    the newest file counts. A batch merges its rows into the partitions of its
    symbols and computes the KPIs of these symbols from them, since a KPI may need
    the statement before. Other partitions are neither read nor written, so the
    work of a batch follows its size. A batch that runs again after a failure
    leaves the same tables.
    ``quotes`` is called per batch. By default all that has landed is processed
    and the query stops; ``trigger`` takes the arguments of ``writeStream.trigger``.
    """

    def refresh(batch: DataFrame, _batch_id: int) -> None:
        new = settle(in_buckets(latest_rows(batch, STATEMENT_KEYS, VERSION)))
        upsert_table(new, state_path, STATEMENT_KEYS, [BUCKET], VERSION)
        stored = touched_partitions(batch.sparkSession.read.parquet(state_path), new, [BUCKET])
        touched = stored.join(new.select("symbol").distinct(), "symbol", "left_semi").drop(BUCKET, *VERSION)
        statements = parse_statements(touched, period_type)
        store_kpis(compute_kpis(statements, quotes(), split_rows=split_rows), table_path)

    versions = {"_landed": F.col("_metadata.file_modification_time"), "_file": F.col("_metadata.file_name")}
    return (
        landed.withColumns(versions)
        .writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint_path)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
