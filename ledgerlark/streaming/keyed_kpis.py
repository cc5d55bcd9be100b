"""KPI refresh from keyed state: a batch reads no stored statement.

The state of a symbol is a map from date and period to the newest landed version of that
statement. A batch merges its rows into the maps of its symbols and passes on only the
statements that its changes reach (see ``plans.propagation``), each with the debt change
and the EBIT flag that it takes from the others. Their KPIs are computed in full and upserted.
Which file a statement landed in, and in which order files are read, does not matter.

The work of a batch follows its rows and the statements of their symbols, some tens each.
Quotes are the newest when a row is computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.numbers import nan_to_null
from ..operators.columns import conform, rename_snake
from ..operators.joins import left_lookup
from ..plans.kpis import kpi_columns, quote_figures
from ..schema import KEY_COLUMNS, STATEMENT_SCHEMA
from ..sources.readers import ANNUAL
from ..sources.versioned import upsert_version

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Microseconds are kept in the text of a statement.
_AS_TEXT = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_KEY = "day string, period string"
_VALUE = "version string, debt double, zero boolean, statement string"
_OUT = "statement string, debt_change double, use_income boolean"


class Statements(StatefulProcessor):
    """Newest version of every statement of a symbol."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getMapState("statements", _KEY, _VALUE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known = {tuple(k): tuple(v) for k, v in self.stored.iterator()}
        had_zero = any(v[2] for v in known.values())
        changed = set()
        for batch in rows:
            for day, period, version, debt, zero, statement in batch[["day", "period", "version", "debt", "zero", "statement"]].itertuples(index=False):
                new = (version, None if pd.isna(debt) else float(debt), bool(zero), statement)
                old = known.get((day, period))
                if old is None or new[0] > old[0] or (new[0] == old[0] and new[3] > old[3]):
                    if old is None or old[3] != new[3]:
                        changed.add((day, period))
                    known[day, period] = new
                    self.stored.updateValue((day, period), new)
        use_income = any(v[2] for v in known.values())
        out, before, reached = [], None, False
        for place in sorted(known):
            _, debt, _, statement = known[place]
            if place in changed or reached or use_income != had_zero:
                out.append((statement, None if debt is None or before is None else debt - before, use_income))
            before, reached = debt, place in changed
        if out:
            yield pd.DataFrame(out, columns=["statement", "debt_change", "use_income"])

    def close(self) -> None:
        pass


def _keyed(landed: DataFrame, period_type: str | None) -> DataFrame:
    """Statements as text, with what the state compares. The version is the time and name
    of the file."""
    day = lambda c: F.coalesce(F.date_format(c, "yyyyMMddHHmmssSSSSSS"), F.lit(""))
    versions = {"_modified": F.col("_metadata.file_modification_time"), "_file": F.col("_metadata.file_name")}
    marked = rename_snake(landed.withColumns(versions))
    fields = T.StructType([*STATEMENT_SCHEMA.fields, T.StructField("_modified", T.TimestampType()), T.StructField("_file", T.StringType())])
    panel = nan_to_null(conform(marked, fields))
    panel = panel if period_type is None else panel.where(F.col("period_type") == period_type)
    return panel.select(
        "symbol",
        day(F.col("as_of_date")).alias("day"),
        # A null period sorts before all others.
        F.coalesce(F.concat(F.lit("+"), "period_type"), F.lit("")).alias("period"),
        F.concat_ws(" ", day(F.col("_modified")), "_file").alias("version"),
        F.col("total_debt").alias("debt"),
        F.coalesce(F.col("ebit") == 0, F.lit(False)).alias("zero"),
        F.to_json(F.struct(*STATEMENT_SCHEMA.names), _AS_TEXT).alias("statement"),
    )


def keyed_refresh(
    landed: DataFrame,
    quotes: Callable[[], DataFrame],
    table_path: str,
    checkpoint_path: str,
    period_type: str | None = ANNUAL,
    buckets: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Keep the versioned KPI table at ``table_path`` up to date with the statement files of
    ``landed``, from keyed state alone; ``sources.current_table`` reads it.

    The session's state store must be able to hold maps; ``use_keyed_state`` sets that. A batch
    is visible in one step, and one that runs again is skipped. ``quotes`` is called per batch. By default all that
    has landed is processed and the query stops; ``trigger`` takes the arguments of
    ``writeStream.trigger``.
    """

    def refresh(reached: DataFrame, batch_id: int) -> None:
        row = F.from_json("statement", STATEMENT_SCHEMA, _AS_TEXT)
        rows = reached.select(row.alias("_row"), F.col("debt_change").alias("_debt_change"), F.col("use_income").alias("_use_income"))
        rows = left_lookup(rows.select("_row.*", "_debt_change", "_use_income"), quote_figures(quotes()), "symbol")
        upsert_version(kpi_columns(rows), table_path, KEY_COLUMNS, ["symbol"], buckets, f"{checkpoint_path}#{batch_id}")

    reached = _keyed(landed, period_type).groupBy("symbol").transformWithStateInPandas(Statements(), _OUT, "update", "none")
    return (
        reached.writeStream.foreachBatch(refresh)
        .outputMode("update")
        .option("checkpointLocation", checkpoint_path)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def use_keyed_state(spark: SparkSession) -> None:
    """Let stateful queries of this session keep maps and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
