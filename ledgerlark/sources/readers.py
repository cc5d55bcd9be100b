"""Readers of landed files. Every schema is declared, so no read infers types."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import nan_to_null, quoted
from ..operators.columns import conform, rename_snake
from ..schema import (
    HISTORY_SCHEMA,
    LANDED,
    METRIC_SCHEMA,
    QUOTE_SCHEMA,
    SCREENER_ROW_SCHEMA,
    STATEMENT_SCHEMA,
    TICKER_SCHEMA,
)
from .inference import cell_value, infer_types

REJECT = "_corrupt_record"
_QUOTE_MAP = T.MapType(T.StringType(), QUOTE_SCHEMA)

# Fixed value: period type of annual statements.
ANNUAL = "12M"


def read_tickers(spark: SparkSession, path: str, dash_classes: bool = False) -> DataFrame:
    """Headerless ticker list. Symbols are trimmed; ``dash_classes`` writes ``BRK/A`` as ``BRK-A``."""
    symbol = F.trim("symbol")
    if dash_classes:
        symbol = F.replace(symbol, F.lit("/"), F.lit("-"))
    listed = spark.read.schema(TICKER_SCHEMA).option("header", False).csv(path)
    return listed.select(symbol.alias("symbol")).where(F.col("symbol") != "")


def ticker_table(spark: SparkSession, symbols: Iterable[str]) -> DataFrame:
    """Ticker list given as plain values, such as a short watch list."""
    return spark.createDataFrame([(symbol,) for symbol in symbols], TICKER_SCHEMA)


def read_metrics(
    spark: SparkSession, path: str, schema: T.StructType = METRIC_SCHEMA, multi_line: bool = False, infer: bool = False
) -> DataFrame:
    """Wide metrics CSV with a header. Declared columns get their type, the others
    stay text, or with ``infer`` get the narrowest type that holds their cells (one job
    more, over these columns only). ``multi_line`` allows line breaks inside cells, but
    then a file is read by one task."""
    text = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
    types = {f.name: f.dataType for f in schema.fields}
    found = {}
    if infer:
        free = infer_types(text.select([quoted(c) for c in text.columns if c not in types]))
        found = {f.name: cell_value(f).alias(f.name) for f in free.fields}
    return nan_to_null(
        text.select(
            [F.col(quoted(c)).try_cast(types[c]).alias(c) if c in types else found.get(c, F.col(quoted(c))) for c in text.columns]
        )
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Whole Parquet table."""
    return spark.read.parquet(path)


def lookup(table: DataFrame, symbol: str) -> DataFrame:
    """All rows of one symbol; the predicate reaches the Parquet scan."""
    return table.where(F.col("symbol") == F.lit(symbol))


def split_rejects(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSON lines in the column ``value`` to good rows and rejected lines."""
    marked = T.StructType([*schema.fields, T.StructField(REJECT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT}
    parsed = lines.select("value", F.from_json("value", marked, options).alias("_parsed"))
    failed = F.col("_parsed").isNull() | F.col(f"_parsed.{REJECT}").isNotNull()
    good = parsed.where(~failed).select(*[F.col("_parsed")[name].alias(name) for name in schema.names])
    return good, parsed.where(failed).select(F.col("value").alias(REJECT))


def parse_statements(raw: DataFrame, period_type: str | None = ANNUAL) -> DataFrame:
    """Landed statement rows, camelCase, to the fixed panel; NaN becomes NULL."""
    panel = nan_to_null(conform(rename_snake(raw), STATEMENT_SCHEMA))
    return panel if period_type is None else panel.where(F.col("period_type") == period_type)


def read_statements(spark: SparkSession, path: str, period_type: str | None = ANNUAL) -> DataFrame:
    """Landed statements of all tickers, as Parquet."""
    return parse_statements(spark.read.parquet(path), period_type)


def landed_statements(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Landed JSON lines with the given camelCase schema: statement rows and rejects.

    Vendor replies that are not a table end up among the rejects.
    """
    return split_rejects(spark.read.text(path), schema)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Daily price history, partitioned by year; NaN becomes NULL."""
    return nan_to_null(conform(spark.read.parquet(path), HISTORY_SCHEMA))


def parse_quotes(replies: DataFrame, column: str = "value", landed: str | None = None) -> DataFrame:
    """Quote replies, one JSON map of symbol to fields each, to one row per reply and
    symbol. ``landed`` names the column that tells when a reply came in."""
    when = [F.col(landed).alias(LANDED)] if landed else []
    quotes = F.from_json(F.col(column), _QUOTE_MAP)
    return replies.select(*when, F.explode(quotes).alias("symbol", "_quote")).select("symbol", "_quote.*", *[LANDED] * bool(landed))


def quote_rejects(replies: DataFrame, column: str = "value") -> DataFrame:
    """Replies that are no JSON map; ``parse_quotes`` takes nothing from them."""
    failed = F.from_json(F.col(column), _QUOTE_MAP).isNull()
    return replies.where(failed).select(F.col(column).alias(REJECT))


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Quote replies landed as JSON lines."""
    return parse_quotes(spark.read.text(path))


def read_screener(
    spark: SparkSession,
    path: str,
    exchange: str | None = None,
    row_schema: T.StructType = SCREENER_ROW_SCHEMA,
) -> DataFrame:
    """Screener replies to rows. Without ``exchange`` it comes from the partition
    folder ``exchange=…``. A reply is one JSON document, so it is one task."""
    reply = T.StructType(
        [T.StructField("data", T.StructType([T.StructField("rows", T.ArrayType(row_schema))]))]
    )
    if exchange is None:
        reply = reply.add(T.StructField("exchange", T.StringType()))
    replies = spark.read.schema(reply).option("multiLine", True).json(path)
    name = F.col("exchange") if exchange is None else F.lit(exchange)
    return replies.select(name.alias("exchange"), F.inline("data.rows"))


def read_region_companies(spark: SparkSession, path: str) -> DataFrame:
    """Company CSV files with a header, under partition folders ``region=…``."""
    listed = spark.read.option("header", True).csv(path)
    symbol = next((c for c in listed.columns if c.lower() == "symbol"), None)
    if symbol is None:
        raise ValueError("no symbol column")
    return listed.select(F.trim(F.col(f"`{symbol}`")).alias("symbol"), "region")
