"""Readers and writers of landed files and tables."""

from .inference import column_types, infer_types, typed
from .readers import (
    landed_statements,
    lookup,
    parse_quotes,
    parse_statements,
    quote_rejects,
    read_history,
    read_metrics,
    read_quotes,
    read_region_companies,
    read_screener,
    read_statements,
    read_table,
    read_tickers,
    split_rejects,
    ticker_table,
)
from .replies import drifting_quotes, drifting_rejects, field_drift
from .versioned import buckets_for, current_table, expire_versions, read_version, upsert_version
from .writers import (
    append_history,
    append_table,
    upsert_table,
    write_bucketed,
    write_filtered_metrics,
    write_snapshot,
    write_ticker_list,
)

__all__ = [
    "append_history",
    "append_table",
    "buckets_for",
    "column_types",
    "current_table",
    "drifting_quotes",
    "drifting_rejects",
    "expire_versions",
    "field_drift",
    "infer_types",
    "landed_statements",
    "lookup",
    "parse_quotes",
    "parse_statements",
    "quote_rejects",
    "read_history",
    "read_metrics",
    "read_quotes",
    "read_region_companies",
    "read_screener",
    "read_statements",
    "read_table",
    "read_tickers",
    "read_version",
    "split_rejects",
    "ticker_table",
    "typed",
    "upsert_table",
    "upsert_version",
    "write_bucketed",
    "write_filtered_metrics",
    "write_snapshot",
    "write_ticker_list",
]
