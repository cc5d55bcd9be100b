"""Company fundamentals and market data as Spark jobs."""

from . import functions, operators, plans, sources
from .schema import BASE_COLUMNS, HISTORY_SCHEMA, KEY_COLUMNS, METRIC_SCHEMA, STATEMENT_SCHEMA
from .session import build_session, ensure_checkpoint_dir, settle

__all__ = [
    "BASE_COLUMNS",
    "HISTORY_SCHEMA",
    "KEY_COLUMNS",
    "METRIC_SCHEMA",
    "STATEMENT_SCHEMA",
    "build_session",
    "ensure_checkpoint_dir",
    "functions",
    "operators",
    "plans",
    "settle",
    "sources",
]
