"""Structured Streaming form of the incremental refresh."""

from .keyed_kpis import keyed_refresh, use_keyed_state
from .keyed_prices import keyed_averages
from .refresh_stream import read_statement_stream, refresh_stream

__all__ = ["keyed_averages", "keyed_refresh", "read_statement_stream", "refresh_stream", "use_keyed_state"]
