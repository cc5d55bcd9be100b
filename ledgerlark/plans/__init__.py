"""Composite jobs."""

from .history import at_dates, average_history, average_history_asof, rolling_average, truncate_before
from .kpis import compute_kpis, with_debt_change, with_ebit, with_quotes, zero_ebit_symbols
from .pages import host_list, html_rows, table_bodies
from .propagation import propagate, reached_rows, recomputed_kpis, restated
from .refresh import pending_kpis, refresh_kpis, refresh_table, store_kpis
from .screening import (
    beta_order,
    beta_view,
    recommendation_order,
    reorder_columns,
    safe_metrics,
    scatter_data,
    screen,
)
from .universe import (
    biggest_n,
    chosen_exchanges,
    on_exchanges,
    save_tickers,
    save_tickers_by_region,
    tickers,
    tickers_by_region,
    tickers_filtered,
)

__all__ = [
    "at_dates",
    "average_history",
    "average_history_asof",
    "beta_order",
    "beta_view",
    "biggest_n",
    "chosen_exchanges",
    "compute_kpis",
    "host_list",
    "html_rows",
    "on_exchanges",
    "pending_kpis",
    "propagate",
    "reached_rows",
    "recommendation_order",
    "recomputed_kpis",
    "refresh_kpis",
    "refresh_table",
    "reorder_columns",
    "restated",
    "rolling_average",
    "safe_metrics",
    "save_tickers",
    "save_tickers_by_region",
    "scatter_data",
    "screen",
    "store_kpis",
    "table_bodies",
    "tickers",
    "tickers_by_region",
    "tickers_filtered",
    "truncate_before",
    "with_debt_change",
    "with_ebit",
    "with_quotes",
    "zero_ebit_symbols",
]
