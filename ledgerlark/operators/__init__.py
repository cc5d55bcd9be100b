"""DataFrame-to-DataFrame operators."""

from .asof import asof_join
from .columns import (
    bad_cells,
    column_difference,
    concat_tables,
    conform,
    drop_all_null_columns,
    drop_columns,
    move_column,
    rearrange,
    rename_snake,
    sort_columns,
)
from .joins import latest_rows, merge_new_columns, outer_merge, pending, upsert
from .ordered import has_heavy_keys, lookback_window, running_total, slice_heavy_keys
from .ranking import ranked, top_n
from .steps import step_join, value_steps

__all__ = [
    "asof_join",
    "bad_cells",
    "column_difference",
    "concat_tables",
    "conform",
    "drop_all_null_columns",
    "drop_columns",
    "has_heavy_keys",
    "latest_rows",
    "lookback_window",
    "merge_new_columns",
    "move_column",
    "outer_merge",
    "pending",
    "ranked",
    "rearrange",
    "rename_snake",
    "running_total",
    "slice_heavy_keys",
    "sort_columns",
    "step_join",
    "top_n",
    "upsert",
    "value_steps",
]
