"""Column expressions. All of them are built-in JVM-side expressions."""

from .numbers import finite, nan_to_null, ratio
from .ratios import QUOTE_COLUMNS, derived_columns, derived_names
from .text import camel_to_snake, host_port, iso_timestamp, market_cap_millions, snake_name, stamp_text, unescaped

__all__ = [
    "QUOTE_COLUMNS",
    "camel_to_snake",
    "derived_columns",
    "derived_names",
    "finite",
    "host_port",
    "iso_timestamp",
    "market_cap_millions",
    "nan_to_null",
    "ratio",
    "snake_name",
    "stamp_text",
    "unescaped",
]
