"""Tables inside HTML pages: rows, cells by position, filtered host lists."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import host_port, unescaped

# Patterns of a table body, a row and the leading text of a cell.
BODY_PATTERN = r"(?is)<tbody\b[^>]*>(.*?)</tbody>"
ROW_PATTERN = r"(?is)<tr\b[^>]*>(.*?)</tr>"
CELL_PATTERN = r"(?is)<td\b[^>]*>([^<]*)"

# Countries kept by the host list.
HOST_COUNTRIES = ("FR", "DE", "IT", "CH")


def table_bodies(pages: DataFrame, pattern: str = BODY_PATTERN, html: str = "html") -> DataFrame:
    """One row per table body, in place of the page text."""
    bodies = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    return pages.select(*[F.explode(bodies).alias(c) if c == html else F.col(c) for c in pages.columns])


def html_rows(
    pages: DataFrame,
    row_pattern: str = ROW_PATTERN,
    cell_pattern: str = CELL_PATTERN,
    html: str = "html",
) -> DataFrame:
    """One row per table row with its ``cells`` as an array, entities decoded; the page text
    is dropped."""
    rows = F.regexp_extract_all(F.col(html), F.lit(row_pattern), F.lit(1))
    cells = F.regexp_extract_all(F.col("_row"), F.lit(cell_pattern), F.lit(1))
    kept = [c for c in pages.columns if c != html]
    found = pages.select(*kept, F.explode(rows).alias("_row"))
    return found.select(*kept, F.transform(cells, unescaped).alias("cells"))


def host_list(rows: DataFrame, countries: Collection[str] = HOST_COUNTRIES) -> DataFrame:
    """``host:port`` of the rows whose 7th cell is "yes" and whose 3rd is a chosen country."""
    host, port, country, secure = (F.get("cells", F.lit(at)) for at in (0, 1, 2, 6))
    return rows.where((secure == "yes") & country.isin(list(countries))).select(
        *[c for c in rows.columns if c != "cells"], host_port(host, port).alias("proxy")
    )
