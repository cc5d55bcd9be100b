"""Types of text columns, found in one aggregate over all rows.

Every cell is one of five kinds. The kinds seen in a column are joined along a lattice:

    missing < boolean, long < double, and anything mixed otherwise is text

so whole numbers and fractions make a double, but booleans and numbers make text. A column
without a value is a double. Whole numbers beyond 64 bits are doubles. Kinds are bits and
their join is ``bit_or``, which is combined before the shuffle: one row reaches the driver,
with one number per column, whatever the size of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import quoted

# Spellings of a missing cell.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Spellings of true and false.
TRUE, FALSE = ("true", "True", "TRUE"), ("false", "False", "FALSE")

_WHOLE = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|Infinity)$"

_NONE, _BOOLEAN, _LONG, _DOUBLE, _TEXT = 0, 1, 2, 4, 8
_TYPES = {_NONE: "double", _BOOLEAN: "boolean", _LONG: "bigint", _DOUBLE: "double", _LONG | _DOUBLE: "double"}


def _among(cell: str, values: tuple[str, ...]) -> str:
    return f"{cell} IN ({', '.join(repr(v) for v in values)})"


def _kind(name: str) -> str:
    cell = f"trim({quoted(name)})"
    return (
        f"CASE WHEN {cell} IS NULL OR {_among(cell, MISSING)} THEN {_NONE}"
        f" WHEN {_among(cell, TRUE + FALSE)} THEN {_BOOLEAN}"
        f" WHEN {cell} RLIKE '{_WHOLE}' THEN CASE WHEN try_cast({cell} AS BIGINT) IS NULL THEN {_DOUBLE} ELSE {_LONG} END"
        f" WHEN {cell} RLIKE '{_NUMBER}' THEN {_DOUBLE} ELSE {_TEXT} END"
    )


def cell_value(field: T.StructField) -> Column:
    """The text column of that name as the type of the field: NULL where the cell is missing
    or does not fit."""
    cell, data_type = f"trim({quoted(field.name)})", field.dataType.simpleString()
    if data_type == "boolean":
        return F.expr(f"CASE WHEN {_among(cell, TRUE)} THEN true WHEN {_among(cell, FALSE)} THEN false END")
    if data_type == "string":
        return F.expr(f"CASE WHEN NOT {_among(cell, MISSING)} THEN {quoted(field.name)} END")
    return F.expr(f"CASE WHEN {cell} RLIKE '{_NUMBER}' THEN try_cast({cell} AS {data_type}) END")


def column_types(text: DataFrame) -> DataFrame:
    """``(position, column, type)`` of every column of a table of text columns; an empty
    table has doubles only. One aggregate, run when the result is."""
    names = text.columns
    if not names:
        return text.sparkSession.createDataFrame([], "position int, column string, type string")
    kinds = text.selectExpr(*[f"coalesce(bit_or({_kind(c)}), {_NONE}) AS _{at}" for at, c in enumerate(names)])
    listed = ", ".join("{}, '{}', _{}".format(at, c.replace("\\", "\\\\").replace("'", "\\'"), at) for at, c in enumerate(names))
    cases = " ".join(f"WHEN {mask} THEN '{name}'" for mask, name in _TYPES.items())
    return kinds.selectExpr(f"stack({len(names)}, {listed}) AS (position, column, kinds)").selectExpr(
        "position", "column", f"CASE kinds {cases} ELSE 'string' END AS type"
    )


def infer_types(text: DataFrame) -> T.StructType:
    """Schema of the narrowest types that hold every cell. Runs one job."""
    found = sorted(column_types(text).collect())
    return T.StructType([T.StructField(r["column"], T.DataType.fromDDL(r["type"])) for r in found])


def typed(text: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` with their types. Missing cells, and cells of another type
    than was inferred, are NULL."""
    return text.select(*[cell_value(f).alias(f.name) for f in schema.fields])
