"""Null, NaN and infinity rules: inside the engine only NULL means missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is NULL for a zero or missing denominator."""
    return F.try_divide(numerator, denominator)


def finite(value: Column) -> Column:
    """NULL for NaN and for both infinities (NaN sorts above infinity)."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DoubleType, T.FloatType))


def quoted(name: str) -> str:
    """Column name for use inside a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def nan_to_null_sql(name: str) -> str:
    return f"nanvl({quoted(name)}, CAST(NULL AS DOUBLE)) AS {quoted(name)}"


def finite_sql(name: str) -> str:
    return f"CASE WHEN abs({quoted(name)}) < DOUBLE('Infinity') THEN {quoted(name)} END AS {quoted(name)}"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column, in one projection.

    SQL text keeps the building of a wide projection cheap on the driver.
    """
    return df.selectExpr(
        *[nan_to_null_sql(f.name) if is_floating(f.dataType) else quoted(f.name) for f in df.schema.fields]
    )


def infinity_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN and ±infinity into NULL in every floating column."""
    return df.selectExpr(
        *[finite_sql(f.name) if is_floating(f.dataType) else quoted(f.name) for f in df.schema.fields]
    )
