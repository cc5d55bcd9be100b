"""Operators on the column list. Apart from the all-null check they run no job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import is_floating, quoted
from ..functions.text import snake_name
from ..session import written


def rename_snake(df: DataFrame) -> DataFrame:
    """Rename all columns from camelCase to snake_case."""
    return df.withColumnsRenamed({name: snake_name(name) for name in df.columns})


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns in declared order: missing ones NULL, unknown ones dropped.

    A cell that cannot be cast becomes NULL; ``bad_cells`` counts such cells.
    """
    return df.selectExpr(*[f"{_declared(df, f)} AS {quoted(f.name)}" for f in schema.fields])


def _declared(df: DataFrame, field: T.StructField) -> str:
    if field.name not in df.columns:
        return f"CAST(NULL AS {field.dataType.simpleString()})"
    if df.schema[field.name].dataType == field.dataType:
        return quoted(field.name)
    return f"TRY_CAST({quoted(field.name)} AS {field.dataType.simpleString()})"


def bad_cells(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``(column, n)`` of the declared columns with cells that ``conform`` cannot cast: one
    aggregate over the columns whose type differs."""
    cast = [f for f in schema.fields if f.name in df.columns and df.schema[f.name].dataType != f.dataType]
    if not cast:
        return df.sparkSession.createDataFrame([], "column string, n long")
    counts = [f"count_if({quoted(f.name)} IS NOT NULL AND {_declared(df, f)} IS NULL) AS {quoted(f.name)}" for f in cast]
    names = ", ".join(f"'{f.name}', {quoted(f.name)}" for f in cast)
    return df.selectExpr(*counts).selectExpr(f"stack({len(cast)}, {names}) AS (column, n)").where("n > 0")


def drop_columns(df: DataFrame, names: Iterable[str], strict: bool = False) -> DataFrame:
    """Drop columns; ``strict`` raises for a name that does not exist."""
    names = list(names)
    missing = [name for name in names if name not in df.columns]
    if strict and missing:
        raise KeyError(f"no such columns: {missing}")
    return df.drop(*names)


def _moved(names: Sequence[str], source: int, target: int) -> list[str]:
    if not 0 <= source < len(names):
        raise IndexError(f"no column at position {source} of {len(names)}")
    rest = [name for at, name in enumerate(names) if at != source]
    return rest[:target] + [names[source]] + rest[target:]


def move_column(df: DataFrame, source: int, target: int) -> DataFrame:
    """Move the column at ``source`` to ``target``; a target past the end appends."""
    return df.select([quoted(name) for name in _moved(df.columns, source, target)])


def rearrange(df: DataFrame, steps: Iterable[tuple], strict: bool = False) -> DataFrame:
    """Run ``("move", i, j)`` and ``("drop", name)`` steps on the column list,
    then apply the outcome as one ``select``."""
    names = list(df.columns)
    for action, *arguments in steps:
        if action == "move":
            names = _moved(names, *arguments)
        elif action == "drop":
            (gone,) = arguments
            if strict and gone not in names:
                raise KeyError(f"no such column: {gone}")
            names = [name for name in names if name != gone]
        else:
            raise ValueError(f"unknown step: {action}")
    return df.select([quoted(name) for name in names])


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that hold no value at all (NaN counts as no value).

    The outcome depends on the data, so the rows are written once and their values counted
    on the way: the input is not run again, and the driver sees one number per column.
    """
    typed = [f for f in df.schema.fields if not isinstance(f.dataType, T.NullType)]
    if not typed:
        return df.select()
    counts = {
        f"_{at}": F.count(F.expr(f"nanvl({quoted(f.name)}, NULL)" if is_floating(f.dataType) else quoted(f.name)))
        for at, f in enumerate(typed)
    }
    stored, filled = written(df.select([quoted(f.name) for f in typed]), counts)
    return stored.select([quoted(f.name) for at, f in enumerate(typed) if filled[f"_{at}"] > 0])


def sort_columns(df: DataFrame) -> DataFrame:
    """Columns in alphabetical order."""
    return df.select([quoted(name) for name in sorted(df.columns)])


def column_difference(left: DataFrame, right: DataFrame) -> list[str]:
    """Sorted names of the columns of ``left`` that ``right`` lacks."""
    return sorted(set(left.columns) - set(right.columns))


def concat_tables(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; duplicates stay, absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
