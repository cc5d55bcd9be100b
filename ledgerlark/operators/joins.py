"""Joins of the incremental refresh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import column_difference, sort_columns
from .copies import repeat_rows
from .ordered import null_safe_join


def merge_new_columns(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that adds only the columns ``left`` lacks; columns then sorted."""
    new = column_difference(right, left)
    return sort_columns(left.join(right.select(*keys, *new), list(keys), "left"))


def left_lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on one key; all left columns stay in place, the right ones follow."""
    other = f"_right_{key}"
    joined = left.join(right.withColumnRenamed(key, other), F.col(key) == F.col(other), "left")
    return joined.drop(other)


def pending(universe: DataFrame, done: DataFrame, key: str = "symbol") -> DataFrame:
    """Rows of ``universe`` whose key is not in ``done`` yet."""
    return universe.join(done.select(key).distinct(), key, "left_anti")


def outer_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer merge on all common columns, NULL matching NULL.

    With the same columns on both sides a match adds nothing but multiplicity:
    ``n`` old and ``m`` new copies of a row give ``n * m``. So the copies are
    counted, which needs one shuffle and folds copies before it, instead of
    joined.
    """
    shared = [c for c in old.columns if c in new.columns]
    if not shared:
        raise ValueError("no common columns")
    if set(old.columns) != set(new.columns):
        return _outer_merge_wide(old, new, shared)
    both = old.select("*", F.lit(1).alias("_old"), F.lit(0).alias("_new")).unionByName(
        new.select("*", F.lit(0).alias("_old"), F.lit(1).alias("_new"))
    )
    counted = both.groupBy(*old.columns).agg(F.sum("_old").alias("_olds"), F.sum("_new").alias("_news"))
    olds, news = F.col("_olds"), F.col("_news")
    times = F.when((olds > 0) & (news > 0), olds * news).otherwise(olds + news)
    return repeat_rows(counted, times, old.columns)


def _outer_merge_wide(old: DataFrame, new: DataFrame, shared: list[str]) -> DataFrame:
    renamed = new.withColumnsRenamed({c: f"_new_{c}" for c in shared})
    condition = [F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in shared]
    extra = [c for c in new.columns if c not in shared]
    # A presence flag, since a matched row may be NULL in every shared column.
    joined = old.withColumn("_in_old", F.lit(True)).join(renamed, condition, "full")
    return joined.select(
        *[F.when(F.col("_in_old"), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c) for c in shared],
        *[c for c in old.columns if c not in shared],
        *extra,
    )


def latest_rows(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Newest row per key. A plain aggregate, so copies of a key shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row, age = F.struct(*rest), F.struct(*version)
    return df.groupBy(*keys).agg(F.max_by(row, age).alias("_row")).select(*[
        F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns
    ])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose keys are not in ``new``, plus all of ``new``."""
    kept = null_safe_join(old, new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
