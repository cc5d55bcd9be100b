"""Rows with a multiplicity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Copies of a row that one task writes in one go.
BLOCK = 100_000


def repeat_rows(df: DataFrame, times: Column, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """The given columns of each row ``times`` times.

    Rows with many copies are first cut into blocks, and the blocks are spread
    over all tasks. The number of partitions is fixed there, since adaptive
    execution would see few small rows and join them. Both branches read the same
    exchange of ``df``, if it ends in one.
    """
    counted = df.select(*columns, times.cast("bigint").alias("_times"))
    one, full = F.lit(1).cast("bigint"), F.lit(block).cast("bigint")
    few = counted.where((F.col("_times") > 0) & (F.col("_times") <= full))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = (
        counted.where(F.col("_times") > full)
        .withColumn("_block", F.explode(F.sequence(one, F.ceil(F.col("_times") / full))))
        .repartition(partitions, *columns, "_block")
        .withColumn("_times", F.least(full, F.col("_times") - (F.col("_block") - 1) * full))
        .drop("_block")
    )
    return few.unionByName(blocks).withColumn("_nth", F.explode(F.sequence(one, F.col("_times")))).select(*columns)
