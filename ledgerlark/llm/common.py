"""Helpers shared by the operators: words, files in the shared folder, column names."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
# Rows that a small side may have when it is broadcast; beyond it, the join shuffles.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Words of a text, unchanged; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once however often it is used."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(taken: list[str], wish: str) -> str:
    """``wish``, with underscores in front until no column of ``taken`` has that name."""
    names = {name.lower() for name in taken}
    while wish.lower() in names:
        wish = f"_{wish}"
    return wish


def shared_path(spark: SparkSession, name: str) -> str:
    """New path in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that nothing upstream
    runs twice, also when an executor is lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored side for broadcast if it has at most ``bound`` rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LAST_ID = 2**63 - 1


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, th, text)``: the id, with null as the largest, and 64 bits of a hash of the
    text. Rows equal in both are one document."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(body).alias("th"), body.alias("text"))
