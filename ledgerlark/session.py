"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# A skewed join is split even if that costs one more shuffle behind it.
# spark.sql.codegen.maxFields keeps its default of 100: whole-stage code for the
# 184 fields of a KPI row gets too big for the JIT compiler and ran 4 times slower.
# Recording the Python call site of every column is switched off, since it slows
# the building of wide plans.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "ledgerlark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder named by ``spark.checkpoint.dir``; make one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerlark-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost
    executor can neither recompute nor change it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, figures: Mapping[str, Column]) -> tuple[DataFrame, dict]:
    """Write ``df`` once as Parquet to the shared folder, with aggregates taken on the way.

    Returns the stored rows and the figures. Later steps read only the columns they need,
    and ``df`` itself is run once. The folder is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, *[value.alias(name) for name, value in figures.items()]).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path), seen.get
