"""Tables whose upserts become visible in one step.

Rows are in ``data/batch=<id>/bucket=<n>``, by a hash of a key. A version is a small file
``version-<number>.json`` that names, for every bucket, the batch that holds it, along with the
number of buckets, the columns and the label of the last batch. An upsert stages the buckets it touches in
a new batch folder and then renames one version file into place. So a run that dies before
that leaves the old table, a reader never sees half a batch, and a repeated batch does
nothing. The newest version counts; there is one writer at a time.

Files are reached through Spark's file systems, so any store with an atomic rename will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import latest_rows, upsert
from ..session import settle

BUCKET = "bucket"
# Bytes of a table that one bucket should hold, and rows without any hint of their size.
BUCKET_BYTES = 1 << 30
BUCKETS = 64


@dataclass(frozen=True)
class Version:
    number: int
    buckets: int
    batch: str | None
    parts: dict[str, str]  # batch folder by bucket
    schema: str  # of the rows, as JSON


class _Files:
    """The few file operations that Spark's reader and writer lack."""

    def __init__(self, spark: SparkSession, path: str):
        self.make = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.make(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, pattern: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.system.globStatus(self.make(pattern)) or [])

    def write(self, path: str, text: str) -> None:
        """Write under another name, then rename."""
        if self.system.exists(self.make(path)):
            raise FileExistsError(path)
        staged = self.make(f"{path}.{uuid.uuid4().hex}.tmp")
        out = self.system.create(staged, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.system.rename(staged, self.make(path)):
            raise FileExistsError(path)

    def delete(self, path: str) -> None:
        self.system.delete(self.make(path), True)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removeprefix("version-").removesuffix(".json")) for n in _Files(spark, path).names(f"{path}/version-*.json")]


def _version_file(path: str, number: int) -> str:
    return f"{path}/version-{number:012}.json"


def read_version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The given version of the table at ``path``, or the newest one; None if there is none."""
    number = max(_numbers(spark, path), default=None) if number is None else number
    if number is None:
        return None
    return Version(**json.loads(spark.read.text(_version_file(path, number), wholetext=True).first()[0]))


def _rows(spark: SparkSession, path: str, version: Version, buckets: Sequence[str]) -> DataFrame:
    """Rows of some buckets; columns that were added later are NULL in older files."""
    folders = [f"{path}/data/batch={version.parts[b]}/{BUCKET}={b}" for b in sorted(buckets)]
    return spark.read.schema(T.StructType.fromJson(json.loads(version.schema))).parquet(*folders)


def _columns(old: Version | None, rows: DataFrame) -> str:
    known = T.StructType.fromJson(json.loads(old.schema)).fields if old else []
    names = {f.name for f in known}
    return T.StructType([*known, *[T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name not in names]]).json()


def current_table(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """Rows of the newest version, or of the given one; None if there is no table."""
    version = read_version(spark, path, number)
    return _rows(spark, path, version, list(version.parts)) if version and version.parts else None


def buckets_for(expected_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets of a table that will grow to ``expected_bytes``, so that rewriting one stays cheap."""
    return max(1, -(-expected_bytes // bucket_bytes))


def upsert_version(
    new: DataFrame,
    path: str,
    keys: Sequence[str],
    bucket_by: Sequence[str],
    buckets: int | None = None,
    batch: str | None = None,
    version: Sequence[str] = (),
) -> Version:
    """Upsert ``new`` into the table at ``path`` and return the version that shows it.

    ``bucket_by`` must be among the ``keys``, so that a key stays in its bucket. The number of
    buckets is stored with the table; another one raises. A ``batch`` label that the newest
    version already has is skipped. With ``version`` columns the newest row of a key stays.
    """
    if not set(bucket_by) <= set(keys):
        raise ValueError("bucket_by must be among the keys")
    spark = new.sparkSession
    old = read_version(spark, path)
    if old and buckets is not None and buckets != old.buckets:
        raise ValueError(f"the table at {path} has {old.buckets} buckets, not {buckets}")
    if old and batch is not None and batch == old.batch:
        return old
    count = old.buckets if old else buckets or BUCKETS
    placed = settle(new.withColumn(BUCKET, F.pmod(F.hash(*bucket_by), F.lit(count))))
    # At most as many rows as the table has buckets.
    touched = [str(r[0]) for r in placed.select(BUCKET).distinct().collect()]
    rows, parts = placed.drop(BUCKET), dict(old.parts) if old else {}
    columns = _columns(old, rows)
    stored = [b for b in touched if b in parts]
    if stored:
        before = _rows(spark, path, old, stored)
        rows = latest_rows(before.unionByName(rows, allowMissingColumns=True), keys, version) if version else upsert(before, rows, keys)
    elif version:
        rows = latest_rows(rows, keys, version)
    made = uuid.uuid4().hex
    if touched:
        staged = rows.withColumn(BUCKET, F.pmod(F.hash(*bucket_by), F.lit(count)))
        staged.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/data/batch={made}")
    shown = Version((old.number if old else 0) + 1, count, batch, parts | dict.fromkeys(touched, made), columns)
    publish(spark, path, shown)
    return shown


def publish(spark: SparkSession, path: str, version: Version) -> None:
    """Make ``version`` the newest one. This is the step that readers see."""
    _Files(spark, path).write(_version_file(path, version.number), json.dumps(asdict(version)))


def expire_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` versions and the batches that only these had, also
    batches that were staged and never published. Readers of deleted versions fail."""
    files, numbers = _Files(spark, path), sorted(_numbers(spark, path))
    kept = numbers[-max(keep, 1) :]
    used = {batch for n in kept for batch in read_version(spark, path, n).parts.values()}
    gone = numbers[: len(numbers) - len(kept)]
    for number in gone:
        files.delete(_version_file(path, number))
    for name in files.names(f"{path}/data/batch=*"):
        if name.removeprefix("batch=") not in used:
            files.delete(f"{path}/data/{name}")
    return gone
