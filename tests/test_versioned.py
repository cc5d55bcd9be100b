"""Upserts that become visible in one step."""

from __future__ import annotations

import pytest

from ledgerlark import sources
from ledgerlark.sources import versioned

from .conftest import rows

KEYS = ["symbol", "year"]


def frame(spark, data):
    return spark.createDataFrame(data, "symbol string, year int, debt double")


OLD = [(s, y, 1.0) for s in ("A", "B", "C", None) for y in (2019, None)]


def test_upsert_and_reread(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sources.current_table(spark, path) is None
    sources.upsert_version(frame(spark, OLD), path, KEYS, ["symbol"], buckets=5)
    shown = sources.upsert_version(frame(spark, [("A", 2019, 9.0), (None, None, 8.0), ("D", 2020, 7.0)]), path, KEYS, ["symbol"], batch="b1")
    assert (shown.number, shown.buckets, shown.batch) == (2, 5, "b1")
    want = {r[:2]: r for r in OLD} | {("A", 2019): ("A", 2019, 9.0), (None, None): (None, None, 8.0), ("D", 2020): ("D", 2020, 7.0)}
    assert rows(sources.current_table(spark, path)) == sorted(want.values(), key=repr)
    assert rows(sources.current_table(spark, path, 1)) == sorted(OLD, key=repr)  # the version before


def test_run_that_dies_before_the_swap_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sources.upsert_version(frame(spark, OLD), path, KEYS, ["symbol"], batch="b1")
    reader = sources.current_table(spark, path)

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as patched:
        patched.setattr(versioned, "publish", die)
        with pytest.raises(RuntimeError):
            sources.upsert_version(frame(spark, [("A", 2019, 9.0), ("B", 2019, 9.0)]), path, KEYS, ["symbol"], batch="b2")
    assert rows(sources.current_table(spark, path)) == rows(reader) == sorted(OLD, key=repr)
    sources.upsert_version(frame(spark, [("A", 2019, 9.0)]), path, KEYS, ["symbol"], batch="b2")
    assert len(list((tmp_path / "t" / "data").glob("batch=*"))) == 3
    assert rows(reader) == sorted(OLD, key=repr)  # a reader keeps what it began with
    assert sources.expire_versions(spark, path, keep=1) == [1]
    assert len(list((tmp_path / "t" / "data").glob("batch=*"))) == 2  # the dead run's files are gone too
    assert ("A", 2019, 9.0) in rows(sources.current_table(spark, path))


def test_repeated_batch_and_other_bucket_count(spark, tmp_path):
    path = str(tmp_path / "t")
    first = sources.upsert_version(frame(spark, OLD), path, KEYS, ["symbol"], buckets=4, batch="b1")
    assert sources.upsert_version(frame(spark, [("Z", 1, 1.0)]), path, KEYS, ["symbol"], batch="b1") == first
    with pytest.raises(ValueError, match="4 buckets"):
        sources.upsert_version(frame(spark, OLD), path, KEYS, ["symbol"], buckets=16)
    with pytest.raises(ValueError, match="among the keys"):
        sources.upsert_version(frame(spark, OLD), path, KEYS, ["debt"])
    with pytest.raises(FileExistsError):  # a second writer
        versioned.publish(spark, path, first)


def test_untouched_buckets_stay_where_they_are(spark, tmp_path):
    path = str(tmp_path / "t")
    first = sources.upsert_version(frame(spark, [(f"S{i}", 1, 1.0) for i in range(60)]), path, KEYS, ["symbol"], buckets=16)
    second = sources.upsert_version(frame(spark, [("S3", 2, 1.0)]), path, KEYS, ["symbol"])
    assert sum(first.parts[b] != second.parts[b] for b in first.parts) == 1
    assert sources.current_table(spark, path).count() == 61


def test_newest_rows_new_columns_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    sources.upsert_version(frame(spark, [("A", 5, 1.0), ("A", 3, 2.0)]), path, ["symbol"], ["symbol"], version=["year"])
    sources.upsert_version(frame(spark, [("A", 4, 9.0), ("B", 1, 1.0)]).selectExpr("*", "'x' AS note"), path, ["symbol"], ["symbol"], version=["year"])
    sources.upsert_version(frame(spark, []), path, ["symbol"], ["symbol"])
    assert rows(sources.current_table(spark, path)) == [("A", 5, 1.0, None), ("B", 1, 1.0, "x")]
    assert sources.buckets_for(10**13) == 9314 and sources.buckets_for(0) == 1


def test_first_batch_may_be_empty(spark, tmp_path):
    sources.upsert_version(frame(spark, []), str(tmp_path / "t"), KEYS, ["symbol"])
    assert sources.current_table(spark, str(tmp_path / "t")) is None
