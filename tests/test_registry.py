"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as driver  # noqa: E402
from registry.oracle import ORACLE  # noqa: E402
from registry.spark_queries import QUERIES  # noqa: E402

from .conftest import plan_text  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    assert got == sorted(result.fetchall(), key=repr)
    plan = plan_text(df)
    for word in ("PythonUDF", "ArrowEval", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_entry(spark):
    assert driver.entry(spark).count() > 0
