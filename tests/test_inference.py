"""Inferred types, drifting replies, entities, and guards inside the plan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlark import sources
from ledgerlark.functions import unescaped
from ledgerlark.operators import top_n
from ledgerlark.sources.replies import EMPTY, NO_FIELDS, NO_JSON, NO_MAP

from .conftest import ordered, rows


def types_of(spark, *columns):
    """Inferred type of each list of cells, all of one length."""
    names = [f"c{n}" for n in range(len(columns))]
    text = spark.createDataFrame(list(zip(*columns, strict=True)), ", ".join(f"{n} string" for n in names))
    return [f.dataType.simpleString() for f in sources.infer_types(text).fields]


def test_lattice(spark):
    assert types_of(spark, ["1", "-2"], ["1", "2.5"], ["1", None], ["True", "false"], ["True", "1"], ["1", "x"]) == [
        "bigint", "double", "bigint", "boolean", "string", "string",
    ]
    assert types_of(spark, ["", None], ["NaN", "n/a"], ["9223372036854775807", "1"], ["9223372036854775808", "1"]) == [
        "double", "double", "bigint", "double",
    ]
    # Letters that a number cast would take, blanks around numbers, and words near true.
    assert types_of(spark, ["1d", "2"], ["1.5f", "2"], [" 7 ", "8"], ["1e5", ".5"], ["5.", "+3"], ["tRUE", "t"], ["inf", "-Infinity"]) == [
        "string", "string", "bigint", "double", "double", "string", "double",
    ]


def test_typed_cells(spark):
    text = spark.createDataFrame([("7", "TRUE", " x", "a"), ("NA", "", "null", "3"), ("8", None, "y ", "0.5")], "`a.b` string, f string, t string, m string")
    schema = sources.infer_types(text)
    assert rows(sources.typed(text, schema)) == sorted([(7, True, " x", "a"), (None, None, None, "3"), (8, None, "y ", "0.5")], key=repr)
    # A cell that came after the types were found is NULL and stops nothing.
    later = spark.createDataFrame([("x", "1", "t", "m")], text.schema)
    assert rows(sources.typed(later, schema)) == [(None, None, "t", "m")]


def test_no_rows_and_odd_names(spark):
    text = spark.createDataFrame([], "`it's` string, `a\\\\b` string, `c``d` string")
    assert [tuple(r) for r in sources.column_types(text).collect()] == [(0, "it's", "double"), (1, text.columns[1], "double"), (2, "c`d", "double")]
    assert sources.column_types(text.select()).count() == 0


def test_metrics_with_inferred_columns(spark, tmp_path):
    file = tmp_path / "metrics.csv"
    file.write_text("symbol,beta,employees,listed,city\nNA,1.5,12,True,Bonn\nB,x,,False,NA\n")
    df = sources.read_metrics(spark, str(file), infer=True)
    assert df.schema.simpleString() == "struct<symbol:string,beta:double,employees:bigint,listed:boolean,city:string>"
    assert ordered(df) == [("NA", 1.5, 12, True, "Bonn"), ("B", None, None, False, None)]


REPLIES = [
    (1, '{"A": {"askSize": 3, "bidSize": "4.5"}, "B": {"askSize": [1], "extra": {"x": 1}}}'),
    (2, '{"A": 5, "C": {}}'),
    (3, "oops"),
    (4, None),
    (5, "[]"),
    (6, "null"),
    (7, '{"A": {"askSize": null, "extra": {"x": "y"}}}'),
    (8, " "),
    (9, "{}"),
]


@pytest.fixture(scope="module")
def replies(spark):
    return spark.createDataFrame(REPLIES, "n int, value string")


def test_drifting_quotes(replies):
    got = rows(sources.drifting_quotes(replies), "n", "symbol", "askSize", "bidSize")
    assert got == [(1, "A", 3.0, 4.5), (1, "B", None, None), (2, "C", None, None), (7, "A", None, None)]


def test_drifting_rejects(replies):
    got = {(r.n, r.symbol, r.reason) for r in sources.drifting_rejects(replies).collect()}
    assert got == {(2, "A", NO_FIELDS), (3, None, NO_JSON), (4, None, EMPTY), (5, None, NO_MAP), (6, None, NO_MAP), (8, None, EMPTY)}


def test_field_drift(replies):
    got = {(r.field, r.state): (r.n, r.type) for r in sources.field_drift(replies).collect()}
    assert got[("extra", "unknown")] == (2, "OBJECT<x: VARIANT>")
    assert got[("askSize", "wrong type")] == (1, "ARRAY<BIGINT>")
    assert got[("askSize", "missing")][0] == 2 and got[("askSize", "read")][0] == 1
    assert got[("twoHundredDayAverage", "missing")][0] == 4
    assert sum(n for (field, _), (n, _) in got.items() if field == "bidSize") == 4


def test_entities(spark):
    given = {
        "a &amp;&lt; b": "a &< b",
        "&amp;lt;": "&lt;",
        "&#233;&#xE9;&#X1F600;": "éé😀",
        "&#0;&#xD800;&#1114112;": "&#0;&#xD800;&#1114112;",
        "&nope; & &#; &#x;": "&nope; & &#; &#x;",
        "plain\n": "plain\n",
        "x\n&quot;": 'x\n"',
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in given] + [(None,)], "t string").select("t", unescaped(F.col("t")).alias("u"))
    assert {r.t: r.u for r in df.collect()} == given | {None: None}


def test_guard_in_the_plan(spark):
    df = spark.createDataFrame([(n, f"s{n}") for n in range(10)], "v int, s string").repartition(3)
    spark.sparkContext.setJobGroup("lazy", "top-n")
    try:
        best = top_n(df, [F.col("v").desc()], 4, lazy=True)
        more = top_n(df, [F.col("v").desc()], 11, lazy=True)
        none = top_n(df.where("v > 99"), [F.col("v").desc()], 1, lazy=True)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert ordered(best) == [(9, "s9"), (8, "s8"), (7, "s7"), (6, "s6")]
    for short in (more, none):
        with pytest.raises(Exception, match="fewer than"):
            short.count()
