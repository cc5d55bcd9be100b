"""Rows without an id whose texts a hash of 32 bits does not tell apart."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import jaccard, substring_dedup

# F.hash of the texts of these numbers is the same.
EQUAL = (553, 43470)


@pytest.fixture(scope="module")
def texts(spark):
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda j: F.hex(F.xxhash64("id", j))), " ")
    rows = spark.range(50_000).where(F.col("id").isin(*EQUAL)).select(text.alias("t"), F.hash(text).alias("h")).collect()
    assert len({r.h for r in rows}) == 1 and len({r.t for r in rows}) == 2
    return [r.t for r in rows]


@pytest.mark.parametrize("copies", [1, 2])
def test_no_text_vanishes(spark, texts, copies):
    docs = spark.createDataFrame([(None, t) for t in texts * copies], "doc_id long, text string").repartition(2)
    assert sorted(r.text for r in jaccard.first_of_each(docs).collect()) == sorted(texts)


def test_spans_go_to_their_own_text(spark, texts):
    docs = spark.createDataFrame([(1, texts[1]), (None, texts[0]), (None, texts[1])], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id or 0, r.n_removed, r.kept) for r in substring_dedup.deduplicated(docs).collect())
    assert got == sorted([(1, 0, texts[1]), (0, 0, texts[0]), (0, 30, "")])
