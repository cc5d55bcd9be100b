"""Faults found by probing: clashing names, capitals in rules, references, samples."""

from __future__ import annotations

import gzip
import re

import numpy as np
from pyspark.sql import functions as F

from ledgerlark.llm import decontamination, language_id, quality, url_filters, warc

from .conftest import prose


def test_leaks_with_columns_named_like_its_own(spark):
    item = prose(1, 40)
    schema = "_id long, text string, _hash int, leak_id int, leak_hash string, doc_id int"
    docs = spark.createDataFrame([(1, item, 1, 2, "a", 3), (2, prose(2, 50), 1, 2, "b", 3), (None, prose(3, 9) + " " + item, 0, 0, "c", 0)], schema)
    left = decontamination.without_leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string"), key="_id")
    assert left.columns == docs.columns and [r["_id"] for r in left.collect()] == [2]


def test_rules_with_capitals(spark):
    pages = spark.createDataFrame([(1, "http://Example.com/newsDE/1"), (2, "http://example.com/newsde/1"), (3, "http://m.example.com/newsDE/")], "page_id long, url string")
    rules = [url_filters.host_rule("block", "Example.COM/newsDE/")]
    verdicts = lambda given: {r.page_id: r.filter.verdict for r in url_filters.judged(pages, rules=given).collect()}
    assert verdicts(rules) == {1: "block", 2: "allow", 3: "block"}
    table = spark.createDataFrame([(r.name, r.verdict, r.pattern, [t.upper() for t in r.tokens], r.priority) for r in rules], "name string, verdict string, pattern string, tokens array<string>, priority int")
    assert verdicts(table) == verdicts(rules)


def test_revisits_refer_to_records_that_exist(spark, tmp_path):
    rows = [(1, "u", "x" * 50_000), (2, "u", "x" * 50_000), (3, "v", "y"), (4, "v", "y"), (4, "v", "y"), (5, "w", ""), (6, None, None), (1, "u", "x" * 50_000)]
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("part-*")).decode()
    heads = [h for h in re.findall(r"WARC/1\.1\r\n(.*?)\r\n\r\n", data, re.S)]
    responses = {re.search("WARC-Record-ID: (.*)", h)[1].strip() for h in heads if "WARC-Type: response" in h}
    revisits = [h for h in heads if "WARC-Type: revisit" in h]
    assert len(revisits) == 4 and all(f"WARC-Profile: {warc.PROFILE}" in h for h in revisits)
    assert {re.search("WARC-Refers-To: (.*)", h)[1].strip() for h in revisits} <= responses
    got = warc.read_pages(spark, str(tmp_path / "w"))
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got.collect()) == sorted(
        [(1, 50_000, "response", 0)] * 2 + [(2, 50_000, "revisit", 1), (3, 1, "response", 0), (4, 1, "revisit", 3), (4, 1, "revisit", 3), (5, 0, "response", 0), (6, 0, "revisit", 5)]
    )


def _letters(seed: int, alphabet: str, n: int = 40) -> str:
    draw = np.random.default_rng(seed)
    return " ".join("".join(draw.choice(list(alphabet), 5)) for _ in range(n))


def test_repeated_rows_do_not_push_languages_out(spark):
    learned = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 3 != 1]
    rows = [(learned[0], _letters(0, "abcde"), "a")] * 3000
    rows += [(i, _letters(i, ("abcde", "fghij", "klmno")[i % 3]), "abc"[i % 3]) for i in learned[1:200]]
    rows += [(learned[-1], _letters(k, "pqrst"), "d") for k in range(500)]  # one id, many texts
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sample = language_id.labelled_sample(docs, "doc_id", "text", "lang").groupBy("lang").agg(F.count("*"), F.count_distinct("text")).collect()
    assert {r[0]: r[1] for r in sample}.keys() == {"a", "b", "c", "d"}
    assert all(r[1] == r[2] <= language_id.SAMPLE for r in sample)
    model = language_id.fit(docs)
    assert model.languages == ["a", "b", "c", "d"]


def test_many_languages_are_all_learned(spark):
    learned = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 3 != 1]
    rows = [(i, chr(0x4E00 + 7 * (at % 90)) * 30, f"l{at % 90:02}") for at, i in enumerate(learned[:180])]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 90


def test_predictions_equal_plain_cosines(spark):
    """The same model, one text at a time."""
    rows = [(i, _letters(i, ("abcde", "cdefg", "klmno")[i % 3], 3 + i % 30), "xyz"[i % 3]) for i in range(150)] + [(500, "12 !", None), (501, None, None), (None, "abc", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    for r in language_id.identified(docs, model).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id)
        raw = language_id.counts(text)
        if raw is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        own = raw * model.idf / np.linalg.norm(raw * model.idf)
        cosines = [float(own @ c) for c in model.centroids]
        assert r.lang_pred == model.languages[model.owners[int(np.argmax(cosines))]] and abs(r.score - max(cosines)) < 1e-4


def test_short_menus_are_rejected_and_short_plain_texts_stay(spark):
    """The word bound reaches down to 50 words and rises as words get fewer."""
    draw = np.random.default_rng(1)
    common, other = quality.COMMON_WORDS["en"], [f"word{i}" for i in range(400)]
    plain = lambda n: " ".join(str(draw.choice(common)) if draw.random() < 0.4 else str(draw.choice(other)) for _ in range(n))
    menu = lambda n: " ".join(f"item{int(draw.integers(10**6))}" for _ in range(n))
    rows = [(i, plain(40 + 3 * i), "en") for i in range(150)] + [(1000 + i, menu(120 + i), "en") for i in range(20)]
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).select("doc_id", "quality.*").collect()
    assert {r.doc_id for r in got if not r.kept} == {r.doc_id for r in got if r.base_failed or r.doc_id >= 1000}
    assert all((r.word_distance is None) == (r.n_words < quality.MIN_WORDS) for r in got)
