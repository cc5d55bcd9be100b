"""Decontamination, language identification and token files against plain Python."""

from __future__ import annotations

import random
import zlib
from binascii import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import decontamination, language_id, token_files

from .conftest import EXTRA, SCHEMA, odd_rows, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

ITEM = "Today Anna buys 12 apples and 7 pears for 30 euros at the market before Anna walks 3 km home with the fruit"
OTHER = "Today Bernd buys 15 apples and 9 pears for 44 dollars at the market before Bernd walks 8 miles home with the fruit"
MIXED = "Today Bernd buys 15 apples and 9 pears for 44 dollars at the market before Carla walks 8 miles home with the fruit"


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, ITEM), (2, prose(7, 25)), (3, None), (4, ""), (5, prose(9, 4)), (None, prose(1, 30)), (6, prose(7, 25))]
    return spark.createDataFrame(items, "item_id long, text string")


def test_leaks(spark, benchmark):
    own = prose(50, 60)
    texts = [
        (1, f"{own} {ITEM} {own}"), (2, f"{own} and then {OTHER}. {own}"), (3, f"so {MIXED}"), (4, f"{own} {prose(7, 25)} {own}"),
        (5, prose(9, 4)), (6, own), (7, None), (8, ""), (9, " ".join(ITEM.split()[:11]) + " " + own), (9, f"{ITEM} {own}"), (None, ITEM), (None, own),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", None, *EXTRA) for i, t in texts], SCHEMA).repartition(3)
    found = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, benchmark).collect()}
    # 2 changes all slots of the item consistently; 3 gives one name of the item two values.
    assert set(found) == {(1, 1), (2, 1), (4, 2), (4, 6), (5, 5), (9, 1), (None, 1)}
    assert found[1, 1].n_changed == 0 and found[2, 1].n_changed > 3
    kept = decontamination.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    half = " ".join(ITEM.split()[:11])
    want = [(i or 0, t or "") for i, t in texts if i in (3, 6, 7, 8) or t in (own, f"{half} {own}")]
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(want)


def test_leaks_by_blocks(spark, benchmark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{prose(300 + i, 40)} {ITEM if i % 3 else ''} {prose(600 + i, 9)}") for i in range(30)], "doc_id long, text string")
    once = {tuple(r) for r in decontamination.leaks(docs, benchmark).collect()}
    monkeypatch.setattr(decontamination, "BLOCK", 9)
    assert {tuple(r) for r in decontamination.leaks(docs, benchmark).collect()} == once and len(once) == 20


def test_verbatim_items_are_found(spark):
    """As by looking for every item's words in every text."""
    draw = random.Random(4)
    items = [(i, prose(900 + i, draw.randint(3, 60))) for i in range(25)]
    texts = []
    for i in range(80):
        words = prose(i, 100).split()
        if i % 2:
            words[40:40] = items[i % 25][1].split()
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, j) for i, t in texts for j, item in items if f" {item} " in f" {t} "}


LANGUAGES = {"x": "abcdef", "y": "efghij", "z": "klmnoé"}


def speech(seed: int, letters: str) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 7))) for _ in range(40))


def test_languages(spark):
    rows = [(i, speech(i, LANGUAGES[lang]), lang, "s", None, *EXTRA) for i in range(240) for lang in [list(LANGUAGES)[i % 3]]]
    rows += [(1000, None, "x", "s", None, *EXTRA), (1001, "12 34 !", "x", "s", None, *EXTRA), (1002, "", None, "s", None, *EXTRA)]
    rows += [(None, speech(7, "abcdef"), "z", "s", None, *EXTRA), (1003, "ЖЩЯЮЪ ЖЩЯЮЪ", None, "s", None, *EXTRA)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = language_id.fit(docs)
    assert model.languages == ["x", "y", "z"] and len(model.centroids) <= 3 * language_id.CENTROIDS
    got = {r.doc_id: r for r in language_id.identified(docs, model).collect()}
    assert len(got) == len(rows)
    for i in range(240):
        assert got[i].held_out == (crc32(str(i).encode()) % 3 == 1)
        assert 0 <= got[i].score <= 1
    held = [i for i in range(240) if got[i].held_out]
    assert sum(got[i].lang_pred == list(LANGUAGES)[i % 3] for i in held) >= 0.98 * len(held) > 50
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and not got[None].held_out
    assert got[None].lang_pred == "x" and got[1003].rejected


def test_language_is_learned_from_the_sample_only(spark):
    """Labels of held-out rows change nothing."""
    rows = [(i, speech(i, LANGUAGES[lang]), lang) for i in range(90) for lang in [list(LANGUAGES)[i % 3]]]
    lied = [(i, t, "q" if crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    models = [language_id.fit(spark.createDataFrame(r, "doc_id long, text string, lang string")) for r in (rows, lied)]
    assert models[0].languages == models[1].languages
    assert np.array_equal(models[0].centroids, models[1].centroids)


def test_no_language(spark, empty):
    assert language_id.fit(empty) is None
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language_id.identified(docs, language_id.fit(docs)).collect()] == [(1, False, "und", 0.0, True)]


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_pieces_equal_the_library():
    draw, encoder = random.Random(5), token_files.Encoder(PATH)
    signs = list("ab Zé  ß\n\t.,'s't!?1 2９Ⅷ \u3000\x1c\x85́한字😀-_#$<|>")
    signs += [" ", " ", "\n", "nt", "don't", "'re", "<|endoftext|>", " the "]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    ids, sizes = encoder.encode(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert own.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files(spark, odd, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(odd, path, PATH)
    stored = token_files.read_tokens(spark, path)
    assert stored.columns == ["doc_id", "start", "n_tokens", "tokens"]
    rows = stored.orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r[0] for r in odd_rows()), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.tokens))
        at += r.n_tokens
    want = sorted((r[0] or -1, library(r[1])) for r in odd_rows())
    assert sorted((r.doc_id or -1, r.tokens) for r in rows) == want
    sums = {(r.start, r.ids_crc32) for r in token_files.with_checksums(stored).collect()}
    assert sums == {(r.start, zlib.crc32(np.array(r.tokens, dtype="<u4").tobytes())) for r in rows}


def test_token_file_layout(spark, odd, tmp_path):
    """Delta and dictionary encodings, page indexes, and reads of chosen columns only."""
    pq = pytest.importorskip("pyarrow.parquet")
    token_files.write_tokens(odd, str(tmp_path / "t"), PATH)
    file = max((tmp_path / "t").glob("*.parquet"), key=lambda f: f.stat().st_size)
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings)
    assert all(c.has_offset_index for c in columns.values())
    plan = token_files.read_tokens(spark, str(tmp_path / "t")).select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_empty_tables(spark, empty, benchmark, tmp_path):
    assert decontamination.leaks(empty, benchmark).count() == 0
    assert decontamination.leaks(empty, benchmark.limit(0)).count() == 0
    assert decontamination.without_leaks(empty, benchmark).count() == 0
    assert decontamination.without_leaks(spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), benchmark.limit(0)).count() == 1
    assert language_id.identified(empty, None).count() == 0
    token_files.write_tokens(empty, str(tmp_path / "none"), PATH)
    assert token_files.with_checksums(token_files.read_tokens(spark, str(tmp_path / "none"))).count() == 0
