"""Alignment of two tokenizers against both libraries on whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlark.llm import token_alignment
from ledgerlark.llm.queries import PIECES, tokenizer_path

from .conftest import odd_rows, prose


@pytest.fixture(scope="module")
def tools():
    return token_alignment.Tokenizers(tokenizer_path(), tokenizer_path(PIECES))


def whole(tools, text: str | None):
    """Ids and byte ends of both, from whole texts; None without tokens."""
    if not text:
        return None
    a = tools.a.encode(" " + text, add_special_tokens=False).ids
    b = tools.b.encode(text)
    wanted = (" " + text).encode()
    if b"".join(tools.bytes_a[i] for i in a) != wanted or b"".join(tools.bytes_b[i] for i in b) != wanted:
        return None
    ends = lambda ids, table: np.cumsum([len(table[i]) for i in ids]).tolist()
    return a, b, ends(a, tools.bytes_a), ends(b, tools.bytes_b)


def brute(tools, texts: list[str | None]) -> list[tuple]:
    """``(n_a, n_b, n_groups, n_links, sha, n_best, count_sum)`` of each text."""
    shapes, links = [], []
    for text in texts:
        found = whole(tools, text)
        if found is None:
            shapes.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        a, b, ends_a, ends_b = found
        cuts = sorted(set(ends_a) & set(ends_b))
        parts, left_a, left_b = [], list(zip(a, ends_a))[::-1], list(zip(b, ends_b))[::-1]
        for cut in cuts:
            taken = [[], []]
            for side, left in zip(taken, (left_a, left_b)):
                while left and left[-1][1] <= cut:
                    side.append(str(left.pop()[0]))
            parts.append("|".join(map(",".join, taken)))
        own, j = [], 0
        for i, (x, end) in enumerate(zip(a, ends_a)):
            begin = ends_a[i - 1] if i else 0
            while ends_b[j] <= begin:
                j += 1  # never goes back
            k = j
            while k < len(b) and (ends_b[k - 1] if k else 0) < end:
                own.append((x, b[k]))
                k += 1
        links.append(own)
        shapes.append((len(a), len(b), len(cuts), len(own), hashlib.sha256(";".join(parts).encode()).hexdigest()))
    counts = Counter(pair for own in links for pair in set(own))
    best: dict[int, int] = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return [(*shape, sum(counts[p] == best[p[0]] for p in own), sum(counts[p] for p in own)) for shape, own in zip(shapes, links)]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def strange(seed: int, n: int) -> str:
    draw = random.Random(seed)
    parts = ["word", "Straße", "naïve", "日本語", "😀", " ", "  ", "\n", "\t", " ", "　", "'s", "don't", "12345", "<|endoftext|>", "</s>", "<s>", "<unk>", "<0x0A>", "...", "é", "​", "a", "the", " the ", "\x1c", "\x00", "﻿", "\U0010ffff", "ﬁ", "é"]
    return "".join(draw.choice(parts) for _ in range(n))


def sample() -> list[str | None]:
    texts = [strange(seed, seed % 40) for seed in range(300)]
    texts += [prose(s, 30).replace(" ", draw) for s in range(10) for draw in (" ", "  ", "\n", " \n")]
    texts += [" lead", "trail ", " ", "\n", "a", "x ▁ y", "▁", "the the the", "the the the", None, "", "z" * 5000, prose(5, 20_000)]
    return texts


@pytest.mark.parametrize("block", [1, 3000, 4_000_000])
def test_rows_equal_whole_texts(spark, tools, block):
    texts = sample()
    df = spark.createDataFrame([(i // 2, t, "x", 1) for i, t in enumerate(texts)], "doc_id int, text string, block string, n_a int").repartition(3)
    got = token_alignment.aligned(df, tokenizer_path(), tokenizer_path(PIECES), block_bytes=block)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    wanted = sorted((i // 2, *row) for i, row in enumerate(brute(tools, texts)))
    assert sorted(tuple(r) for r in got.select("doc_id", *NAMES).collect()) == wanted


def test_odd_rows_and_groups(spark, tools, odd):
    rows = odd_rows()
    got = token_alignment.aligned(odd, tokenizer_path(), tokenizer_path(PIECES), groups=True)
    wanted = [(str(r[0]), *w) for r, w in zip(rows, brute(tools, [r[1] for r in rows]))]
    found = got.collect()
    assert sorted((str(r.doc_id), *[r[c] for c in NAMES]) for r in found) == sorted(wanted)
    for r in found:
        assert (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256
        assert r.n_groups == (r.groups.count("|") if r.groups else 0)


def test_empty_table(spark, empty):
    assert token_alignment.aligned(empty, tokenizer_path(), tokenizer_path(PIECES)).count() == 0


def test_only_texts_without_tokens(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (2, "a▁b")], "doc_id long, text string")
    got = token_alignment.aligned(df, tokenizer_path(), tokenizer_path(PIECES)).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, "", 0, 0)} and len(got) == 3


def test_groups_are_the_common_ends():
    draw = random.Random(4)
    for _ in range(200):
        ends_a, ends_b, last_a, last_b, base = [], [], [], [], 0
        for _ in range(draw.randint(1, 4)):
            size = draw.randint(1, 60)
            for ends in (ends_a, ends_b):
                ends += sorted({base + size, *[base + draw.randint(1, size) for _ in range(draw.randint(0, 30))]})
            base += size
            last_a.append(len(ends_a))
            last_b.append(len(ends_b))
        a, b = (np.array(e) for e in (ends_a, ends_b))
        cut_a, cut_b = token_alignment.leaf_groups(a, b, np.array(last_a), np.array(last_b))
        common = np.intersect1d(a, b)
        assert a[cut_a - 1].tolist() == common.tolist() == b[cut_b - 1].tolist()


def test_forgotten_words_change_nothing(tools, monkeypatch):
    texts = pa.array([prose(s % 7, 50) for s in range(40)], pa.large_string())
    first = list(token_alignment.Block(tools, texts).texts())
    monkeypatch.setattr(token_alignment, "MAX_WORDS", 60)
    assert [next(token_alignment.Block(tools, texts.slice(i, 1)).texts()) for i in range(40)] == first
    assert len(tools.young) < 200
