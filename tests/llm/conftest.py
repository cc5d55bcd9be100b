from __future__ import annotations

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "id string, th int, `_row` int, quality string, mix int, node int, token string, n int, text_hash string, `own_id` int, size int"
)
EXTRA = ("x", 1, 2, "y", 3, 4, "z", 5, "w", 6, 7)


def words(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 6))) for _ in range(n)]


def prose(seed: int, n: int) -> str:
    return " ".join(words(seed, n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, copies, repeated rows and repeated ids."""
    near = words(7, 120)
    near[60] = "changed"
    long = prose(11, 30_000)
    texts = [
        (1, prose(7, 120), "en", "a"), (2, " ".join(near), "en", "a"), (3, None, "en", None), (None, prose(3, 80), None, "b"),
        (None, prose(4, 80), "xx", "b"), (4, "", "de", "b"), (5, " \n\t ", "fr", "c"), (6, "one two", "es", "c"), (7, "one two", "es", None),
        (8, long, "en", "a"), (9, long + " tail", "en", "a"), (10, prose(5, 60), "en", "d"), (10, prose(5, 60), "en", "d"),
        (11, prose(6, 60), "en", "d"), (11, prose(8, 60), "en", "d"), (12, prose(5, 60).upper(), "en", "d"),
        (13, prose(9, 30) + " " + prose(7, 40) + "\n" + prose(12, 30), "fr", "d"), (14, "12345 67 !!! ...", None, "é"),
        (15, " ".join(["again and again"] * 40), "en", "Z"), (None, None, None, None),
    ]
    return [(i, t, lang, source, None, *EXTRA) for i, t, lang, source in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
