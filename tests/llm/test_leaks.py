"""Copies of benchmark items that are edited, moved or written in another way."""

from __future__ import annotations

from ledgerlark.llm import decontamination

from .conftest import prose

ITEM = (
    "Anna and Bernd walk to the shop where Anna buys a loaf of bread and some cheese within 30 minutes of time"
    " and then they both walk home again which takes them another 20 minutes of time before they eat"
)
ROLES = "a teacher has 3 boxes of 3 pens each and gives 5 of them away to the pupils of the class"
MANY = "7 of 7 pens and 7 of 9 cups cost 12 euros or 14 dollars in 5 of 6 shops"


def found(spark, items: dict, texts: dict) -> set:
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{prose(i, 40)}. {t}. {prose(1000 + i, 40)}") for i, t in texts.items()], "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, benchmark).collect()}


def test_edited_slots(spark):
    """A changed slot does not undo what the other words prove."""
    texts = {
        1: ITEM.replace("where Anna", "where Carla"),
        2: ITEM.replace("30 minutes", "30 min"),
        3: ROLES.replace("3 boxes of 3", "4 boxes of 6"),
        4: ROLES.replace("3 boxes", "4 boxes").replace("of 3", "of 4").replace("gives 5", "gives 4"),
        5: MANY.replace("7 of 7", "8 of 2"),
        6: "2 of 3 pens and 4 of 4 cups cost 5 euros or 5 euros in 5 of 5 shops",
    }
    got = found(spark, {1: ITEM, 2: ROLES, 3: MANY}, texts)
    assert got == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)}


def test_inserted_words(spark):
    """Parts of an item on several diagonals, values of another length, half of a long item."""
    words = prose(505, 40).split()
    long = prose(506, 59)
    short = "Our friend Anna had 25 of them left"
    texts = {
        1: " ".join([*words[:20], "added", *words[20:]]),
        2: " ".join([*words[:20], *words[22:]]),
        3: "Our friend Mary Ann had twenty five of them left",
        4: " ".join(long.split()[:30]),
        5: " ".join([*words[30:], *words[:12]]),
        6: " ".join(words[:10]) + " " + prose(577, 90) + " " + " ".join(words[20:35]),
        7: ITEM.replace("within 30 minutes", "within thirty five minutes"),
    }
    assert found(spark, {1: " ".join(words), 2: long, 3: short, 4: ITEM}, texts) == {(1, 1), (2, 1), (3, 3), (4, 2), (7, 4)}


def test_runs_of_numbers_are_no_copy(spark):
    """An item that is one run of numbers is not found in any text with a number."""
    assert found(spark, {1: " ".join(map(str, range(12, 30)))}, {1: "there were 7 of them", 2: " ".join(map(str, range(12, 30)))}) == {(2, 1)}


def test_case_and_line_breaks(spark):
    """A copy is found after a heading or list mark, and in another case."""
    benchmark = spark.createDataFrame([(1, "Which river runs through Vienna and Budapest"), (2, ITEM)], "item_id long, text string")
    short, near = "Which river runs through Vienna and Budapest", ITEM.replace("Anna", "Carla").replace("Bernd", "Dora")
    texts = [
        (1, f"a heading {short} and so on"), (2, f"a heading\n{short}\nand so on"), (3, f"- {short}"), (4, short.upper()), (5, short.title()), (6, short.lower()),
        (7, ITEM.upper()), (8, f"a heading\n{near}"), (9, f"so {near}".replace(" Carla", "\nCarla")), (10, "the river runs through a town"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, benchmark).collect()}
    assert got == {*((i, 1) for i in range(1, 7)), (7, 2), (8, 2), (9, 2)}
