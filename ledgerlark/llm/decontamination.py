"""Benchmark decontamination by templates.

Numbers, units and names become typed placeholders, so that a re-parameterised question
has the template of the original. Windows of template words of all texts meet those of
the benchmark in a hash join; matches of one document and item that lie near each other
and in order form an alignment, also if words were inserted or left out between them.
Every text is read with names as slots and without, all words in lower case, so that a
copy in another case or after a heading is found; a hit in any reading counts.
Runs of placeholders of one kind are also read as one, for values of several words, in
items where at least half of a window's words stay literal. An alignment counts if it
covers ``min_coverage`` of the item, or ``MIN_SAME`` unchanged words, and its slots fit:

- one value of the item always stands for one value of the text, and the other way round;
- or at most half of the slots changed, and the unchanged words alone cover enough;
- or most names keep one value, and so do most numbers and units. The latter may take any
  values if the words that are no slots cover enough, as two roles of an item may share one.

Texts stay where they are. A task keeps the windows whose hash the benchmark has, which
it learns from blocks of at most ``BLOCK`` distinct hashes; a larger benchmark takes more
blocks, each one pass over the documents. Only hits are shuffled, and alignments are
grouped per document and item, so a passage that many documents share stays spread.

Defined cases: null and blank texts have no windows; an item shorter than a window is one
window of its length; an item without words matches nothing; equal items are both
reported. Documents are known by id and text together, so rows with a null or repeated id
are judged each by its own text. Other columns stay, whatever their names are.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small, stored
from .hashing import windows, word_hash

WINDOW = 10
MIN_COVERAGE = 0.6
# Unchanged words that are enough in an item of any length.
MIN_SAME = 20
BLOCK = 500_000
_TABLE_BITS = 22
# Distinct words that a worker remembers; beyond it, it starts anew.
MAX_WORDS = 500_000
# Units of measure and number words.
UNITS = frozenset(
    "% cm dollar dollars euro euros feet foot ft g gram grams h hour hours inch inches kg kilometer kilometers km l lb"
    " liter liters m meter meters mi mile miles min minute minutes ml mm pound pounds s second seconds week weeks year years".split()
)
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    " eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*\d?%?|[+-]?[$€£]?\d")
_EDGE = ".,;:!?\"'()[]{}«»“”‘’"
_HITS = "doc_id long, text_hash long, h long, doc_at long, doc_end long, doc_slots array<string>"
_LEAKS = ["doc_id", "text_hash", "item_id", "covered", "item_words", "n_slots", "n_changed"]
NUMBER, UNIT, NAME = (word_hash(b"<" + k + b">") & ~7 for k in (b"number", b"unit", b"name"))


class TemplateHashes(dict):
    """Word (bytes) to the hash of its template; bit 0: capitalised, bit 1: ends a
    sentence, bit 2: slot. Bytes split at exactly the blanks ``[\\x20\\x09-\\x0D]``."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = self.hash(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MAX_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))

    def hash(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        core = text.strip(_EDGE)
        ends = 2 * (text.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":"))
        low = core.lower()
        if _NUMBER.fullmatch(core) or low in NUMBER_WORDS:
            return NUMBER | 4 | ends
        if low in UNITS:
            return UNIT | 4 | ends
        return (word_hash(low.encode()) & ~7) | ends | (core[:1].isupper() and core[:1].isalpha())


def split(body: str) -> tuple[list[bytes], np.ndarray]:
    """Words, and which of them begin a line."""
    words, begins = [], []
    for line in body.encode().splitlines():
        begins.append(len(words))
        words += line.split()
    first = np.zeros(len(words) + 1, dtype=bool)
    first[begins] = True
    return words, first[: len(words)]


def templates(words: list[bytes], lines: np.ndarray, known: TemplateHashes) -> list[tuple[np.ndarray, np.ndarray]]:
    """Template hash of each word, and whether it is a slot, in up to three readings. A
    capitalised word is a name unless it begins the text or a sentence; unless it begins
    a line either; or never, so that letter case and what stands before do not matter."""
    raw = known.of(words)
    starts = np.ones(len(raw), dtype=bool)
    starts[1:] = (raw[:-1] & np.uint64(2)) > 0
    fixed = (raw & np.uint64(4)) > 0
    names = ((raw & np.uint64(1)) > 0) & ~starts & ~fixed
    masks = [names]
    if (names & lines).any():
        masks.append(names & ~lines)
    if masks[-1].any():
        masks.append(np.zeros(len(raw), dtype=bool))
    return [(np.where(m, np.uint64(NAME), raw & ~np.uint64(7)), m | fixed) for m in masks]


def readings(hashes: np.ndarray, slots: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(hashes, slots, places)`` of the units of a text, word by word and, if it has runs
    of placeholders of one kind, with each run as one unit. ``places`` ends with the number of words."""
    out = [(hashes, slots, np.arange(len(hashes) + 1))]
    first = np.append(True, ~(slots[1:] & slots[:-1] & (hashes[1:] == hashes[:-1])))[: len(hashes)]
    if not first.all():
        out.append((hashes[first], slots[first], np.append(np.flatnonzero(first), len(hashes))))
    return out


def _value(words: list[bytes], at: int, end: int) -> str:
    return " ".join(w.decode("utf-8", "replace").strip(_EDGE).lower() for w in words[at:end])


def _slots(words: list[bytes], slots: np.ndarray, places: np.ndarray, at: int, width: int) -> list[tuple[int, int, int, str]]:
    """Unit, begin, end and value of each slot of a window."""
    found = (at + np.flatnonzero(slots[at : at + width])).tolist()
    return [(u, int(places[u]), int(places[u + 1]), _value(words, places[u], places[u + 1])) for u in found]


def item_windows(benchmark: DataFrame, item: str, text: str, width: int = WINDOW) -> DataFrame:
    """``(h, width, item_id, item_at, item_end, item_words, item_slots)`` of all items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = TemplateHashes()
        for batch in batches:
            out = {}
            for item_id, body in zip(batch["item_id"], batch["text"]):
                words, lines = split(body or "")
                if not words:
                    continue
                for hashes, slots, places in (r for t in templates(words, lines, known) for r in readings(*t)):
                    size, folded = min(width, len(hashes)), len(hashes) < len(words)
                    for at, h in enumerate(windows(hashes, size, size).view(np.int64)):
                        if folded and 2 * int(slots[at : at + size].sum()) > size:
                            continue
                        own = [f"{begin} {end} {'a' if int(hashes[u]) == NAME else 'n'} {v}" for u, begin, end, v in _slots(words, slots, places, at, size)]
                        out[item_id, len(words), h, places[at], places[at + size], *own] = (h, size, item_id, places[at], places[at + size], len(words), own)
            yield pd.DataFrame(list(out.values()), columns=["h", "width", "item_id", "item_at", "item_end", "item_words", "item_slots"])

    rows = benchmark.select(F.col(f"`{item}`").cast("long").alias("item_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    return rows.mapInPandas(run, "h long, width int, item_id long, item_at int, item_end int, item_words int, item_slots array<string>")


def _hits(docs: DataFrame, hashes: np.ndarray, widths: list[int]) -> DataFrame:
    """Windows of ``docs (doc_id, text, text_hash)`` whose hash is among ``hashes``."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(hashes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, wanted = TemplateHashes(), shared.value
        mask = np.uint64((1 << _TABLE_BITS) - 1)
        seen = np.zeros(1 << _TABLE_BITS, dtype=bool)
        seen[(wanted & mask).astype(np.int64)] = True
        for batch in batches:
            out = []
            for i, body in enumerate(batch["text"]):
                words, lines = split(body or "")
                if not words:
                    continue
                done = set()
                for hashed, slots, places in (r for t in templates(words, lines, known) for r in readings(*t)):
                    for width in widths:
                        own = windows(hashed, width, width)
                        at = np.flatnonzero(seen[(own & mask).astype(np.int64)])
                        found = np.searchsorted(wanted, own[at])
                        at = at[(found < len(wanted)) & (wanted[np.minimum(found, len(wanted) - 1)] == own[at])]
                        for u in at.tolist():
                            hit = (int(places[u]), own[u], int(places[u + width]))
                            if hit not in done:
                                done.add(hit)
                                out.append((i, *hit, [v for *_, v in _slots(words, slots, places, u, width)]))
            rows = [r[0] for r in out]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].iloc[rows].array,
                    "text_hash": batch["text_hash"].iloc[rows].array,
                    "h": np.array([r[2] for r in out], dtype=np.uint64).view(np.int64),
                    "doc_at": np.array([r[1] for r in out], dtype=np.int64),
                    "doc_end": np.array([r[3] for r in out], dtype=np.int64),
                    "doc_slots": pd.Series([r[4] for r in out], dtype=object),
                }
            )

    return docs.mapInPandas(run, _HITS)


def _kept(pairs: list[tuple[str, str]]) -> int:
    """How many of the pairs a one-to-one mapping of values keeps, the most frequent first."""
    left, right, kept = set(), set(), 0
    for (i, d), n in sorted(Counter(pairs).items(), key=lambda p: (-p[1], p[0])):
        if i not in left and d not in right:
            left.add(i)
            right.add(d)
            kept += n
    return kept


def _fitting(covered: int, item_words: int, slots: list[tuple[int, int, str, str, str]], min_coverage: float) -> bool:
    """Whether an alignment of ``covered`` words with ``slots``, each ``(begin, end, kind,
    value of the item, value of the text)``, is a copy of the item."""
    places = lambda some: len({p for begin, end, *_ in some for p in range(begin, end)})
    changed = [s for s in slots if s[3] != s[4]]
    enough = min(min_coverage * item_words, MIN_SAME)
    if covered < min_coverage * item_words and covered - places(changed) < MIN_SAME:
        return False
    by_kind = {k: [(i, d) for _, _, kind, i, d in slots if kind == k] for k in "an"}
    pairs = {(i, d) for _, _, _, i, d in slots}
    if len({i for i, _ in pairs}) == len(pairs) == len({d for _, d in pairs}):
        return True
    if 2 * len(changed) <= len(slots) and covered - places(changed) >= enough:
        return True
    most = {k: not v or 2 * _kept(v) > len(v) for k, v in by_kind.items()}
    return most["a"] and (most["n"] or covered - places(slots) >= enough)


def _union(spans: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _pieces(hits: list[tuple]) -> list[list]:
    """``[doc_at, doc_end, item_at, item_end, hits]``: hits of one diagonal that touch, as one."""
    pieces, last = [], {}
    for hit in sorted(hits):
        piece = last.get(hit[0] - hit[2])
        if piece and hit[0] <= piece[1] and hit[2] <= piece[3]:
            piece[1], piece[3] = max(piece[1], hit[1]), max(piece[3], hit[3])
            piece[4].append(hit)
        else:
            pieces.append([*hit[:4], [hit]])
            last[hit[0] - hit[2]] = pieces[-1]
    return pieces


def _chains(hits: list[tuple], item_words: int) -> Iterator[tuple[int, list[tuple]]]:
    """Covered words and hits of pieces in order in both texts, each with the best chain
    before it. Between two pieces the text may skip as many words as the item has. A word
    of either text counts once."""
    pieces = _pieces(hits)
    totals, before, first = [], [], 0
    for j, (at, end, item_at, item_end, _) in enumerate(pieces):
        while pieces[first][0] + 3 * item_words < at:  # a piece has at most twice the item's words
            first += 1
        total, link = item_end - item_at, None
        for i in range(first, j):
            p = pieces[i]
            if p[2] <= item_at and p[1] < end and p[3] < item_end and at - p[1] <= item_words:
                more = totals[i] + min(item_end - max(item_at, p[3]), end - max(at, p[1]))
                if more > total:
                    total, link = more, i
        totals.append(total)
        before.append(link)
    for j in sorted(range(len(pieces)), key=lambda j: -totals[j]):
        own, i = [], j
        while i is not None:
            own += pieces[i][4]
            i = before[i]
        yield totals[j], own


def _best(hits: list[tuple], item_words: int, min_coverage: float) -> tuple[int, int, int] | None:
    """``(covered, -n_changed, n_slots)`` of the best alignment of one document and item.
    A hit is ``(doc_at, doc_end, item_at, item_end, slots)``."""
    best, enough = None, min(min_coverage * item_words, MIN_SAME)
    diagonals = defaultdict(list)
    for hit in hits:
        diagonals[hit[0] - hit[2]].append(hit)

    def judge(covered: int, own: list[tuple]) -> None:
        nonlocal best
        slots = sorted({s for h in own for s in h[4]})
        if _fitting(covered, item_words, slots, min_coverage):
            pairs = {s[3:] for s in slots}
            found = (covered, -sum(i != d for i, d in pairs), len(pairs))
            best = found if best is None else max(best, found)

    for own in diagonals.values():
        covered = _union([(h[2], h[3]) for h in own])
        if covered >= enough:
            judge(covered, own)
    if len(diagonals) > 1:
        for covered, own in _chains(hits, item_words):
            if covered < enough or best and covered < best[0]:
                break
            judge(covered, own)
    return best


def _alignments(min_coverage: float):
    def slots(item: list[str], doc: list[str]) -> tuple:
        split = (s.split(" ", 3) for s in item)
        return tuple((int(a), int(b), kind, i, d) for (a, b, kind, i), d in zip(split, doc))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by document and item."""

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out = []
        for key, group in groupby(rows(), key=lambda r: r[:4]):
            found = _best(list({(*r[4:8], slots(r[8], r[9])) for r in group}), key[3], min_coverage)
            if found:
                out.append((*key[:3], found[0], key[3], found[2], -found[1]))
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int32()] * 4
    columns = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_LEAKS)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """One row per document and benchmark item it contains: ``doc_id, text_hash, item_id,
    covered, item_words, n_slots, n_changed`` of the best alignment. Slots whose value
    differs from the item's count as changed."""
    spark = docs.sparkSession
    items = stored(item_windows(benchmark, item, item_text, width), "items")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.where(F.col("text").isNotNull()).withColumn("text_hash", F.xxhash64("text"))
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # width numbers at most
    n = items.select("h").distinct().count()
    blocks = -(-n // BLOCK)
    hits = None
    for b in range(blocks):
        own = items.where(F.pmod("h", F.lit(blocks)) == b).select("h").distinct()
        hashes = np.array([r[0] for r in own.toLocalIterator()], dtype=np.int64).view(np.uint64)
        found = _hits(rows, hashes, widths)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], _HITS)
    pairs = hits.join(small(items), "h")
    keys = ("doc_id", "text_hash", "item_id")
    pairs = pairs.select(*keys, "item_words", "doc_at", "doc_end", "item_at", "item_end", "item_slots", "doc_slots")
    kinds = "doc_id long, text_hash long, item_id long, covered int, item_words int, n_slots int, n_changed int"
    return pairs.repartition(*keys).sortWithinPartitions(*keys, "item_words").mapInArrow(_alignments(min_coverage), kinds)


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` that contain no benchmark item."""
    names = [free_name(docs.columns, n) for n in ("leak_id", "leak_hash")]
    found = leaks(docs, benchmark, key, text, **options).select(F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1])).distinct()
    dirty = small(stored(found, "leaks"))
    same = F.col(f"`{key}`").cast("long").eqNullSafe(F.col(names[0])) & (F.xxhash64(F.col(f"`{text}`")) == F.col(names[1]))
    return docs.join(dirty, same, "left_anti")
