"""Alignment of two tokenizers by divide and conquer at shared cuts.

Both tokenizers cover the bytes of a blank and the text. A byte offset where a token of
either ends is a cut. From the token in the middle of an interval, bisection in turn in either
list of ends finds the nearest common end to the right, or else to the left, and both halves
are treated alike. Intervals without a cut inside are the groups. The cuts to begin with are
those that are known without a search: neither tokenizer has a token that reaches across a
single blank or line break between two other characters. So words are tokenized, divided and
linked alone, once per worker, and remembered; all new words of a block are bisected together.

1. Tasks tokenize blocks of texts, find the groups, and link tokens whose bytes overlap. A
   block writes its documents, with places in the block's list of distinct id pairs, and that
   list once, with the number of its documents that hold each pair.
2. The lists are added up to the corpus-wide count of every pair, and the largest count of
   every A id is found; one A id has no more pairs than there are B ids.
3. Counts return to the blocks by a join on the pair, and meet the block's documents by a
   cogroup on the block. Whatever a pair's frequency, it is sent once per block.

Defined cases: null and empty texts, and texts that a tokenizer does not give back byte by
byte, have no tokens: zeros and an empty ``groups_sha256``; repeated rows are documents of
their own; null ids stay null; an empty table gives an empty result; long texts are blocks by
themselves. Names of other columns do not matter.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# Bytes of text of a block, and words that a worker remembers or learns at once.
BLOCK_BYTES = 4_000_000
MAX_WORDS = 200_000
AT_ONCE = 4096
_CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")
_INSIDE = _BLANKS.replace("\n", "")
_ODD = f"^[ \n]|[ \n]$|  |\n\n|\n[ {_INSIDE}]|[ {_INSIDE}]\n| [{_INSIDE}]|[{_INSIDE}] "
_PAIRS: dict[tuple[str, str], Tokenizers] = {}
# Numbers of A tokens, B tokens and groups; linked id pairs; groups as text.
Word = tuple[int, int, int, bytes, bytes]


def byte_level() -> dict[str, int]:
    """Bytes by the characters that byte-level vocabularies write them as: printable ones as
    themselves, the others in order from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + at): b for at, b in enumerate(rest)}


class Tokenizers:
    """A byte-level BPE file (A), a SentencePiece model (B), and words met before.

    A word that begins with a line break stands for itself, one that begins with a blank as
    well, and any other one for itself after a blank.
    """

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = byte_level()
        entries = sorted((i, t) for t, i in self.a.get_vocab(with_added_tokens=False).items())
        self.bytes_a: list[bytes] = [b""] * (entries[-1][0] + 1)
        for i, t in entries:
            self.bytes_a[i] = bytes(letters[c] for c in t)
        pieces = self.b.id_to_piece(list(range(self.b.get_piece_size())))
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("pieces of the model reach across blanks or line breaks")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(t) for t in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b)]
        # Decimal digits of every id and one of three signs, as eight bytes.
        self.shown = [np.array([[f"{i}{sign}" for sign in ",|;"] for i in range(len(side))], dtype="S8") for side in (self.bytes_a, self.bytes_b)]
        # Words used of late, and those used before them.
        self.young: dict[str, Word | None] = {}
        self.old: dict[str, Word | None] = {}

    def lookup(self, words: list[str]) -> list[Word | None]:
        """Words that a tokenizer does not give back byte by byte are None."""
        known = {w: self.old[w] for w in words if w not in self.young and w in self.old}
        new = [w for w in words if w not in self.young and w not in known]
        for at in range(0, len(new), AT_ONCE):
            some = new[at : at + AT_ONCE]
            known.update(zip(some, self._learned(some)))
        if len(self.young) + len(known) > MAX_WORDS // 2:
            self.old, self.young = self.young, {}
            out = [known[w] if w in known else self.old[w] for w in words]
            self.young.update(zip(words, out))
            return out
        self.young.update(known)
        return [self.young[w] for w in words]

    def _learned(self, words: list[str]) -> list[Word | None]:
        texts = [w if w[0] in " \n" else f" {w}" for w in words]
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # The model puts a blank in front by itself.
        found = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        ids_b = [ids if t[0] == " " else ids[1:] for t, ids in zip(texts, found)]
        wanted = [t.encode() for t in texts]
        ok = [b"".join([self.bytes_a[i] for i in a]) == w == b"".join([self.bytes_b[i] for i in b]) for a, b, w in zip(ids_a, ids_b, wanted)]
        sides = ([a for a, good in zip(ids_a, ok) if good], [b for b, good in zip(ids_b, ok) if good])
        aligned_words = iter(self._aligned(sides))
        return [next(aligned_words) if good else None for good in ok]

    def _aligned(self, sides: tuple[list[list[int]], list[list[int]]]) -> list[Word]:
        """Words from the ids of either tokenizer."""
        if not sides[0]:
            return []
        n = [np.array([len(i) for i in side], dtype=np.int64) for side in sides]
        ids = [np.fromiter(chain.from_iterable(side), dtype=np.int32, count=int(k.sum())) for side, k in zip(sides, n)]
        ends = [np.cumsum(size[i]) for size, i in zip(self.sizes, ids)]
        last = [np.cumsum(k) for k in n]
        cuts = leaf_groups(*ends, *last)
        groups = np.diff(np.searchsorted(cuts[0], last[0], side="right"), prepend=0)
        # Tokens in the order of the output: the A tokens of a group, then its B tokens.
        of = [np.searchsorted(cut, np.arange(len(i)), side="right") for cut, i in zip(cuts, ids)]
        signs = [np.zeros(len(i), dtype=np.int8) for i in ids]
        signs[0][cuts[0] - 1], signs[1][cuts[1] - 1] = 1, 2
        out = np.empty(len(ids[0]) + len(ids[1]), dtype="S8")
        out[np.arange(len(ids[0])) + np.append(0, cuts[1])[of[0]]] = self.shown[0][ids[0], signs[0]]
        out[np.arange(len(ids[1])) + cuts[0][of[1]]] = self.shown[1][ids[1], signs[1]]
        place = np.append(0, last[0] + last[1]).tolist()
        # Between two ends of either side lie one A token and one B token, which are linked.
        both = np.union1d(*ends)
        pairs = (ids[0][np.searchsorted(ends[0], both)].astype(np.int64) << 32) | ids[1][np.searchsorted(ends[1], both)]
        links = np.append(0, np.searchsorted(both, ends[0][last[0] - 1], side="right")).tolist()
        rows = zip(n[0].tolist(), n[1].tolist(), groups.tolist())
        return [
            (a, b, g, pairs[links[at] : links[at + 1]].tobytes(), out[place[at] : place[at + 1]].tobytes().translate(None, b"\0")[:-1])
            for at, (a, b, g) in enumerate(rows)
        ]


def _loaded(a: str, b: str) -> Tokenizers:
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = Tokenizers(a, b)
    return _PAIRS[a, b]


def leaf_groups(ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the groups, as rising numbers of tokens of A and of B.

    ``ends_a`` and ``ends_b`` are rising byte offsets; the intervals to begin with end before
    token ``last_a`` of A and ``last_b`` of B, where both have the same offset.
    """
    begin = lambda last: np.append(0, last[:-1])[: len(last)]
    lo_a, hi_a, lo_b, hi_b = begin(last_a), last_a, begin(last_b), last_b
    found_a, found_b = [last_a], [last_b]
    while True:
        may = (hi_a - lo_a > 1) & (hi_b - lo_b > 1)
        lo_a, hi_a, lo_b, hi_b = lo_a[may], hi_a[may], lo_b[may], hi_b[may]
        if not len(lo_a):
            break
        mid = (lo_a + hi_a - 1) // 2
        i, j = _common_right(ends_a, ends_b, mid)
        none = np.flatnonzero(i == hi_a - 1)  # only the interval's own end
        i[none], j[none] = _common_left(ends_a, ends_b, mid[none], lo_a[none], lo_b[none])
        cut = i >= 0
        lo_a, hi_a, lo_b, hi_b, i, j = lo_a[cut], hi_a[cut], lo_b[cut], hi_b[cut], i[cut] + 1, j[cut] + 1
        found_a.append(i)
        found_b.append(j)
        lo_a, hi_a = np.concatenate((lo_a, i)), np.concatenate((i, hi_a))
        lo_b, hi_b = np.concatenate((lo_b, j)), np.concatenate((j, hi_b))
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


def _common_right(ends_a: np.ndarray, ends_b: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First tokens from ``start`` on that end together."""
    i, j = start.copy(), np.zeros_like(start)
    left = np.arange(len(start))
    while len(left):
        j[left] = np.searchsorted(ends_b, ends_a[i[left]])
        left = left[ends_b[j[left]] != ends_a[i[left]]]
        i[left] = np.searchsorted(ends_a, ends_b[j[left]])
        left = left[ends_b[j[left]] != ends_a[i[left]]]
    return i, j


def _common_left(ends_a: np.ndarray, ends_b: np.ndarray, start: np.ndarray, lo_a: np.ndarray, lo_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last tokens before ``start`` that end together; -1 if there are none."""
    i, j = start - 1, np.full(len(start), -1)
    left = np.arange(len(start))

    def inside(places: np.ndarray, least: np.ndarray) -> np.ndarray:
        i[left[places[left] < least[left]]] = -1
        return left[places[left] >= least[left]]

    left = inside(i, lo_a)
    while len(left):
        j[left] = np.searchsorted(ends_b, ends_a[i[left]], side="right") - 1
        left = inside(j, lo_b)
        left = left[ends_b[j[left]] != ends_a[i[left]]]
        i[left] = np.searchsorted(ends_a, ends_b[j[left]], side="right") - 1
        left = inside(i, lo_a)
        left = left[ends_b[j[left]] != ends_a[i[left]]]
    return i, j


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of each text, for all texts, and the order in which the texts stand."""
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
    plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
    lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), " ")
    cut = [_CUT.split(t) for t in texts.take(pa.array(rest)).to_pylist()]
    return pa.concat_arrays([lists, pa.array([[f" {c[0]}", *c[1:]] for c in cut], lists.type)]), np.concatenate((plain, rest))


class Block:
    """Aligned texts; arrays over texts are in the order of ``rows``, their places."""

    def __init__(self, tools: Tokenizers, texts: pa.Array):
        """``texts``: large strings, none of them null or empty."""
        lists, order = _pieces(texts)
        numbered = lists.flatten().dictionary_encode()
        known = tools.lookup(numbered.dictionary.to_pylist())
        bad = np.array([k is None for k in known], dtype=bool)
        numbers, begin = numbered.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy()[:-1].astype(np.int64)
        per = np.diff(lists.offsets.to_numpy())
        if bad.any():
            ok = ~np.logical_or.reduceat(bad[numbers], begin)
            used, numbers = np.unique(numbers[np.repeat(ok, per)], return_inverse=True)
            order, per, known = order[ok], per[ok], [known[k] for k in used]
        self.rows, self.numbers, self.known = order, numbers, known
        self.begin = np.cumsum(per) - per
        counts = np.array([k[:3] for k in known], dtype=np.int64).reshape(-1, 3)[numbers]
        self.n_a, self.n_b, self.n_groups = np.add.reduceat(counts, self.begin).T if len(order) else np.zeros((3, 0), dtype=np.int64)

    def texts(self) -> Iterator[bytes]:
        """Groups of each text, as ``a1,a2|b1;a3|b2,b3``."""
        shown = [k[4] for k in self.known]
        numbers = self.numbers.tolist()
        for first, last in zip(self.begin.tolist(), [*self.begin[1:].tolist(), len(numbers)]):
            yield b";".join([shown[w] for w in numbers[first:last]])

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of the block (A ids in the high half), how many texts hold each,
        and, sorted by text: text, place of the pair, how often it is linked there."""
        if not self.known:
            return (np.zeros(0, dtype=np.int64),) * 5
        size = np.array([len(k[3]) // 8 for k in self.known], dtype=np.int64)
        codes, place = np.unique(np.frombuffer(b"".join([k[3] for k in self.known]), dtype=np.int64), return_inverse=True)
        sizes = size[self.numbers]
        ends = np.cumsum(sizes)
        at = place[np.arange(int(ends[-1])) + np.repeat((np.cumsum(size) - size)[self.numbers] - ends + sizes, sizes)]
        text = np.repeat(np.arange(len(self.rows)), np.add.reduceat(sizes, self.begin))
        both, times = np.unique((text << 32) | at, return_counts=True)
        at = both & 0xFFFFFFFF
        return codes, np.bincount(at, minlength=len(codes)), both >> 32, at, times


def _blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for at, size in enumerate(sizes):
        if at > first and total + size > most:
            yield first, at
            first, total = at, 0
        total += int(size)
    if first < len(sizes):
        yield first, len(sizes)


_COLUMNS = "block long, n_a int, n_b int, n_groups int, n_links int, groups_sha256 string, groups string, pairs array<int>, times array<int>, codes array<long>, holders array<int>"


def _aligned(docs: DataFrame, a: str, b: str, key: str, text: str, groups: bool, block_bytes: int) -> DataFrame:
    """Rows of texts, and a row with ``codes`` and ``holders`` for each block."""
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, block = _loaded(a, b), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            for first, last in _blocks(pc.binary_length(texts).to_numpy(zero_copy_only=False), block_bytes):
                yield one(tools, block, batch.column(0).slice(first, last - first), texts.slice(first, last - first))
                block += 1

    def one(tools: Tokenizers, block: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        n = len(texts)
        filled = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        own = Block(tools, texts.take(pa.array(filled)))
        codes, holders, of, at, times = own.links()
        place = filled[own.rows]
        figures = np.zeros((4, n + 1), dtype=np.int32)
        per = np.bincount(of, minlength=len(place))
        figures[:, place] = own.n_a, own.n_b, own.n_groups, own.n_a + own.n_b - own.n_groups
        shas, shown = [""] * n + [None], [None] * (n + 1)
        for row, listed in zip(place, own.texts()):
            shas[row] = hashlib.sha256(listed).hexdigest()
            if groups:
                shown[row] = listed.decode()
        # Pairs of the texts in the order of the rows.
        counts = np.zeros(n + 1, dtype=np.int64)
        counts[place] = per
        begin = (np.cumsum(per) - per)[np.argsort(place, kind="stable")]
        lengths = counts[np.sort(place)]
        moved = np.arange(int(lengths.sum())) + np.repeat(begin - np.cumsum(lengths) + lengths, lengths)
        offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v[moved].astype(np.int32))) for v in (at, times)]
        only_last = pa.array([None] * n + [0], pa.int32())
        listed = [pa.ListArray.from_arrays(pa.concat_arrays([only_last, pa.array([len(codes)], pa.int32())]), pa.array(v)) for v in (codes, holders.astype(np.int32))]
        columns = [pa.array(np.full(n + 1, block)), *map(pa.array, figures), pa.array(shas, pa.string()), pa.array(shown, pa.string()), *lists, *listed]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([ids, pa.nulls(1, ids.type)]), *columns], names=["doc_id", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {_COLUMNS}")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(code, n, best)`` of every id pair: how many documents hold it, and whether no other
    pair of its A id is held by more."""
    each = blocks.where(F.col("codes").isNotNull()).select(F.inline(F.arrays_zip(F.col("codes").alias("code"), F.col("holders").alias("n"))))
    counts = each.groupBy("code").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("code", 32)))
    return counts.select("code", "n", (F.col("n") == most).alias("best"))


def _measured(key: tuple, docs: pa.Table, counts: pa.Table) -> pa.Table:
    place = counts.column("at").to_numpy()
    n, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
    n[place], best[place] = counts.column("n").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
    pairs, times = (docs.column(c).combine_chunks() for c in ("pairs", "times"))
    size = pc.list_value_length(pairs).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(size)), size)
    at, times = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    sums = []
    for value in (best, n):
        total = np.zeros(len(size), dtype=np.int64)
        np.add.at(total, of, times * value[at])
        sums.append(pa.array(total))
    return docs.drop_columns(["block", "pairs", "times"]).append_column("n_best", sums[0]).append_column("count_sum", sums[1])


def aligned(
    docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", groups: bool = False, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum)`` for every
    row of ``docs``; ``a`` is a byte-level BPE file, ``b`` a SentencePiece model. With
    ``groups`` the groups themselves come as a text, null for rows without tokens."""
    blocks = stored(_aligned(docs, a, b, key, text, groups, block_bytes), "aligned")
    listed = blocks.where(F.col("codes").isNotNull()).select("block", F.posexplode("codes").alias("at", "code"))
    counts = listed.join(pair_counts(blocks), "code").select(F.col("block").alias("of_block"), "at", "n", "best")
    shown = ["groups"] if groups else []
    figures = ["n_a", "n_b", "n_groups", "n_links"]
    rows = blocks.where(F.col("codes").isNull()).select("block", "doc_id", *[F.col(c).cast("long").alias(c) for c in figures], "groups_sha256", *shown, "pairs", "times")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("block", "pairs", "times")]
    both = rows.groupBy("block").cogroup(counts.groupBy("of_block"))
    return both.applyInArrow(_measured, ", ".join([*kinds, "n_best long", "count_sum long"]))
