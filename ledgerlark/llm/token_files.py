"""Token ids in Parquet files.

Texts are range-sorted by id, encoded in that order and written as list columns: tokens
with dictionary encoding, the sorted id and offset columns with delta encoding, in row
groups and pages of bounded size. Parquet's page indexes then let a reader fetch a range
of ids, or only the metadata, without the rest.

Each row has its place within its file; the start in the whole stream follows from the
token counts of the files before. The range sort takes id and text hash, so a repeated or
null id may hold any share of the rows; texts are encoded a bounded number of characters
at a time, a long text by itself.

Defined cases: a null text has only the end id; null ids come first; rows with equal ids
are ordered by the hash of their text, and equal rows are interchangeable; an empty table
gives a file without rows.
"""

from __future__ import annotations

import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small

END_ID = 2
# Characters that are encoded at once, and pieces whose ids a worker remembers: those met
# again, and those met once.
CHARS_AT_ONCE = 4_000_000
MAX_PIECES = 300_000
MAX_FRESH = 400_000
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
# A blank between two other characters begins a new piece: no token crosses it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
# Letters whose class no version of Unicode changes: a run of them is one word to the tokenizer.
_LETTERS = frozenset(c for c in map(chr, range(0x250)) if c.isalpha())
_MARKS = string.punctuation
_ENCODERS: dict[str, Encoder] = {}


class _Pieces(dict):
    """Ids of pieces of text, as bytes. A piece stands between blanks (or, with
    ``blank`` empty, after something else), so that no token crosses its ends."""

    def __init__(self, encoder: Encoder, blank: str):
        self.encoder, self.blank, self.fresh = encoder, blank, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.fresh.pop(piece, None)
        if ids is not None:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = ids
            return ids
        ids = self._encoded(piece)
        if len(self.fresh) >= MAX_FRESH:
            self.fresh.clear()
        self.fresh[piece] = ids
        return ids

    def _encoded(self, piece: str) -> bytes:
        if _LETTERS.issuperset(piece):
            return self.encoder.word(self.blank + piece) if piece else self.encoder.whole(self.blank)
        head, newline, rest = piece.partition("\n")
        if newline and head and rest[:1] > " " and not head[-1:].isspace() and not rest[:1].isspace():
            # A newline between two other characters is a token of its own.
            return self[head] + self.encoder.newline + self.encoder.bare[rest]
        word = piece.rstrip(_MARKS)
        if word and len(word) < len(piece) and _LETTERS.issuperset(word):
            return self[word] + self.encoder.bare[piece[len(word) :]]
        return self.encoder.whole(self.blank + piece)


class Encoder:
    """The tokenizer, and the ids of pieces met before."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The byte level writes each byte as a character of its own.
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shown = [level.pre_tokenize_str(bytes([b]).decode()) for b in range(128)]
        self.shown = {b: s[0][0] for b, s in enumerate(shown) if s}
        for code in range(128, 0x250):
            first, last = chr(code).encode()
            self.shown[first], self.shown[last] = level.pre_tokenize_str(chr(code))[0][0]
        self.split_word = self.tokenizer.model.tokenize
        self.after_blank, self.bare = _Pieces(self, " "), _Pieces(self, "")
        self.newline = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Ids of one word, which the model alone splits."""
        found = self.split_word(word.encode().decode("latin-1").translate(self.shown))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _cut(self, text: str) -> list[str] | None:
        """Pieces of a text that the plain blanks do not give; None for all others."""
        if any(s in text for s in self.special):
            return [text]
        if "  " in text or any(c in text and (f"{c} " in text or f" {c}" in text) for c in _BLANKS):
            return _CUT.split(text)
        return None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has.

        The pieces are numbered first, so that every distinct one is looked up once.
        """
        cut = [self._cut(t) for t in texts]
        plain = pa.array([t if c is None else "" for t, c in zip(texts, cut)], pa.large_string())
        lists = pc.split_pattern(plain, " ")
        numbered = lists.values.dictionary_encode()
        after = [self.after_blank[p] for p in numbered.dictionary.to_numpy(zero_copy_only=False)]
        # The first piece of a text has no blank before it; a text cut otherwise is one piece.
        begin = lists.offsets.to_numpy()[:-1]
        first = [
            self.bare[t.partition(" ")[0]] if c is None and t else self._joined(c or []) for t, c in zip(texts, cut)
        ]
        known = after + first
        numbers = numbered.indices.to_numpy().astype(np.int64)
        numbers[begin] = len(after) + np.arange(len(texts))
        size = np.array([len(k) // 4 for k in known], dtype=np.int64)
        place = np.cumsum(size) - size
        sizes = size[numbers]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(place[numbers] - ends + sizes, sizes)
        return np.frombuffer(b"".join(known), dtype="<u4")[at], np.add.reduceat(sizes, begin) if len(begin) else size

    def _joined(self, pieces: list[str]) -> bytes:
        if len(pieces) == 1:
            return self.whole(pieces[0])
        return b"".join([self.bare[pieces[0]], *map(self.after_blank.__getitem__, pieces[1:])]) if pieces else b""


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """``(doc_id, part, at, n_tokens, tokens)`` in the order of ids; ``at`` counts the ids
    before it in the same partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, texts, first = batch.column(0), batch.column(1).to_pylist(), 0
            while first < len(texts):
                last, chars = first, 0
                while last < len(texts) and (last == first or chars + len(texts[last] or "") <= CHARS_AT_ONCE):
                    chars += len(texts[last] or "")
                    last += 1
                found, sizes = encoder.encode([t or "" for t in texts[first:last]])
                ids = np.insert(found, np.cumsum(sizes), end_id).view(np.int32)
                ends = np.cumsum(sizes + 1)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
                columns = [keys.slice(first, last - first), np.full(len(sizes), part, dtype=np.int32), at + ends - sizes - 1, (sizes + 1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([columns[0], *map(pa.array, columns[1:]), lists], names=["doc_id", "part", "at", "n_tokens", "tokens"])
                at, first = at + int(ends[-1]), last

    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"doc_id {kind}, part int, at long, n_tokens int, tokens array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    out = encoded(docs, tokenizer, key, text, end_id).write.option("compression", "zstd")
    out = out.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true")
    for column in ("doc_id", "part", "at", "n_tokens"):
        out = out.option(f"parquet.enable.dictionary#{column}", "false")
    out.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, tokens)``; columns that are not used are not read."""
    rows = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    # One row per written file.
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = rows.join(small(parts), F.col("part") == F.col("_part"))
    return joined.select("doc_id", (F.col("_before") + F.col("at")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "tokens")


def with_checksums(tokens: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from rows of ``read_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
