"""Substring dedup on the de Bruijn graph of words.

Edges of the graph are windows of ``WINDOW`` consecutive words. Each window belongs to its
minimizer, the k-mer of ``KMER`` words with the least hash in it; consecutive windows with
one minimizer form a run, a path that is compacted before it is moved. Runs meet by
minimizer, so all occurrences of an edge meet in one place, and the occurrence first in
the corpus is its source (for runs settled within a batch, the first of the batch). Windows whose neighbours and whose sources both follow each
other are then compacted, over documents, into spans: nonbranching repeated paths with
source coordinates. A removed word is one that a span covers.

Data that move: one row per run (about a seventh of the words) with six bytes per window,
spans, and each text once for the result. Windows are told apart by 112 bits, 64 of the
minimizer and 48 of the window.

Skew: a task folds equal runs before the shuffle, so a passage in any number of documents
costs one row per task batch. K-mers that are frequent within a batch are counted over
all documents first, and the ``HEAVY`` most frequent ones are chosen as minimizers only
where a window has no other, so that a short phrase in many contexts is spread over its
contexts. This ordering affects balance alone, not results.

Defined cases: null and blank texts have no words; texts shorter than a window lose
nothing; a null id comes after all others; rows with equal ids are ordered by a hash of
the text, and rows equal in both are one document, judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, keyed
from .hashing import WordHasher, mixed, texts_of, windows

WINDOW = 20
KMER = 8
HEAVY = 100_000
# Occurrences within one batch from which a k-mer is counted.
HEAVY_IN_BATCH = 64
_BYTES = 6
_TOP = np.uint64(1 << 63)


def _words(text: str) -> list[bytes]:
    return text.encode().split()


def _ranks(hashes: np.ndarray, kmer: int, heavy: np.ndarray) -> np.ndarray:
    """Order of the k-mers: by hash, the heavy ones last."""
    ranks = windows(hashes, kmer, 1) >> np.uint64(1)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, ranks), len(heavy) - 1)
        ranks = np.where(heavy[at] == ranks, ranks | _TOP, ranks)
    return ranks


def heavy_kmers(docs: DataFrame, kmer: int = KMER, bound: int = HEAVY, in_batch: int = HEAVY_IN_BATCH) -> np.ndarray:
    """The ``bound`` k-mers counted most, of those frequent within some batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            parts = [_ranks(hasher.words(t), kmer, np.empty(0, dtype=np.uint64)) for t in texts_of(batch.column(2))]
            found = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
            values, n = np.unique(found, return_counts=True)
            often = n >= in_batch
            yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often])], names=["kmer", "n"])

    counted = docs.mapInArrow(run, "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "kmer").limit(bound).select("kmer").collect()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))


def _runs(docs: DataFrame, window: int, kmer: int, heavy: np.ndarray) -> DataFrame:
    """Runs of every document, ``(h, id, th, start, n, edges, src_id, src_start)``. Of
    equal runs in a batch the first has ``edges`` and no more; the others have their
    length, and that one as their source."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids, ths, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), list(texts_of(batch.column(2)))
            order, last = np.lexsort((ths, ids)), None
            anchors, edges, begins, owners, used = [], [], [], [], 0
            for i in order:
                if (ids[i], ths[i]) == last:
                    continue
                last = (ids[i], ths[i])
                hashes = hasher.words(texts[i])
                if len(hashes) < window:
                    continue
                ranks, n = _ranks(hashes, kmer, shared.value), len(hashes) - window + 1
                least = ranks[:n].copy()
                for j in range(1, window - kmer + 1):
                    np.minimum(least, ranks[j : j + n], out=least)
                starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
                anchors.append(least[starts])
                edges.append(windows(hashes, window, 2))
                begins.append(starts + used)
                owners.append((i, used, len(starts)))
                used += n
            if not anchors:
                continue
            anchor, edge, begin = np.concatenate(anchors), np.concatenate(edges), np.concatenate(begins)
            size = np.diff(np.append(begin, used))
            owner = np.repeat([o[0] for o in owners], [o[2] for o in owners])
            start = begin - np.repeat([o[1] for o in owners], [o[2] for o in owners])
            # Equal runs: same minimizer, length and edges; two sums over the edges tell them apart.
            place = np.arange(used, dtype=np.uint64) - np.repeat(begin, size).astype(np.uint64)
            one = np.add.reduceat(mixed(edge + place * np.uint64(0x9E3779B97F4A7C15)), begin)
            two = np.add.reduceat(mixed(edge ^ (place << np.uint64(32))), begin)
            by = np.lexsort((np.arange(len(anchor)), two, one, anchor))
            new = np.append(True, (anchor[by][1:] != anchor[by][:-1]) | (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1]))
            first = np.empty(len(anchor), dtype=np.int64)
            first[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
            own = first == np.arange(len(anchor))
            sent = np.where(own, size, 0)
            data = np.ascontiguousarray(edge[np.repeat(own, size)].view(np.uint8).reshape(-1, 8)[:, :_BYTES])
            offsets = np.concatenate(([0], np.cumsum(sent) * _BYTES)).astype(np.int32)
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(anchor), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            # Runs that are settled already go anywhere.
            to = np.where(own, anchor, mixed(owner.astype(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(to), pa.array(ids[owner]), pa.array(ths[owner]), pa.array(start), pa.array(np.where(own, 0, size)), blobs,
                    pa.array(np.where(own, 0, ids[owner[first]])), pa.array(np.where(own, 0, start[first])),
                ],
                names=["h", "id", "th", "start", "n", "edges", "src_id", "src_start"],
            )

    return docs.mapInArrow(run, "h long, id long, th long, start long, n long, edges binary, src_id long, src_start long")


_PIECES = "id long, th long, start long, n long, src_id long, src_start long"


def _repeated(table: pa.Table) -> pa.RecordBatch:
    """Pieces of the runs of whole minimizers, in corpus order, that occur before."""
    h, ids, ths, start, n = (table.column(c).to_numpy() for c in ("h", "id", "th", "start", "n"))
    blob = table.column("edges").combine_chunks()
    blob = blob.chunk(0) if isinstance(blob, pa.ChunkedArray) else blob
    offsets = np.frombuffer(blob.buffers()[1], dtype=np.int32)[blob.offset : blob.offset + len(blob) + 1]
    size = np.diff(offsets) // _BYTES
    settled = size == 0
    raw = np.frombuffer(blob.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(-1, _BYTES)
    edge = np.zeros((len(raw), 8), dtype=np.uint8)
    edge[:, :_BYTES] = raw
    group = np.cumsum(np.append(0, h[1:] != h[:-1])).astype(np.uint64)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    edge = edge.view(np.uint64).ravel()
    # Minimizers of a chunk are numbered; a chunk that has more than 16 bits of them sorts by both.
    by = np.argsort(edge | (group[row] << np.uint64(48)), kind="stable") if group[-1] < 65536 else np.lexsort((edge, group[row]))
    new = np.append(True, (edge[by][1:] != edge[by][:-1]) | (group[row][by][1:] != group[row][by][:-1]))[: len(by)]
    first = np.empty(len(by), dtype=np.int64)
    first[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    at, source = start[row] + place, start[row[first]] + place[first]
    again = (at != source) | (ids[row] != ids[row[first]]) | (ths[row] != ths[row[first]])
    keep = np.flatnonzero(again)
    # Consecutive windows of a run whose sources follow each other are one piece.
    src = row[first][keep]
    cut = np.append(True, (row[keep][1:] != row[keep][:-1]) | (at[keep][1:] != at[keep][:-1] + 1) | (src[1:] != src[:-1]) | (source[keep][1:] != source[keep][:-1] + 1))[: len(keep)]
    begin = keep[cut]
    length = np.diff(np.append(np.flatnonzero(cut), len(keep)))
    done = np.flatnonzero(settled)
    columns = [
        np.concatenate((ids[row[begin]], ids[done])),
        np.concatenate((ths[row[begin]], ths[done])),
        np.concatenate((at[begin], start[done])),
        np.concatenate((length, n[done])).astype(np.int64),
        np.concatenate((ids[row[first]][begin], table.column("src_id").to_numpy()[done])),
        np.concatenate((source[begin], table.column("src_start").to_numpy()[done])),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "th", "start", "n", "src_id", "src_start"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle whole minimizers; the last one of a batch waits for the next batch."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        h = table.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1])) if len(h) else 0
        if cut:
            yield _repeated(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None and len(rest):
        yield _repeated(rest)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """Compacted paths: ``id, th, start, n`` (windows in a row that occur earlier), and
    the source ``src_id, src_start`` of the first; the others' sources follow it."""
    rows = keyed(docs, key, text)
    runs = _runs(rows, window, kmer, heavy_kmers(rows, kmer))
    pieces = runs.repartition("h").sortWithinPartitions("h", "id", "th", "start").mapInArrow(_meet, _PIECES)
    order = Window.partitionBy("id", "th").orderBy("start")
    new = (
        (F.lag(F.col("start") + F.col("n")).over(order) == F.col("start"))
        & (F.lag(F.col("src_start") + F.col("n")).over(order) == F.col("src_start"))
        & (F.lag("src_id").over(order) == F.col("src_id"))
    )
    path = F.sum(F.when(new, 0).otherwise(1)).over(order)
    return pieces.withColumn("_path", path).groupBy("id", "th", "_path").agg(
        F.min("start").alias("start"), F.sum("n").alias("n"), F.min("src_id").alias("src_id"), F.min("src_start").alias("src_start")
    ).drop("_path")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """Every row of ``docs`` as ``(doc_id, n_words, n_removed, kept)``; ``kept`` is the
    text of the words that no repeated window covers, joined by blanks."""
    spans = repeated_spans(docs, key, text, window, kmer)
    spans = spans.groupBy("id", "th").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))
    rows = keyed(docs, key, text).withColumn("doc_id", F.when(F.col("id") != LAST_ID, F.col("id")))
    joined = rows.join(spans, ["id", "th"], "left").select("doc_id", "text", "starts", "ns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            for text, starts, ns in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                words = _words(text)
                gone = np.zeros(len(words) + 1, dtype=np.int32)
                for start, n in zip(starts or (), ns or ()):
                    gone[start] += 1
                    gone[start + n + window - 1] -= 1
                left = np.cumsum(gone[:-1]) == 0
                totals.append(len(words))
                removed.append(len(words) - int(left.sum()))
                kept.append(b" ".join(words if removed[-1] == 0 else [words[i] for i in np.flatnonzero(left)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
