"""Language identification by nearest centroid.

Character 1- to 3-grams of the lower-cased letters are hashed into ``DIMENSIONS`` bins;
vectors are logarithmic counts times inverse document frequency, normalised. The labelled
sample of each language is clustered by spherical k-means, and a text gets the language of
the centroid with the largest cosine. A text further from all centroids than the farthest
few of the sample are from theirs is marked as rejected.

The model is fitted on a documented sample: of every language the ``SAMPLE`` different rows
with the smallest hashes of id and text. Each language is clustered in a group of its own;
the driver gets document frequencies and centroids, ``CENTROIDS`` rows of ``DIMENSIONS``
numbers per language. Prediction reads only the text, row by row, so no key can gather rows.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is
every text if nothing could be learned; ties go to the language first in code point order;
rows with a null language or null id are never learned from; repeated rows are sampled once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

DIMENSIONS = 4096
SAMPLE = 200
# Parts of a language that are numbered alone.
PARTS = 256
CENTROIDS = 3
ROUNDS = 10
REJECT_SHARE = 0.005
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool))
    return _LETTERS[0]


def counts(text: str | None) -> np.ndarray | None:
    """Logarithmic n-gram counts; None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.concatenate(([0], np.where(letter, codes, 0), [0])).astype(np.uint32)
    codes = codes[np.append((codes[:-1] != 0) | (codes[1:] != 0), True)]  # one gap between words
    one = codes * np.uint32(0x9E3779B1)
    two = one[:-1] ^ (codes[1:] * np.uint32(0x85EBCA6B))
    three = (two[:-1] * np.uint32(0xC2B2AE35)) ^ (codes[2:] * np.uint32(0x27D4EB2F))
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    bins = np.concatenate([(g * np.uint32(0x2C1B3C6D)) >> shift for g in (one, two, three)])
    return np.log1p(np.bincount(bins, minlength=DIMENSIONS)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    owners: np.ndarray  # language of each centroid
    least: float  # cosine under which a text is rejected

    def vectors(self, raw: np.ndarray) -> np.ndarray:
        out = raw * self.idf
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def _clusters(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means that begins with vectors far from each other."""
    chosen = [int(np.argmax(vectors @ vectors.sum(axis=0)))]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(np.argmin((vectors @ vectors[chosen].T).max(axis=1))))
    centres = vectors[chosen]
    for _ in range(ROUNDS):
        nearest = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[nearest == c].sum(axis=0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def labelled_sample(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``(lang, text)``, at most ``SAMPLE`` different rows of each language."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    rows = rows.withColumn("th", F.xxhash64("text"))
    names = rows.select("lang", "id", "th", F.xxhash64("id", "th").alias("place")).distinct()
    # The first of each part of a language hold its first, and a part is all that one task gets.
    for keys in (["lang", F.pmod("id_part", F.lit(PARTS))], ["lang"]):
        order = Window.partitionBy(*keys).orderBy("place", "id", "th")
        names = names.withColumn("id_part", F.xxhash64("th", "id")).withColumn("_n", F.row_number().over(order))
        names = names.where(F.col("_n") <= SAMPLE).select("lang", "id", "th", "place")
    names = small(stored(names.select("lang", "id", "th"), "sample"))
    return rows.join(names, ["lang", "id", "th"], "left_semi").dropDuplicates(["lang", "id", "th"]).select("lang", "text")


def _vectors(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(name, counts(body)) for name, body in zip(batch["lang"], batch["text"])]
            yield pd.DataFrame([(name, v.tobytes()) for name, v in found if v is not None], columns=["lang", "vector"])

    return stored(sample.mapInPandas(run, "lang string, vector binary"), "sample-vectors")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(bytes(v), dtype=np.float32) for v in column])


def _frequencies(vectors: DataFrame) -> np.ndarray:
    """How many of the vectors have each bin, and, at the end, how many there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(DIMENSIONS + 1, dtype=np.int64)
        for batch in batches:
            for first in range(0, len(batch), 256):
                raw = _matrix(batch["vector"].iloc[first : first + 256])
                total += np.append((raw > 0).sum(axis=0), len(raw))
        yield pd.DataFrame({"bin": np.flatnonzero(total), "n": total[total > 0]})

    out = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    for at, n in vectors.mapInPandas(run, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect():
        out[at] = n
    return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    vectors = _vectors(labelled_sample(docs, key, text, lang))
    found = _frequencies(vectors)
    if not found[-1]:
        return None
    idf = (np.log((1 + found[-1]) / (1 + found[:-1])) + 1).astype(np.float32)
    blank = Model([], idf, np.empty((0, DIMENSIONS), dtype=np.float32), np.empty(0, dtype=int), 0.0)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        own = blank.vectors(_matrix(group["vector"].sort_values()))
        centres = _clusters(own, CENTROIDS)
        near = (own @ centres.T).max(axis=1)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "centres": [centres.astype(np.float32).tobytes()], "near": [near.astype(float)]})

    rows = sorted(vectors.groupBy("lang").applyInPandas(cluster, "lang string, centres binary, near array<double>").collect())
    centres = [np.frombuffer(bytes(r["centres"]), dtype=np.float32).reshape(-1, DIMENSIONS) for r in rows]
    owners = np.repeat(np.arange(len(rows)), [len(c) for c in centres])
    least = float(np.quantile(np.concatenate([r["near"] for r in rows]), REJECT_SHARE))
    return Model([r["lang"] for r in rows], idf, np.concatenate(centres), owners, least)


def identified(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            names, scores = [UNKNOWN] * len(batch), np.zeros(len(batch))
            for first in range(0, len(batch), 256):
                found = [(i, counts(body)) for i, body in enumerate(batch["text"].iloc[first : first + 256], first)]
                found = [(i, v) for i, v in found if v is not None] if own else []
                if found:
                    near = own.vectors(np.stack([v for _, v in found])) @ own.centroids.T
                    for (i, _), row in zip(found, near):
                        best = int(row.argmax())
                        names[i], scores[i] = own.languages[own.owners[best]], min(1.0, max(0.0, float(row[best])))
            rejected = scores < own.least if own else np.ones(len(batch), dtype=bool)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": names, "score": scores, "rejected": rejected})

    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), held_out(F.col(f"`{key}`")).alias("held_out"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
