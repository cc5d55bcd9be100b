"""Whitening of embeddings by a covariance from variances alone (polarisation).

Entries become whole numbers, ``x = floor(64 c) + 1000000``, so that all sums are exact.
The fit list holds each distinct x vector once.

1. Aggregates over the fit list give its length ``n`` and the sums ``S`` of every dimension.
2. Centred values ``d = n x - S`` are whole numbers. Tasks square them, for every dimension
   and for the sum of every pair of dimensions, and add the squares up exactly; one row per
   pair and task is left for Spark to add.
3. ``2 cov(i, j) = var(i + j) - var(i) - var(j)`` recovers all cross-covariances; the matrix,
   whose size depends on the number of dimensions alone, goes to ``eigh`` on the driver.
4. Every row is centred and projected in its task. The covariance of the whitened fit list is
   measured in one more pass.

Defined cases: rows with a null or empty vector, a null or non-finite entry, or another
length than the most frequent one (of equally frequent ones the smallest) are left out;
entries whose x is beyond ``LARGEST`` in size are held there; repeated rows and null ids are
rows like any other; components without variance have null as ``whitened`` and do not count in
``identity_error``, which is null if there are none; ``explained`` is null if all rows are
equal; an empty table gives an empty result. The order of components with equal eigenvalues is
that of ``eigh``. Column names of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
LARGEST = 2**60
# Rows that are squared at once, whose parts of squares add up below 2**63, and entries of
# all their pairs of dimensions.
AT_ONCE = 256
ENTRIES = 1 << 20
_PART = 27
_FAST = 2**52
# Digits of 15 decimals that hold the square of any centred value, summed over any list.
_DIGITS = 6


def whole(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, x)`` of the rows that can be used, of all lengths."""
    entry = F.col(f"`{vector}`")
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)) + SHIFT
    rows = vectors.where(F.coalesce(finite & (F.size(entry) > 0), F.lit(False)))
    return rows.select(F.col(f"`{key}`").alias("id"), F.transform(entry, held).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: list[int], fast: bool) -> np.ndarray:
    """``n x - S``, as Python integers where 64 bits do not do."""
    if fast:
        # Both terms are near n times the smallest entry, which cancels.
        return (x - SHIFT) * n - np.array([s - n * SHIFT for s in sums], dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


@dataclass(frozen=True)
class Fit:
    """What the fit list says: exact ``n``, ``sums`` and ``covariance`` (times n cubed)."""

    n: int
    sums: list[int]
    fast: bool
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # one column each
    trace: float

    def usable(self) -> np.ndarray:
        """Components whose eigenvalue is more than a rounding error."""
        return self.values > max(len(self.sums), 1) * np.finfo(float).eps * max(self.values[0], 0.0)

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centred values, and coordinates with NaN for components without variance."""
        d = _centred(x, self.n, self.sums, self.fast)
        ok = self.usable()
        out = (d.astype(np.float64) / self.n) @ self.vectors
        return d, np.where(ok, out / np.sqrt(np.where(ok, self.values, 1.0)), np.nan)


def fit_list(rows: DataFrame) -> tuple[DataFrame, int]:
    """Distinct x vectors of the most frequent length, and that length."""
    most = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = most["dim"] if most else 0
    return stored(rows.where(F.size("x") == dim).select("x").distinct(), "fit"), dim


def _moments(points: DataFrame, dim: int) -> tuple[int, list[int], bool]:
    """Length and sums of the fit list, exactly, and whether 64 bits hold centred values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 1 << 12):
                x = _matrix(batch.column(0).slice(first, 1 << 12)) - SHIFT
                # Halves of 32 bits, so that sums of a few thousand stay exact.
                parts = [np.arange(dim, dtype=np.int32), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), np.full(dim, len(x)), np.abs(x).max(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names=["i", "high", "low", "n", "most"])

    parts = points.mapInArrow(run, "i int, high long, low long, n long, most long").groupBy("i")
    big = lambda c: F.sum(F.col(c).cast("decimal(28,0)"))
    found = sorted(parts.agg(big("high"), big("low"), F.sum("n"), F.max("most")).collect())
    n = int(found[0][3])
    sums = [int(r[1]) * 2**32 + int(r[2]) + n * SHIFT for r in found]
    return n, sums, 2 * n * max(int(r[4]) for r in found) < _FAST


def squares(d: np.ndarray) -> list[int] | np.ndarray:
    """Exact sums of squares of the columns, as a high, middle and low part each."""
    if d.dtype == object:
        return [int(v) for v in (d * d).sum(axis=0)]
    high, low = d >> _PART, d & ((1 << _PART) - 1)
    return np.stack([(high * high).sum(axis=0), (high * low).sum(axis=0), (low * low).sum(axis=0)])


def polarised(points: DataFrame, dim: int, n: int, sums: list[int], fast: bool) -> np.ndarray:
    """Matrix of exact ``n**3`` times the covariances, as Python integers."""
    left, right = np.triu_indices(dim)
    at_once = max(1, min(AT_ONCE, ENTRIES // len(left)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * len(left)
        parts = np.zeros((3, len(left)), dtype=object)
        for batch in batches:
            for first in range(0, len(batch), at_once):
                d = _centred(_matrix(batch.column(0).slice(first, at_once)), n, sums, fast)
                # A dimension paired with itself stands for that dimension alone.
                both = np.where(left == right, d[:, left], d[:, left] + d[:, right])
                found = squares(both)
                if fast:
                    parts += found
                else:
                    total = [a + b for a, b in zip(total, found)]
        values = [t + (int(h) << (2 * _PART)) + (int(m) << (_PART + 1)) + int(lo) for t, (h, m, lo) in zip(total, parts.T)]
        # Whole numbers of any size, in digits of 15 decimals that Spark adds up.
        digits = [[v // 10 ** (15 * at) % 10**15 for v in values] for at in range(_DIGITS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(left)), pa.int32()), *[pa.array(g, pa.int64()) for g in digits]], names=["pair", *_names])

    _names = [f"d{at}" for at in range(_DIGITS)]
    rows = points.mapInArrow(run, "pair int, " + ", ".join(f"{c} long" for c in _names))
    added = rows.groupBy("pair").agg(*[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in _names])
    var = {r["pair"]: sum(int(r[c]) * 10 ** (15 * at) for at, c in enumerate(_names)) for r in added.collect()}
    out = np.zeros((dim, dim), dtype=object)
    own = {int(i): var[at] for at, (i, j) in enumerate(zip(left, right)) if i == j}
    for at, (i, j) in enumerate(zip(left, right)):
        # 2 cov = var(i + j) - var(i) - var(j), always an even number here.
        out[i, j] = out[j, i] = own[int(i)] if i == j else (var[at] - own[int(i)] - own[int(j)]) // 2
    return out


def fit(points: DataFrame, dim: int) -> Fit:
    n, sums, fast = _moments(points, dim)
    exact = polarised(points, dim, n, sums, fast)
    # Division of Python integers rounds once.
    covariance = np.array([[v / n**3 for v in row] for row in exact.tolist()], dtype=np.float64)
    trace = sum(exact.diagonal().tolist()) / n**3
    values, vectors = np.linalg.eigh(covariance)
    return Fit(n, sums, fast, np.maximum(values[::-1], 0.0), vectors[:, ::-1], trace)


def identity_error(points: DataFrame, found: Fit, components: int) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    ok = int(found.usable()[:components].sum())  # the first ones, as eigenvalues fall
    if not ok:
        return None
    shared = points.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(ok), np.zeros((ok, ok))
        for batch in batches:
            if len(batch):
                w = shared.value.whitened(_matrix(batch.column(0)))[1][:, :ok]
                first, second = first + w.sum(axis=0), second + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ok + ok * ok), pa.int32()), pa.array(np.concatenate((first, second.ravel())))], names=["at", "part"])

    rows = points.mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part")).collect()
    sums = np.array([v for _, v in sorted(rows)]) / found.n
    return float(np.abs(sums[ok:].reshape(ok, ok) - np.outer(sums[:ok], sums[:ok]) - np.eye(ok)).max())


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, n, deviation, whitened, explained, identity_error)``: one row per usable row,
    ``whitened`` and ``explained`` as arrays over the first ``components`` components.
    ``deviation`` is a decimal, exact, and null if it has more than 38 digits."""
    rows = whole(vectors, key, vector)
    points, dim = fit_list(rows)
    kind = rows.schema["id"].dataType.simpleString()
    if not dim:
        return rows.select(F.col("id").alias("vec_id"), *[F.lit(None).cast(k).alias(c) for c, k in _OUT]).where(F.lit(False))
    found = fit(points, dim)
    top = min(components, dim)
    error = identity_error(points, found, top)
    explained = [float(v / found.trace) if found.trace > 0 else None for v in found.values[:top]]
    shared = vectors.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            d, w = shared.value.whitened(_matrix(batch.column(1)))
            if shared.value.fast and int(np.abs(d).max()) ** 2 * dim < 2**63:
                deviation = [str(v) for v in (d * d).sum(axis=1).tolist()]
            else:
                deviation = [str(sum(v * v for v in row)) for row in d.tolist()]
            w = np.ascontiguousarray(w[:, :top])
            flat = pa.array(w.ravel(), from_pandas=True)  # NaN becomes null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, top, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation), lists], names=["vec_id", "deviation", "whitened"])

    out = rows.where(F.size("x") == dim).mapInArrow(run, f"vec_id {kind}, deviation string, whitened array<double>")
    return out.select(
        "vec_id", F.lit(found.n).cast("long").alias("n"), F.col("deviation").try_cast("decimal(38,0)").alias("deviation"), "whitened",
        F.array(*[F.lit(v).cast("double") for v in explained]).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


_OUT = [("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "array<double>"), ("explained", "array<double>"), ("identity_error", "double")]


def by_component(rows: DataFrame) -> DataFrame:
    """One row per row and component, numbered from 1; a ``deviation`` beyond 64 bits is null."""
    each = F.posexplode(F.arrays_zip(F.col("whitened").alias("w"), F.col("explained").alias("e"))).alias("_at", "_of")
    rows = rows.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", each)
    return rows.select("vec_id", (F.col("_at") + 1).alias("component"), "n", "deviation", F.col("_of.w").alias("whitened"), F.col("_of.e").alias("explained"), "identity_error")
