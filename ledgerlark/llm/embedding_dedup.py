"""Near-duplicate vectors by spherical k-means cells.

1. Rows with the same label and vector are one class, counted; copies are never compared.
2. Spherical k-means, fitted on a sample of ``SAMPLE`` classes, gives one cell per
   ``CELL_ROWS`` classes, ``MAX_CELLS`` at most. Every class has the cell of its nearest
   centroid as its home.
3. No link is lost between cells: linked unit vectors are at most ``d = sqrt(2 - 2 t)``
   apart, so a class whose product with its own centroid exceeds that with another one by
   no more than ``d`` times the distance of the two centroids is a guest in that cell too.
   Guests go to cells before their own only, so each pair of cells meets once.
4. Members of a cell whose cosine with the centroid is at least ``sqrt((1 + t) / 2)`` are
   its core: any two of them are linked, so they are counted and not compared.
5. The rest of a cell is compared by blocked matrix products in double precision. A cell of
   more than ``BLOCK`` members is cut into blocks, and every pair of blocks is a task. A task
   returns sums of links per class and one edge per connected class, never the pairs.
6. Components of the edges; the row with the smallest id of each is the representative.

Only rows of equal labels and lengths are compared. Defined cases: a null label, a null,
empty or zero vector, and one with null or non-finite components link with nothing; rows
with equal ids are rows of their own; a null id is no candidate for the smallest one, and a
component without any id has none, and keeps its rows; vectors of another length than the
most frequent one have a single cell. Columns of the input stay whatever their names are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, small, stored
from .components import components

SIMILARITY = 0.98
SAMPLE = 16_384
CELL_ROWS = 4096
MAX_CELLS = 1024
ROUNDS = 10
# Members of a cell that one side of a task holds, and rows of a product made at once.
BLOCK = 4096
STRIP = 512
_SLACK = 1e-9
HOME, CORE, GUEST = 0, 1, 2


def units(lists: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision from lists of one length."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(lists), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares stay finite
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """``k`` unit centroids; begins with vectors spread evenly over the sample."""
    centres = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)]
    for _ in range(rounds):
        nearest = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def _values(df: DataFrame, vector: str) -> Column:
    """The vector without negative zeros, which equal positive ones."""
    kind = df.schema[vector].dataType.elementType
    kind = kind if isinstance(kind, T.FloatType) else T.DoubleType()
    return F.transform(F.col(f"`{vector}`"), lambda c: (c.cast("double") + F.lit(0.0)).cast(kind))


def _can_link(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def _names(vector: Column, label: Column) -> list[Column]:
    """128 bits that tell classes apart."""
    ok = _can_link(vector, label)
    return [F.when(ok, F.xxhash64(F.lit(seed), label, vector)) for seed in (1, 2)]


def folded(vectors: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """``(node, label, dim, vec, copies, head)``: one row per class, with its smallest id."""
    rows = vectors.select(_values(vectors, vector).alias("vec"), F.col(f"`{label}`").alias("label"), F.col(f"`{key}`").alias("id"))
    rows = rows.where(_can_link(F.col("vec"), F.col("label")))
    classes = rows.groupBy("label", "vec").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("head"))
    return stored(classes.select(F.monotonically_increasing_id().alias("node"), "label", F.size("vec").alias("dim"), "vec", "copies", "head"), "classes")


def fit(classes: DataFrame, sample: int = SAMPLE, cell_rows: int = CELL_ROWS) -> np.ndarray | None:
    """Centroids for the most frequent length, from the ``sample`` classes with the smallest
    hashes of label and vector; None if one cell is enough."""
    most = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    cells = min(MAX_CELLS, -(-most["n"] // cell_rows)) if most else 0
    if cells < 2:
        return None
    order = [F.xxhash64("label", "vec"), F.col("node")]
    rows = classes.where(F.col("dim") == most["dim"]).orderBy(*order).limit(sample).select("vec")
    vectors = units(rows.toArrow().column("vec"))
    return spherical_kmeans(vectors, min(cells, len(vectors)))


def placed(classes: DataFrame, centres: np.ndarray | None, similarity: float) -> DataFrame:
    """``classes`` with ``home``, whether they are ``core``, and ``guests``, the cells before
    their home that may hold a partner."""
    if centres is None:
        return classes.select("*", F.lit(0).alias("home"), F.lit(False).alias("core"), F.array().cast("array<int>").alias("guests"))
    shared = classes.sparkSession.sparkContext.broadcast(centres)
    reach, whole = math.sqrt(max(0.0, 2 - 2 * similarity)), math.sqrt((1 + similarity) / 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * own @ own.T)) * reach + _SLACK
        before = np.arange(len(own))
        for batch in batches:
            n = len(batch)
            home, core, open_to = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=bool), np.zeros((n, len(own)), dtype=bool)
            fits = np.flatnonzero(batch.column("dim").to_numpy() == own.shape[1])
            for at in np.split(fits, range(1024, len(fits), 1024)):
                if len(at):
                    near = units(batch.column("vec").take(pa.array(at))) @ own.T
                    home[at] = near.argmax(axis=1)
                    best = near.max(axis=1)
                    core[at] = best >= whole + _SLACK
                    open_to[at] = (best[:, None] - near <= apart[home[at]]) & (before < home[at, None])
            offsets = np.append(0, np.cumsum(open_to.sum(axis=1))).astype(np.int32)
            guests = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(open_to)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(core), guests], names=[*batch.schema.names, "home", "core", "guests"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"{kinds}, home int, core boolean, guests array<int>")


CELL = ["label", "dim", "cell"]


def _tasks(members: DataFrame, block: int) -> DataFrame:
    """Members once for each pair of blocks ``(lo, hi)`` that they take part in as ``blk``.

    A cell of up to ``block`` members is one block. In larger ones homes, core and guests
    have blocks of their own; pairs of core blocks and of guest blocks need no task.
    """
    of = lambda kind: F.count_if(F.col("kind") == kind)
    sizes = members.groupBy(*CELL).agg(*[of(k).alias(f"n{k}") for k in (HOME, CORE, GUEST)])
    sizes = sizes.where(F.col("n0") + F.col("n1") > 0)  # guests alone have nobody to meet
    alone = F.col("n0") + F.col("n1") + F.col("n2") <= block
    blocks = [F.when(alone, 0).otherwise(F.ceil(F.col(f"n{k}") / block)).cast("int").alias(f"b{k}") for k in (HOME, CORE, GUEST)]
    sizes = stored(sizes.select(*[F.col(c).alias(f"_{c}") for c in CELL], *blocks), "cells")
    same = [F.col(c) == F.col(f"_{c}") for c in CELL]
    rows = members.join(small(sizes), same)
    own = F.element_at(F.array("b0", "b1", "b2"), F.col("kind") + 1)
    first = F.element_at(F.array(F.lit(0), F.col("b0"), F.col("b0") + F.col("b1")), F.col("kind") + 1)
    blk = F.when(own == 0, 0).otherwise(first + F.pmod(F.xxhash64("node"), F.greatest(own, F.lit(1)))).cast("int")
    upto = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    b0, b01, b012 = F.col("b0"), F.col("b0") + F.col("b1"), F.col("b0") + F.col("b1") + F.col("b2")
    others = (
        F.when(b012 == 0, F.array(F.lit(0)))
        .when(F.col("kind") == HOME, upto(F.lit(0), b012))
        .when(F.col("kind") == CORE, F.concat(upto(F.lit(0), b0), upto(b01, b012)))
        .otherwise(upto(F.lit(0), b01))
    )
    rows = rows.withColumn("blk", blk).select(*CELL, "node", "copies", "kind", "vec", "blk", F.explode(others).alias("other"))
    return rows.select(*CELL, F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "node", "copies", "kind", "vec")


def _linked_pairs(left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows of ``left`` and ``right`` are linked, from products of strips."""
    out = np.empty((len(left), len(right)), dtype=bool)
    for first in range(0, len(left), STRIP):
        cosine = left[first : first + STRIP] @ right.T
        out[first : first + STRIP] = cosine >= similarity
        for i, j in zip(*np.nonzero(np.abs(cosine - similarity) < 1e-12)):  # too near for a sum in another order
            a, b = left[first + i], right[j]
            out[first + i, j] = float(a @ b) / math.sqrt(float(a @ a) * float(b @ b)) >= similarity
    return out


def _roots(ok: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column the row that its component was entered by; -1 without a link."""
    rows, columns = np.full(ok.shape[0], -1), np.full(ok.shape[1], -1)
    for seed in np.flatnonzero(ok.any(axis=1)):
        if rows[seed] >= 0:
            continue
        front = np.array([seed])
        while len(front):
            rows[front] = seed
            met = np.flatnonzero(ok[front].any(axis=0) & (columns < 0))
            columns[met] = seed
            front = met[rows[met] < 0] if same else np.flatnonzero(ok[:, met].any(axis=1) & (rows < 0))
    return rows, columns


def _compared(similarity: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        lo, hi = key[3].as_py(), key[4].as_py()
        blk, node, copies, kind = (group.column(c).to_numpy() for c in ("blk", "node", "copies", "kind"))
        vectors = units(group.column("vec"))
        left, right = np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
        ok = _linked_pairs(vectors[left], vectors[right], similarity)
        for done in (CORE, GUEST):  # met in their own way
            ok[np.ix_(kind[left] == done, kind[right] == done)] = False
        if lo == hi:
            np.fill_diagonal(ok, False)
        rows, columns = _roots(ok, lo == hi)
        parts = [(left, ok @ copies[right], rows)] + ([] if lo == hi else [(right, copies[left] @ ok, columns)])
        out = []
        for at, links, root in parts:
            some = root >= 0
            out.append((node[at][some], links[some].astype(np.int64), node[left[root[some]]]))
        return pa.table([np.concatenate(c) for c in zip(*out)], names=["node", "links", "root"])

    return run


def links(classes: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, cell_rows: int = CELL_ROWS, sample: int = SAMPLE) -> DataFrame:
    """``(node, links, root)``: parts of the number of rows that a class is linked to, and
    an edge that connects it."""
    at_home = stored(placed(classes, fit(classes, sample, cell_rows), similarity), "placed")
    kind = F.when(F.col("core"), CORE).otherwise(HOME)
    stay = at_home.select("label", "dim", F.col("home").alias("cell"), kind.alias("kind"), "node", "copies", "vec")
    visit = at_home.select("label", "dim", F.explode("guests").alias("cell"), F.lit(GUEST).alias("kind"), "node", "copies", "vec")
    tasks = _tasks(stay.unionByName(visit), block)
    found = tasks.groupBy(*CELL, "lo", "hi").applyInArrow(_compared(similarity), "node long, links long, root long")
    core = at_home.where("core")
    whole = core.groupBy(*[F.col(c).alias(f"_{c}") for c in ("label", "dim", "home")]).agg(F.sum("copies").alias("all"), F.min("node").alias("root"))
    same = [F.col(c) == F.col(f"_{c}") for c in ("label", "dim", "home")]
    inner = core.select("label", "dim", "home", "node", "copies").join(small(whole), same)
    return stored(found.unionByName(inner.select("node", (F.col("all") - F.col("copies")).alias("links"), "root")), "links")


def linked(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    similarity: float = SIMILARITY, block: int = BLOCK, cell_rows: int = CELL_ROWS, sample: int = SAMPLE,
) -> DataFrame:
    """All rows and columns of ``vectors`` and one struct ``(n_links, component_id, kept)``,
    named ``near`` with underscores in front if that is taken."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    classes = folded(vectors, vector, label, key)
    found = links(classes, similarity, block, cell_rows, sample)
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("root").alias("a"), F.col("node").alias("b"))).withColumnRenamed("label", "component")
    # Classes that are linked or have copies; all others are alone.
    known = classes.select("node", "label", "vec", "copies", "head").join(sums, "node", "left").join(groups, "node", "left")
    known = known.where((F.col("copies") > 1) | F.col("links").isNotNull()).withColumn("component", F.coalesce("component", "node"))
    heads = known.groupBy("component").agg(F.min("head").alias("first"))
    names = [n.alias(f"_c{at}") for at, n in enumerate(_names(F.col("vec"), F.col("label")))]
    known = known.select("component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), *names)
    known = small(stored(known.join(heads, "component").select("_links", "first", "_c0", "_c1"), "linked"))
    out = free_name(vectors.columns, "near")
    mine = [free_name([*vectors.columns, out], f"class{at}") for at in (0, 1)]
    rows = vectors.withColumns(dict(zip(mine, _names(_values(vectors, vector), F.col(f"`{label}`")))))
    joined = rows.join(known, [rows[m] == known[f"_c{at}"] for at, m in enumerate(mine)], "left")
    first = F.when(known["_links"].isNull(), rows[f"`{key}`"]).otherwise(known["first"])
    near = F.struct(F.coalesce(known["_links"], F.lit(0)).alias("n_links"), first.alias("component_id"), rows[f"`{key}`"].eqNullSafe(first).alias("kept"))
    return joined.select(*[rows[f"`{c}`"] for c in vectors.columns], near.alias(out))


def representatives(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """Rows of ``vectors`` without those in the component of a smaller id."""
    out = free_name(vectors.columns, "near")
    return linked(vectors, key, vector, label, **options).where(f"{out}.kept").select(*[F.col(f"`{c}`") for c in vectors.columns])
