"""Near-duplicate vectors against all pairs in plain numpy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import Row

from ledgerlark.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, node string, dim int, near string, `_c0` int, cell int, class0 int"
EXTRA = ("x", 1, "y", 2, 3, 4)


def brute(rows: list[tuple], similarity: float = 0.98) -> dict[int, tuple]:
    """Place in ``rows`` to ``(n_links, component_id, kept)``."""
    usable, n = [], len(rows)
    for _, vector, label, *_ in rows:
        ok = label is not None and vector and all(c is not None and math.isfinite(c) for c in vector) and any(vector)
        usable.append(np.array(vector, dtype=np.float32).astype(float) if ok else None)
    near = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            a, b = usable[i], usable[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            a, b = a / np.abs(a).max(), b / np.abs(b).max()
            if a @ b / math.sqrt((a @ a) * (b @ b)) >= similarity:
                near[i].add(j)
                near[j].add(i)
    out = {}
    for i in range(n):
        seen, front = {i}, [i]
        while front:
            front = [j for k in front for j in near[k] if j not in seen]
            seen.update(front)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        first = min(ids) if ids else None
        out[i] = (len(near[i]), first, rows[i][0] == first)
    return out


def odd_vectors() -> list[tuple]:
    draw = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        for centre in range(6):
            base = draw.normal(size=8)
            for _ in range(20):
                rows.append((base + draw.normal(size=8) * 0.12 * draw.random(), label))
    dense = draw.normal(size=8)
    rows += [(dense + draw.normal(size=8) * 0.01, 2) for _ in range(60)]  # a core
    rows += [(dense * 3, 2)] * 30  # copies
    rows += [(v * 1e30, 1) for v, _ in rows[:2]] + [(v[:5], 1) for v, _ in rows[:40]]
    out = [(100 + at, [float(c) for c in v], label, *EXTRA) for at, (v, label) in enumerate(rows)]
    nan, inf = float("nan"), float("inf")
    one = out[0][1]
    out += [
        (1, None, 0, *EXTRA), (2, [], 0, *EXTRA), (3, [0.0] * 8, 0, *EXTRA), (4, [nan] + one[1:], 0, *EXTRA), (5, [inf] + one[1:], 0, *EXTRA),
        (6, [None] + one[1:], 0, *EXTRA), (7, one, None, *EXTRA), (None, one, 0, *EXTRA), (8, one, 0, *EXTRA), (8, one, 0, *EXTRA),
        (8, [-c for c in one], 0, *EXTRA), (None, [5.0, -3.0] + [0.0] * 6, 3, *EXTRA), (None, [5.0, -3.0, -0.0] + [0.0] * 5, 3, *EXTRA),
        (9, [1.0], 4, *EXTRA), (10, [2.0], 4, *EXTRA), (11, [-2.0], 4, *EXTRA),
    ]
    random.Random(1).shuffle(out)
    return out


@pytest.mark.parametrize("options", [{}, {"cell_rows": 12}, {"cell_rows": 12, "block": 7}, {"block": 16}, {"cell_rows": 40, "block": 9, "similarity": 0.9}])
def test_links_and_components_equal_all_pairs(spark, options):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    wanted = brute(rows, options.get("similarity", 0.98))
    out = embedding_dedup.linked(df, **options)
    assert out.columns == [*df.columns, "_near"]
    found = out.select("vec_id", "embedding", "label", "_near.*").collect()
    plain = lambda i, v, lab, r: repr((i, None if v is None else [c if c is None else float(np.float32(c)) for c in v], lab, r))
    assert sorted(plain(r[0], r[1], r[2], (r[3], r[4], r[5])) for r in found) == sorted(plain(rows[i][0], rows[i][1], rows[i][2], w) for i, w in wanted.items())


def test_every_cell_layout_has_cores_guests_and_blocks(spark):
    """The cases above really meet more than one cell, cores and guests."""
    df = spark.createDataFrame(odd_vectors(), SCHEMA)
    classes = embedding_dedup.folded(df, "embedding", "label", "vec_id")
    at_home = embedding_dedup.placed(classes, embedding_dedup.fit(classes, cell_rows=12), 0.98)
    got = at_home.selectExpr("count(DISTINCT home)", "count_if(core)", "sum(size(guests))").first()
    assert min(got) > 2


def test_representatives_keep_one_of_each_group(spark):
    rows = odd_vectors()
    wanted = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    kept = embedding_dedup.representatives(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.vec_id for r in kept.collect()))) == sorted(str(rows[i][0]) for i, w in wanted.items() if w[2])


def test_empty_and_all_unusable_tables(spark):
    assert embedding_dedup.linked(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, None, 0, *EXTRA), (1, [0.0], 0, *EXTRA)], SCHEMA)
    assert embedding_dedup.linked(df).select("_near.*").collect() == [Row(n_links=0, component_id=1, kept=True)] * 2
    with pytest.raises(ValueError):
        embedding_dedup.linked(df, similarity=0)


def test_double_vectors_and_string_labels(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], "l"), ("b", [1e200, 1e199], "l"), ("c", [0.0, 1.0], "l"), ("d", [1.0, 0.01], "m")], "k string, v array<double>, l string")
    out = embedding_dedup.linked(df, "k", "v", "l")
    assert sorted(map(tuple, out.select("k", "near.n_links", "near.component_id").collect())) == [("a", 1, "a"), ("b", 1, "a"), ("c", 0, "c"), ("d", 0, "d")]
