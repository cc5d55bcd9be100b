"""Whitening against exact integers and numpy on the whole table."""

from __future__ import annotations

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from ledgerlark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int, pair int, id int, whitened string, dim int"
EXTRA = (0, "y", 1, 2, 3, "z", 4)


def brute(rows: list[tuple], components: int = 16):
    """Kept ``(vec_id, deviation, x)`` rows, n, sums and the exact covariance."""
    fine = [(i, v) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = Counter(len(v) for _, v in fine)
    dim = min(sizes, key=lambda k: (-sizes[k], k))
    kept = [(i, tuple(max(-(2**60), min(2**60, math.floor(64 * float(np.float32(c))))) + 1_000_000 for c in v)) for i, v in fine if len(v) == dim]
    points = sorted({x for _, x in kept})
    n = len(points)
    sums = [sum(p[k] for p in points) for k in range(dim)]
    centred = [[n * p[k] - sums[k] for k in range(dim)] for p in points]
    cov = [[Fraction(sum(c[i] * c[j] for c in centred), n**3) for j in range(dim)] for i in range(dim)]
    deviation = [sum((n * x[k] - sums[k]) ** 2 for k in range(dim)) for _, x in kept]
    return kept, deviation, points, n, sums, cov


def check(spark, rows: list[tuple], same_shape: bool = True) -> None:
    kept, deviation, points, n, sums, cov = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = whitening.whitened(df)
    got = out.collect()
    shown = lambda d: None if d is None or d >= 10**38 else int(d)
    text = lambda values: sorted(map(str, values))
    assert text((r.vec_id, r.n, shown(r.deviation)) for r in got) == text((i, n, shown(d)) for (i, _), d in zip(kept, deviation))
    v = np.array([[float(c) for c in row] for row in cov])
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    top = min(16, len(sums))
    usable = e[:top] > len(e) * np.finfo(float).eps * e[0]
    assert all(len(r.whitened) == top for r in got)
    trace = sum(float(cov[k][k]) for k in range(len(sums)))
    np.testing.assert_allclose(got[0].explained, e[:top] / trace, rtol=1e-9, atol=1e-15)
    assert got[0].identity_error < 1e-4
    for r in got:
        assert [w is not None for w in r.whitened] == usable.tolist()
    # Distances along each axis are free of its sign.
    mine = sorted((str(r.vec_id), str(shown(r.deviation)), *[round(abs(w), 6) for w, ok in zip(r.whitened, usable) if ok]) for r in got)
    plain = []
    for (i, x), d in zip(kept, deviation):
        y = np.array([float(Fraction(n * x[k] - sums[k], n)) for k in range(len(sums))]) @ axes[:, :top]
        plain.append((str(i), str(shown(d)), *[round(abs(a / math.sqrt(b)), 6) for a, b, ok in zip(y, e, usable) if ok]))
    for a, b in zip(mine, sorted(plain)):
        assert a[:2] == b[:2]
        np.testing.assert_allclose(a[2:], b[2:], rtol=1e-4, atol=1e-5)


def normal_rows(n: int, dim: int, scale: float = 0.3) -> list[tuple]:
    draw = np.random.default_rng(n)
    mix = draw.normal(size=(dim, dim))
    return [(i, [float(c) for c in draw.normal(size=dim) @ mix * scale], *EXTRA) for i in range(n)]


def odd(rows: list[tuple]) -> list[tuple]:
    one, nan, inf = rows[0][1], float("nan"), float("inf")
    more = [None, [], [nan] + one[1:], [None] + one[1:], [-inf] + one[1:], one[1:], one, one]
    return [*rows, *[(i, v, *EXTRA) for i, v in zip((900, 901, 902, 903, 904, 905, None, 7), more)]]


def test_whitened_rows_equal_numpy(spark):
    check(spark, odd(normal_rows(300, 20)))


def test_fewer_dimensions_than_components(spark):
    check(spark, odd(normal_rows(80, 5)))


def test_large_entries_use_exact_integers(spark):
    rows = normal_rows(60, 4, 1e13)
    check(spark, rows)
    check(spark, [*rows, (61, [3e38, -3e38, 0.0, 1.0], *EXTRA)])


def test_dimension_without_variance_has_no_coordinate(spark):
    rows = [(i, [*v[:3], 1.0], *EXTRA) for i, v, *_ in normal_rows(50, 4)]
    out = whitening.by_component(whitening.whitened(spark.createDataFrame(rows, SCHEMA)))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.groupBy("component").agg({"whitened": "count", "vec_id": "count"}).orderBy("component").collect()
    assert [tuple(r) for r in got] == [(1, 50, 50), (2, 50, 50), (3, 50, 50), (4, 0, 50)] or [r[1] for r in got] == [50, 50, 50, 0]


def test_equal_rows_only(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], *EXTRA), (2, [1.0, 2.0], *EXTRA), (2, [1.001, 2.0], *EXTRA)], SCHEMA)
    got = whitening.by_component(whitening.whitened(df)).collect()
    assert len(got) == 6
    assert {tuple(r)[2:] for r in got} == {(1, 0, None, None, None)}


@pytest.mark.parametrize("rows", [[], [(1, None, *EXTRA), (2, [], *EXTRA)]])
def test_no_usable_rows(spark, rows):
    out = whitening.by_component(whitening.whitened(spark.createDataFrame(rows, SCHEMA)))
    assert out.count() == 0 and "identity_error" in out.columns


def test_squares_are_exact():
    d = np.array([[2**52 - 1, -(2**52) + 3], [-(2**40), 12345]] * 100, dtype=np.int64)
    high, middle, low = whitening.squares(d)
    got = [(int(h) << 54) + (int(m) << 28) + int(lo) for h, m, lo in zip(high, middle, low)]
    assert got == [sum(int(v) ** 2 for v in d[:, k]) for k in range(2)]
