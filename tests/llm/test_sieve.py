"""The sieve of the Jaccard join."""

from __future__ import annotations

import pyarrow as pa

from ledgerlark.llm import jaccard


def test_classes_with_equal_low_bits():
    """Classes are told apart by all 64 bits, also where the highest one is set."""
    one, two, three = 5, 5 + (1 << 48), 5 - (1 << 63)
    rows = [(1, one, 0), (1, two, 0), (2, three, 0), (2, one, 0), (3, two, 0), (9, three, 4)]
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(2)] + [pa.array([r[2] for r in rows], pa.int32())]
    batch = pa.RecordBatch.from_arrays(columns, names=["token", "node", "known"])
    got = {}
    for out in jaccard._shared_counts(iter([batch])):
        for node, hits in zip(*(c.to_pylist() for c in out.columns)):
            got[node] = got.get(node, 0) + hits
    assert got == {one: 2, two: 1, three: 5}
