import numpy as np
import pytest

from quillon.llm import vectordedup as V

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, vec string"


def brute(rows):
    """Links and components by comparing all pairs."""
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.asarray(v, float)
        return x / np.linalg.norm(x)

    units = [unit(r[1]) for r in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(units):
        for j, b in enumerate(units):
            if i != j and a is not None and b is not None and len(a) == len(b) and rows[i][2] is not None and rows[i][2] == rows[j][2] and a @ b >= V.THRESHOLD:
                links[i] += 1
                x, y = sorted((find(i), find(j)), key=lambda k: (rows[k][0], k))
                root[y] = x
    return sorted((r[0], links[i], rows[find(i)][0]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("cell", "block"), [(2048, 2048), (16, 7)])
def test_against_all_pairs(spark, monkeypatch, cell, block):
    monkeypatch.setattr(V, "CELL", cell)
    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = []
    base = rng.normal(size=(12, 8))
    for i in range(150):
        v = base[i % 12] + rng.normal(scale=0.07 if i % 3 else 0.6, size=8)
        rows.append((1000 - i, [float(np.float32(x)) for x in v], i % 2, "x", "y"))
    rows += [(2000 + i, rows[3][1], rows[3][2], "copy", None) for i in range(5)]
    rows += [(3000, None, 1, None, None), (3001, [0.0] * 8, 1, None, None), (3002, [float("nan")] * 8, 1, None, None), (3003, [1.0, None], 1, None, None), (3004, rows[0][1], None, None, None), (3005, [1.0, 0.0], 1, None, None), (3006, [2.0, 0.0], 1, None, None), (3007, [float("inf")] * 8, 0, None, None)]
    found = V.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_rows_with_null_ids_and_no_rows(spark):
    rows = [(None, [1.0, 0.0], 1, None, None), (7, [1.0, 0.0], 1, None, None), (7, [1.0, 0.0], 1, None, None)]
    found = V.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in found) == [(0, 0, None), (7, 1, 7), (7, 1, 7)]
    assert V.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
