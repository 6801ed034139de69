import math

import numpy as np
import pytest

from strandloom.llm import multi_index as M

ROWS = "vec_id long, embedding array<float>, label int, node string"


def vectors(seed=0, n=260, dims=12):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((6, dims)) * 2
    rows, k = [], 0
    while k < n:
        v = centres[k % 6] + draw.standard_normal(dims)
        for _ in range(draw.integers(1, 6)):
            rows.append((k, [float(x) for x in v + draw.standard_normal(dims) * draw.choice([0.0, 0.1, 0.35])], 1, "n"))
            k += 1
    hot = [float(x) for x in draw.standard_normal(dims)]
    rows += [(1000 + i, hot, 2, "n") for i in range(40)] + [(2000, [2 * x for x in hot], 2, "n")]
    nan, inf = float("nan"), float("inf")
    rows += [(3000, None, 0, "n"), (3001, [0.0] * dims, 0, "n"), (3002, [nan] + [1.0] * (dims - 1), 0, "n"), (3003, [inf] + [1.0] * (dims - 1), 0, "n"), (3004, [None] + [1.0] * (dims - 1), 0, "n"), (3005, [1.0], 0, "n"), (None, hot, 0, "n"), (1000, hot, 0, "n"), (3006, [1e-30 * x for x in hot], 0, "n"), (3007, [], 0, "n")]
    return rows


def brute(rows, threshold=0.9):
    ok = [i for i, r in enumerate(rows) if r[1] and len(r[1]) == 12 and all(x is not None and math.isfinite(x) for x in r[1]) and any(np.float32(x) for x in r[1])]
    x = np.array([np.array(rows[i][1], dtype=np.float32).astype(float) for i in ok])
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    parent = {i: i for i in range(len(rows))}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in zip(*np.nonzero(linked), strict=True):
        parent[max(find(ok[a]), find(ok[b]))] = min(find(ok[a]), find(ok[b]))
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), 1 << 60), r[0])
    degree = dict(zip(ok, linked.sum(1).tolist(), strict=True))
    return sorted((str(r[0]), degree.get(i, 0), low[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("recall,block", [(0.9995, 1024), (1.0, 16)])
def test_against_brute_force(spark, monkeypatch, recall, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = vectors()
    got = M.near_vectors(spark.createDataFrame(rows, ROWS), recall=recall, codewords=5).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_walk_is_by_bound_and_complete():
    draw = np.random.default_rng(5)
    x = draw.standard_normal((500, 8))
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    index = M.MultiIndex.fit(x, 4, math.sqrt(0.4), 1)
    own, walks = index.cells(x)
    near = x @ x.T >= 0.8
    for i in range(0, 500, 7):
        assert walks[i][0] == own[i] and len(set(walks[i])) == len(walks[i])
        assert set(own[near[i]].tolist()) <= set(walks[i])


def test_small_tables(spark):
    assert M.near_vectors(spark.createDataFrame([], ROWS)).count() == 0
    one = M.near_vectors(spark.createDataFrame(vectors()[:1], ROWS)).first()
    assert (one["n_links"], one["component_id"], one["kept"]) == (0, 0, True)
    same = M.near_vectors(spark.createDataFrame([(5, [1.0, 2.0], 0, ""), (3, [1.0, 2.0], 0, "")], ROWS)).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in same} == {(5, 1, 3), (3, 1, 3)}
