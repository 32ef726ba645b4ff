import random

import numpy as np

from tests.helpers import closure_components, random_edges
from tidegraph.operators import kernel


def test_solve_equals_closure():
    for seed in range(300):
        r = random.Random(seed)
        edges = random_edges(r, r.randint(1, 9), r.randint(1, 16))
        s, t = np.array(edges, np.int64).T
        out = kernel.solve(s, t).to_pydict()
        of = closure_components({x for e in edges for x in e}, edges)
        assert dict(zip(out["id"], out["component"], strict=True)) == of
        rank, level = (dict(zip(out["id"], out[k], strict=True)) for k in ("rank", "level"))
        for a, b in edges:
            assert of[a] == of[b] and rank[a] == rank[b] or rank[a] > rank[b] and level[a] > level[b]


def test_long_paths_and_one_large_cycle():
    n = 200_000
    path = np.arange(n)
    out = kernel.solve(path[:-1], path[1:])
    assert out["level"].to_numpy()[0] == n - 1 and len(set(out["component"].to_pylist())) == n
    ring = kernel.solve(path, np.roll(path, -1))
    assert set(ring["component"].to_pylist()) == {0}


def test_reached():
    s, t = np.array([1, 2, 5]), np.array([2, 3, 6])
    assert kernel.reached(s, t, np.array([2, 9])).tolist() == [2, 3, 9]
    assert kernel.reached(s[:0], t[:0], s[:0]).tolist() == []
