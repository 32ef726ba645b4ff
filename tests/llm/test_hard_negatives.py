import math

import numpy as np
import pytest

from tidegraph.llm import hard_negatives as hn
from tidegraph.llm import queries


def brute(rows, every=100, positives=5, negatives=10):
    """By the definition, in whole numbers; rows: (id, label, vector)."""
    rows = [(i, y, [math.floor(256 * float(x)) for x in v]) for i, y, v in rows]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    out = []
    for k, (i, y, v) in enumerate(rows):
        if i % every:
            continue
        scores = sorted(((-dot(v, w), j, z, n) for n, (j, z, w) in enumerate(rows) if n != k), key=lambda s: (s[0], s[1], s[3]))
        for p, j, _, _ in [s for s in scores if s[2] == y][:positives]:
            hits = [(-s, m) for s, m, z, _ in scores if z != y and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(i, j, rank, m, -p, s) for rank, (s, m) in enumerate(hits, 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, y, v, 1, "x") for i, y, v in rows], "vec_id long, label int, embedding array<double>, rank int, node string")


@pytest.mark.parametrize(("cell", "block", "group"), [(1024, 8192, 256), (20, 60, 4)])
def test_clusters_copies_and_ties(spark, monkeypatch, cell, block, group):
    """A third of the rows are copies of one vector; the rest are clusters, so that nodes are passed over."""
    for name, value in (("CELL_ROWS", cell), ("BLOCK_ROWS", block), ("GROUP_ROWS", group)):
        monkeypatch.setattr(hn, name, value)
    r = np.random.default_rng(1)
    centres = r.normal(size=(8, 6))
    rows = [(i, i % 4, [0.5, -0.25, 0.5, 0.125, 0.0, 1.0]) for i in range(0, 900, 3)]
    rows += [(i, int(r.integers(0, 4)), (centres[i % 8] + 0.1 * r.normal(size=6)).tolist()) for i in range(900) if i % 3]
    got = rows_of(hn.mine(frame(spark, rows), every=20, sample_rows=150))
    assert got == brute(rows, 20) and len({x[0] for x in got}) > 30


def test_odd_rows(spark):
    good = [(i, i % 3, [0.1 * i, 1.0 - 0.03 * i, 0.3]) for i in range(60)]
    odd = [(200, None, [1.0, 1.0, 1.0]), (300, 1, None), (400, 1, [1.0, None, 0.0]), (500, 1, [math.nan, 1.0, 0.0]), (600, 1, [math.inf, 1.0, 0.0]), (700, 1, [1.0]), (800, 1, []), (None, 1, [1.0, 1.0, 1.0]), (900, 1, [1e200, 0.0, 0.0])]
    zero = [(61, 2, [0.0, 0.0, 0.0])]
    want = brute(good + zero, 20)
    assert rows_of(hn.mine(frame(spark, good + odd + zero), every=20)) == want and want
    again = [(20, 1, [0.2, 0.4, 0.3]), (20, 2, [1.0, 1.0, 0.0]), (21, 0, [2.0, 0.4, 0.3])]  # rows of their own
    assert rows_of(hn.mine(frame(spark, good + again + again), every=20)) == brute(good + again + again, 20)


def test_long_vectors_are_exact(spark):
    """Sums beyond 2**53, which doubles would round."""
    r = np.random.default_rng(2)
    rows = [(i, i % 2, (2.0**20 + r.integers(0, 1 << 20, 4) / 256).tolist()) for i in range(80)]
    got = rows_of(hn.mine(frame(spark, rows), every=20, least=0, most=100))
    assert got and max(x[5] for x in got) > 1 << 57
    by = {i: [math.floor(256 * x) for x in v] for i, _, v in rows}
    assert all(x[5] == sum(a * b for a, b in zip(by[x[0]], by[x[3]], strict=True)) for x in got)


def test_small_tables(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.5, 0.0]), (3, 2, [1.0, 0.0])]
    assert rows_of(hn.mine(frame(spark, rows))) == brute(rows) != []
    assert hn.mine(frame(spark, rows[:1])).count() == 0 and hn.mine(frame(spark, rows).limit(0)).count() == 0
    assert hn.mine(frame(spark, rows[1:])).count() == 0  # no anchor
    alone = [(0, 1, [1.0, 0.0]), (2, 2, [0.5, 0.0])]
    assert hn.mine(frame(spark, alone)).count() == 0  # no positive


def test_bounds_hold():
    r = np.random.default_rng(3)
    a, b = r.normal(size=(50, 5)) + 1, r.normal(size=(70, 5)) * 3
    (ca, ra), (cb, rb) = hn.ball(a), hn.ball(b)
    lo, hi = hn.interval(ca, ra, cb[None], np.array([rb]))
    s = a @ b.T
    assert lo[0] <= s.min() and hi[0] >= s.max()
    lo, hi = hn.interval_rows(a, cb, rb)
    assert (lo <= s.min(axis=1)).all() and (hi >= s.max(axis=1)).all()


def test_whole_query(spark, sf_dir):
    table = [r for r in queries.table(spark, sf_dir, "embeddings").collect() if r.label is not None and r.embedding is not None]
    table = [r for r in table if all(x is not None and math.isfinite(x) for x in r.embedding)]
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in table]
    assert rows_of(queries.op13_hard_negatives(spark, sf_dir)) == brute(rows)
