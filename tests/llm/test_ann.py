import math

import numpy as np
import pytest

from tidegraph.llm import ann, queries


def brute(rows, k, every):
    """(query, rank): (distance, id), comparing everything; rows: (id, vector) pairs, or a dict of them."""
    rows = list(rows.items()) if isinstance(rows, dict) else rows
    ids = np.array([i for i, _ in rows])
    x = np.array([np.asarray(v, float) for _, v in rows])
    out = {}
    for q in sorted({int(i) for i in ids if i % every == 0}):
        best = {}
        for own in x[ids == q]:
            d = np.sqrt(((x - own[None, :]) ** 2).sum(axis=1))
            for j in np.argsort(d, kind="stable")[: len(d) if len(d) < 3000 else 20 * k].tolist():
                if ids[j] != q:
                    best[int(ids[j])] = min(best.get(int(ids[j]), np.inf), float(d[j]))
        for rank, hit in enumerate(sorted((d, i) for i, d in best.items())[:k], 1):
            out[q, rank] = hit
    return out


def recall(got, want):
    hits = {(q, i) for (q, _), (_, i) in want.items()}
    return len(hits & {(r.query_id, r.vec_id) for r in got}) / len(hits)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_recall_and_scores(spark, sf):
    table = queries.table(spark, f"/root/testdata/{sf}", "embeddings").collect()
    rows = {r.vec_id: np.array(r.embedding, float) for r in table}
    got = queries.op9_ann(spark, f"/root/testdata/{sf}").collect()
    want = brute(rows, 10, 100)
    assert recall(got, want) >= 0.9 and len(got) == len(want)
    by = {}
    for r in got:
        assert r.score == pytest.approx(math.dist(rows[r.query_id], rows[r.vec_id]), abs=1e-12)
        by.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    for hits in by.values():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 11)) and [h[1:] for h in hits] == sorted(h[1:] for h in hits)


def test_copies_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    r = np.random.default_rng(2)
    rows = {i: [1.0, 2.0, 3.0, 4.0] for i in range(300)} | {i: r.normal(size=4).tolist() for i in range(300, 500)}
    odd = [(1000, None), (1001, [0.0] * 4), (1002, [1.0, None, 0.0, 0.0]), (1003, [math.nan, 1.0, 0.0, 0.0]), (1004, [math.inf, 1.0, 0.0, 0.0]), (1005, [1.0, 2.0]), (1006, []), (None, [1.0, 2.0, 3.0, 4.0]), (0, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in [*rows.items(), *odd]], "vec_id long, embedding array<double>, id int, rank int")
    got = ann.search(df, success=0.99).collect()
    want = brute({i: np.array(v) for i, v in rows.items()}, 10, 100)
    assert {r.query_id for r in got} == {0, 100, 200, 300, 400} and recall(got, want) >= 0.95
    assert [x.vec_id for x in sorted((x for x in got if x.query_id == 100), key=lambda x: x["rank"])] == list(range(10))


def test_repeated_ids_and_mostly_copies(spark, monkeypatch):
    """Ids with several vectors keep all of them; two groups of copies of a third each don't narrow the search of the others."""
    r = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(0, 700)] + [(i, [-4.0, 2.0, 1.0, 9.0]) for i in range(700, 1400)]
    rows += [(i, r.normal(size=4).tolist()) for i in range(1400, 2000)] + [(i, r.normal(size=4).tolist()) for i in range(1400, 2000, 50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = ann.search(df).collect(), brute(rows, 10, 100)
    lone = {k: v for k, v in want.items() if k[0] >= 1400}
    assert len({r.query_id for r in got}) == 20 and len(lone) == 60
    assert recall([r for r in got if r.query_id >= 1400], lone) >= 0.9
    assert all(len({r.vec_id for r in got if r.query_id == q}) == 10 for q in range(0, 2000, 100))


def test_small_tables(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [1.0, 1.0]), (200, [-1.0, -1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(df).collect())
    assert got == [(100, 1, 8), (100, 2, 7), (100, 3, 200), (200, 1, 7), (200, 2, 100), (200, 3, 8)]
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.filter("vec_id = 100")).count() == 0


def test_short_queries_are_compared_with_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 2)
    r = np.random.default_rng(3)
    rows = {i: r.normal(size=3).tolist() for i in range(0, 900, 3)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "OCCUPANCY", 1)
    got = ann.search(df, tables=1, success=1e-6).collect()  # one bucket a query
    counts = {}
    for x in got:
        counts[x.query_id] = counts.get(x.query_id, 0) + 1
    assert set(counts.values()) == {10} and len(counts) == 3


def test_probes_come_in_order_of_success():
    t = ann.fit(np.random.default_rng(4).normal(size=(500, 8)), 10**5, 10, tables=2, success=0.8)
    place = t.places(np.ones((1, 8)))[0, 0]
    found = t.probes(place)
    assert found[0] == tuple(np.floor(place).astype(int)) and len(found) == len(set(found))
    sigma = t.near / t.width
    cdf = lambda z: 0.5 * (1 + math.erf(z / (sigma * math.sqrt(2))))
    chance = [math.prod(cdf(b + 1 - p) - cdf(b - p) for b, p in zip(bucket, place, strict=True)) for bucket in found]
    assert chance == sorted(chance, reverse=True) and sum(chance) >= 1 - 0.2**0.5
