import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import closure_components, parts, random_edges
from tidegraph.functions import edges as fe
from tidegraph.functions.order import first_rows, numbered
from tidegraph.operators import incremental as inc
from tidegraph.operators import kernel, replay, scc
from tidegraph.operators import time_coupled as tc
from tidegraph.operators.replay import GM, Replay
from tidegraph.plans import catalog, registry
from tidegraph.sources import graphs

YEARS = {0: 2000, 1: 2000, 2: 2000, 3: 2001, 4: 2001, 5: 2001, 6: 2002, 7: 2002, 8: 2003, 9: 2003, 10: 2004, 11: 2004}
START = [(0, 1), (1, 0), (1, 2), (3, 0), (3, 4), (4, 5), (2, 3), (6, 7), (6, 2), (8, 6), (8, 9), (9, 8), (10, 8), (11, 10), (10, 9)]
DELTA = [(5, 3), (9, 7), (7, 6), (10, 11), (0, 8), (2, 5), (11, 2), (1, 6)]


def frames(spark, year, edges):
    return spark.createDataFrame(list(year.items()), "id long, year long"), spark.createDataFrame(edges, "src long, dst long")


def pairs(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


@pytest.fixture
def graph(spark):
    r = random.Random(7)
    year = {v: 2000 + v // 12 for v in range(60)}
    edges = sorted({(a, b) for a, b in random_edges(r, 60, 110) if a != b})
    return year, edges, *frames(spark, year, edges)


@pytest.mark.parametrize("most", [2_000_000, 5])
def test_components_parts_and_levels(graph, monkeypatch, most):
    """With a small bound, everything runs distributed."""
    monkeypatch.setattr(kernel, "LOCAL_ROWS", most)
    year, edges, nodes, df = graph
    want = closure_components(year, edges)
    members = scc.with_all(nodes, scc.scc(df))
    assert pairs(members, "id", "component") == set(want.items())
    part = parts(year, edges)
    assert pairs(tc.partition(nodes, df), "id", "part") == set(part.items())
    assert pairs(tc.tc_scc(nodes, df), "id", "component") == {(v, c) for v, c in want.items() if part[v] != "gr"}
    rank = dict(pairs(numbered(scc.levels(members, scc.condensed(df, members)), "level", "component", name="rank"), "component", "rank"))
    assert sorted(rank.values()) == list(range(1, len(set(want.values())) + 1))
    assert all(want[a] == want[b] or rank[want[a]] > rank[want[b]] for a, b in edges)


def test_backward_decomposition_finds_the_same_cycles(graph):
    year, edges, nodes, df = graph
    want = closure_components(year, edges)
    got = dict(pairs(registry.static_members("tc_kosaraju", nodes, df), "id", "component"))
    size = lambda c: sum(x == c for x in want.values())
    assert all(want[v] == c for v, c in got.items()) and all(v in got for v, c in want.items() if size(c) > 1)


def test_walk_through(spark):
    """Single edges, as one replay; then the same increment in batches of three, distributed."""
    nodes, start = frames(spark, YEARS, START)
    delta = spark.createDataFrame([(i, *e) for i, e in enumerate(DELTA)], "seq long, src long, dst long")
    rows = inc.maintained(nodes, start, delta, batch=1, cuts=list(range(len(DELTA) + 1))).collect()
    for cut in range(len(DELTA) + 1):
        got = {r.id: r.component for r in rows if r["cut"] == cut and r.id is not None}
        assert got == closure_components(YEARS, START + DELTA[:cut]), cut
    assert sum(r.inserted or 0 for r in rows) == 6  # of eight, two lie inside a component
    state = inc.start(nodes, start)
    for batch in inc.batches(delta, 3, len(DELTA)):
        state, _ = inc.apply_batch(state, batch)
        assert inc.violations(state).first().violations == 0
    assert pairs(state.members, "id", "component") == set(closure_components(YEARS, START + DELTA).items())
    assert parts(YEARS, START + DELTA[:4])[11] == "gsi" and parts(YEARS, START + DELTA)[8] == "gm"


def check_replay(r, year, edges):
    """Components, parts, and ranks inside spaces."""
    want, part = closure_components(year, edges), parts(year, edges)
    of = {i: r.of[r.index[i]] for i in r.ids}
    assert {i: r.name[c] for i, c in of.items()} == want
    if r.coupled:
        assert {i: r.part(r.index[i]) for i in r.ids} == part
    for a, b in edges:
        x, y = of[a], of[b]
        if x != y and r.space.get(x) is not None and r.space.get(x) == r.space.get(y):
            assert r.rank[x] > r.rank[y]
    assert len({(r.space[c], r.rank[c]) for c in r.rank}) == len(r.rank) == len(r.space)
    for at, order in r.orders.items():
        chain, c = [], order.first
        while c is not None:
            chain.append(c)
            assert order.down[c] == (chain[-2] if len(chain) > 1 else None)
            c = order.up[c]
        assert chain == sorted((c for c in r.space if r.space[c] == at), key=r.rank.__getitem__) and order.last == (chain[-1] if chain else None)


@pytest.mark.parametrize("coupled", [False, True])
@pytest.mark.parametrize(("search", "settling"), [("two-way", "single"), ("both", "single"), ("forward", "single"), ("two-way", "islands"), ("two-way", "rounds"), ("both", "rounds")])
def test_replay_equals_recomputation(coupled, search, settling, monkeypatch):
    """Random graphs and batches; the state at the start is made by inserting, too. Some ids turn up late. Gaps are narrow, so that labels run out."""
    monkeypatch.setattr(replay, "GAP", 3)
    for seed in range(120):
        r = random.Random(seed)
        n = 16
        year = {v: r.choice([0, 1990 + v // 4]) if v > 12 else 1990 + v // 4 for v in range(n)}
        known = [v for v in range(n) if year[v]]
        edges, size = [(a, b) for a, b in random_edges(r, n, 35) if a != b], r.choice([1, 2, 5, 35])
        ids = np.array(known)
        first = Replay(ids, ids, [None if coupled else GM] * len(ids), list(range(1, len(ids) + 1)), np.array([year[v] for v in known]), ids[:0], ids[:0], coupled=coupled, search=search, settling=settling)
        for at in range(0, len(edges), size):
            a, b = zip(*edges[at : at + size], strict=True)
            first.insert(list(a), list(b))
            now = edges[: at + size]
            seen = set(known) | {x for e in now for x in e}
            check_replay(first, {v: year[v] for v in seen}, now)


def test_searches_stay_between_the_ranks():
    """A long path above and below is not looked at."""
    n = 4000
    ids = np.arange(n)
    for search, visited in (("both", 8), ("forward", 4), ("two-way", 4)):
        r = Replay(ids, ids, [GM] * n, list(range(1, n + 1)), np.zeros(n, int), ids[1:], ids[:-1], search=search)
        r.insert([2000], [2003])
        assert r.counts.merged == 3 and r.counts.visited == visited


def test_two_way_search_stops_where_it_meets():
    """A head that leads to much, and a tail that little leads to: the search takes about what the smaller side has."""
    n, wide = 5000, 4000
    ids = np.arange(n)
    # 0 is the tail; 1 .. wide are led to by the head, n - 1
    src, dst = np.full(wide, n - 1), np.arange(1, wide + 1)
    for search, most in (("both", 10**6), ("two-way", 10)):
        r = Replay(ids, ids, [GM] * n, list(range(1, n + 1)), np.zeros(n, int), src, dst, search=search)
        r.insert([0], [n - 1])
        assert r.rank[0] > r.rank[n - 1] and all(r.rank[n - 1] > r.rank[v] for v in range(1, wide + 1))
        assert r.counts.visited <= most and (search != "both" or r.counts.visited > wide)


def test_batches_visit_less_than_single_edges():
    """Islands take one search, whatever the number of their edges."""
    n = 200
    ids = np.arange(2 * n)
    path = [(v, v - 1) for v in range(1, 2 * n) if v != n]  # two paths, and edges from the lower to the upper one
    edges = [(n - k, n + k - 1) for k in range(1, n + 1)]
    counts = {}
    for settling, size in (("single", 1), ("islands", n), ("rounds", n)):
        edges = edges[::-1] if settling == "rounds" else edges  # the widest first
        r = Replay(ids, ids, [GM] * 2 * n, list(range(1, 2 * n + 1)), np.zeros(2 * n, int), *(np.array(x) for x in zip(*path, strict=True)), search="both", settling=settling)
        for at in range(0, len(edges), size):
            r.insert(*(list(x) for x in zip(*edges[at : at + size], strict=True)))
        counts[settling] = r.counts
        check_replay(r, {v: 0 for v in range(2 * n)}, path + edges)
    assert counts["islands"].visited * 5 <= counts["single"].visited and counts["islands"].islands == 1
    assert (counts["rounds"].rounds, counts["rounds"].deferred, counts["rounds"].invalid) == (1, n - 1, 1)  # the others wait, and lead downward by then


def test_labels_run_out_and_are_made_anew(monkeypatch):
    monkeypatch.setattr(replay, "GAP", 2)
    rank, rnd = {}, random.Random(2)
    order, want = replay.Order(rank), []
    for c in range(3000):
        at = rnd.randint(0, len(want)) if c % 3 else min(len(want), 1)
        order.insert(want[at - 1] if at else None, [c])
        want.insert(at, c)
        if c % 7 == 0:
            gone = want.pop(rnd.randrange(len(want)))
            order.remove(gone)
    assert sorted(rank, key=rank.__getitem__) == want and len(set(rank.values())) == len(want)
    some = sorted(rnd.sample(range(len(want)), 200))
    new = [want[i] for i in some]
    rnd.shuffle(new)
    order.deal([want[i] for i in some], new)
    for i, c in zip(some, new, strict=True):
        want[i] = c
    assert sorted(rank, key=rank.__getitem__) == want
    c, chain = order.first, []
    while c is not None:
        chain.append(c)
        c = order.up[c]
    assert chain == want


@pytest.mark.parametrize(("most", "coupled"), [(2_000_000, False), (2_000_000, True), (60, False), (60, True)])
def test_batches_as_sets_and_unlisted_ids(spark, monkeypatch, most, coupled):
    """Two batches; some ids are listed nowhere, and have year 0 in all paths."""
    monkeypatch.setattr(kernel, "LOCAL_ROWS", most)
    r = random.Random(5)
    year = {v: 2000 + v // 8 for v in range(40)}
    everyone = year | {v: 0 for v in range(40, 46)}
    edges = [(a, b) for a, b in random_edges(r, 46, 90) if a != b]
    nodes, df = frames(spark, year, edges[:45])
    state = inc.start(nodes, df, coupled=coupled)
    for at in range(45, 90, 23):
        state, counts = inc.apply_batch(state, spark.createDataFrame(edges[at : at + 23], "src long, dst long"))
        now = edges[: at + 23]
        seen = {v: everyone[v] for v in set(year) | {x for e in now for x in e}}
        assert pairs(state.members, "id", "component") == set(closure_components(seen, now).items())
        assert inc.violations(state).first().violations == 0
        if coupled:
            assert pairs(state.parts, "id", "part") == set(parts(seen, now).items())
    assert pairs(registry.static_members("tarjan", nodes, spark.createDataFrame(edges, "src long, dst long")), "id", "component") == set(closure_components(seen, edges).items())
    delta = spark.createDataFrame([(i, *e) for i, e in enumerate(edges[45:])], "seq long, src long, dst long")
    rows = inc.maintained(nodes, df, delta, batch=15, cuts=[20, 45], coupled=coupled).filter("id is not null and cut = 1")
    assert pairs(rows, "id", "component") == set(closure_components(seen, edges).items())
    if coupled:
        assert pairs(rows, "id", "part") == set(parts(seen, edges).items())


@pytest.mark.parametrize("settling", ["single", "islands", "rounds"])
def test_replay_apart_counts_as_one_task(spark, monkeypatch, settling):
    """Islands that are replayed in parallel do the same, edge for edge, as one task does; one of the nodes is new."""
    r = random.Random(8)
    n = 120
    year = {v: 2000 for v in range(n)}
    edges = sorted({(a, b) for a, b in random_edges(r, n, 110) if a > b})
    new = [(a, min(n, a + r.randint(1, 6))) for a in r.sample(range(n), 30)] + [(a, b) for a, b in random_edges(r, n, 10) if a > b]
    r.shuffle(new)
    nodes, df = frames(spark, year, edges)
    delta = spark.createDataFrame([(i, *e) for i, e in enumerate(new)], "seq long, src long, dst long")
    runs = []
    for most in (2_000_000, 150):
        monkeypatch.setattr(kernel, "LOCAL_ROWS", most)
        runs.append(inc.maintained(nodes, df, delta, batch=1 if settling == "single" else 7, cuts=[14, len(new)], search="both", settling=settling).collect())
    names = [f for f in replay.Counts.__dataclass_fields__ if not f.endswith("seconds") and f != "rounds"]  # each island has rounds of its own
    one, apart = ([{k: x[k] for k in ["cut", *names]} for x in rows if x.id is None] for rows in runs)
    assert sorted(one, key=lambda x: x["cut"]) == sorted(apart, key=lambda x: x["cut"]) and one[1]["invalid"] > 3
    assert {(x["cut"], x.id, x.component) for x in runs[0]} == {(x["cut"], x.id, x.component) for x in runs[1]}


def test_sweep_over_years(spark, monkeypatch):
    """A chain through five years takes a step a year, and finds what a search does; with a small bound, also within a year."""
    n = 2000
    year = {v: 2005 - v // (n // 5) for v in range(n)}  # newest first
    chain = [(v, v + 1) for v in range(n - 1)] + [(n - 1, 0)]  # the last edge leads from the oldest year to the newest
    nodes, df = frames(spark, year, chain)
    monkeypatch.setattr(kernel, "LOCAL_ROWS", 1000)
    steps = []
    real = scc.reach
    monkeypatch.setattr(tc, "reach", lambda *a: steps.append(1) or real(*a))
    assert tc.gm(tc.classes(nodes, df)).count() == n
    assert len(steps) <= 5 + 1
    r = random.Random(3)
    year = {v: 2000 + v // 10 for v in range(60)}
    edges = sorted({(a, b) for a, b in random_edges(r, 60, 90) if a != b and (a > b or r.random() < 0.2)})
    nodes, df = frames(spark, year, edges)
    monkeypatch.setattr(kernel, "LOCAL_ROWS", 30)
    want = {v for v, p in parts(year, edges).items() if p == "gm"}
    assert {x.id for x in tc.gm(tc.classes(nodes, df)).collect()} == want and 0 < len(want) < 60


def test_sweep_takes_years_together(spark, monkeypatch):
    """A chain through forty years, of which a task holds ten or so: steps count tasks' worth of edges, not years."""
    n = 2000
    nodes, df = frames(spark, {v: 2040 - v // 50 for v in range(n)}, [(v, v + 1) for v in range(n - 1)] + [(n - 1, 0)])
    monkeypatch.setattr(kernel, "LOCAL_ROWS", 600)
    steps = []
    real = scc.reach
    monkeypatch.setattr(tc, "reach", lambda *a: steps.append(1) or real(*a))
    assert tc.gm(tc.classes(nodes, df)).count() == n
    assert len(steps) <= 6


def test_long_paths_take_a_round_a_part(spark, monkeypatch):
    """A chain of 5,000 nodes in parts of 1,000 edges: rounds count parts, for what is reached, levels, and components."""
    n = 5000
    chain = [(v, v + 1) for v in range(n - 1)]
    df = spark.createDataFrame(chain, "src long, dst long")
    monkeypatch.setattr(kernel, "LOCAL_ROWS", 1000)
    rounds = []
    real = scc._carried
    monkeypatch.setattr(scc, "_carried", lambda *a: rounds.append(1) or real(*a))
    assert scc.reach(df, spark.createDataFrame([(0,)], "id long")).count() == n
    assert len(rounds) <= 10
    rounds.clear()
    names = spark.range(n + 1).select(F.col("id").alias("component"))
    assert pairs(scc.levels(names, df), "component", "level") == {(v, n - 1 - v) for v in range(n)} | {(n, 0)}
    assert len(rounds) <= 10
    rounds.clear()
    loops = [*chain, *((v + 1, v) for v in range(0, 200, 2)), (n - 1, n - 100)]
    got = dict(pairs(scc.scc_distributed(spark.createDataFrame(loops, "src long, dst long")), "id", "component"))
    assert got == {v: v - v % 2 if v < 200 else min(v, n - 100) for v in range(n)}
    assert len(rounds) <= 40  # of all colours and searches together


def test_cycles_inside_ranges_merge(spark, monkeypatch):
    """Rings inside ranges, rings across their borders, a hub, and a ring through rings far apart; names are smallest ids, also negative ones."""
    ring = lambda ids: list(zip(ids, [*ids[1:], ids[0]]))
    edges = [e for a in range(-200, 200, 8) for e in ring(list(range(a, a + 5)))] + ring([-196, 3, 100, 163]) + [(0, v) for v in range(-200, 200, 3)] + [(v, v + 3) for v in range(-200, 190, 8)]
    edges = [(a, b) for a, b in edges if a != b]
    src, dst = (np.array(x) for x in zip(*edges))
    want = {(x["id"], x["component"]) for x in kernel.solve(src, dst).to_pylist()}
    monkeypatch.setattr(kernel, "LOCAL_ROWS", 120)
    df = spark.createDataFrame(edges, "src long, dst long").distinct()
    left, went = scc.contracted(df, 0)
    half = dict(pairs(went, "id", "component"))
    assert len(half) > 150 and all(a > b for a, b in half.items()) and set(half.items()) <= {(a, b) for a in half for b in [half[a]] if (a, dict(want)[b]) in want}
    assert pairs(left, "src", "dst") == {(half.get(a, a), half.get(b, b)) for a, b in edges if half.get(a, a) != half.get(b, b)}
    assert pairs(scc.scc_distributed(df), "id", "component") == want


@pytest.mark.parametrize("gain", [0, 1])
def test_spread_equals_plain_rounds(spark, monkeypatch, gain):
    """Shuffled ids, so that paths change parts often; a hub whose edges fill several parts; repeated edges; starts that no edge knows."""
    r = random.Random(11)
    name = r.sample([k * 2**55 + k for k in range(-99, 99)], 80)
    edges = [(a, b) for a, b in random_edges(r, 79, 150) if a != b and (not gain or a < b)] + [(0, v) for v in range(1, 40)] * 2
    first = {v: r.randrange(-5, 5) for v in r.sample(range(80), 20)} | {79: 7}
    best = dict(first)
    for _ in range(80):
        for a, b in edges:
            if a in best:
                best[b] = max(best.get(b, best[a] + gain), best[a] + gain)
    monkeypatch.setattr(kernel, "LOCAL_ROWS", 20)
    got = scc.spread(spark.createDataFrame([(name[a], name[b]) for a, b in edges], "src long, dst long"), spark.createDataFrame([(name[v], x) for v, x in first.items()], "id long, value long"), gain)
    assert pairs(got, "id", "value") == {(name[v], x) for v, x in best.items()}


def test_mixed_ids_stay_apart(spark):
    ids = spark.createDataFrame([(x,) for x in (*range(-500, 500), 2**63 - 1, -(2**63), 2**32, 2**53 + 1)], "id long")
    both = ids.select("id", scc.mixed("id", 0).alias("a"), scc.mixed("id", 1).alias("b")).collect()
    assert len({x.a for x in both}) == len({x.b for x in both}) == len(both)
    assert sorted(both, key=lambda x: x.a) != sorted(both, key=lambda x: x.b)


def test_migrated_components_stand_above_what_they_lead_to(spark, monkeypatch):
    """One edge to a node outside a large Gm touches what lies between, and no more; where gaps are full, Gm gets new ranks."""
    n = 5000
    year = {v: 2000 for v in range(n)} | {n: 1999, n + 1: 2000, n + 2: 2000}
    nodes, df = frames(spark, year, [(n, 0), *((v, v + 1) for v in range(n - 1)), (n + 1, n - 10)])
    first = inc.start(nodes, df, coupled=True)
    state, counts = inc.apply_batch(first, spark.createDataFrame([(n - 5, n + 1)], "src long, dst long"))
    assert counts["migrated"] == 1 and 0 < counts["affected"] < 50 and inc.violations(state).first().violations == 0
    assert {r.component for r in state.members.filter(F.col("id").between(n - 10, n - 5) | (F.col("id") == n + 1)).collect()} == {n - 10}
    tight = inc.State(first.members, first.order.withColumn("rank", F.col("rank") / inc.GAP).withColumn("rank", F.col("rank").cast("long")), first.edges, first.parts)
    state, counts = inc.apply_batch(tight, spark.createDataFrame([(n - 20, n + 1), (n - 3, n + 2)], "src long, dst long"))
    assert counts["migrated"] == 2 and counts["affected"] < 50 and inc.violations(state).first().violations == 0


def test_next_above(spark):
    order = spark.createDataFrame([(x,) for x in (1, 5, 9, 40)], "rank long").repartition(3)
    wanted = spark.createDataFrame([(x,) for x in (0, 1, 4, 9, 39, 40, 99)], "at long")
    assert pairs(inc.next_above(order, wanted), "at", "following") == {(0, 1), (1, 5), (4, 5), (9, 40), (39, 40), (40, None), (99, None)}


def test_coupled_batches_distributed(spark, monkeypatch):
    nodes, start = frames(spark, YEARS, START)
    monkeypatch.setattr(kernel, "LOCAL_ROWS", 3)
    state = inc.start(nodes, start, coupled=True)
    state, _ = inc.apply_batch(state, spark.createDataFrame(DELTA, "src long, dst long"))
    assert inc.violations(state).first().violations == 0
    assert pairs(state.members, "id", "component") == set(closure_components(YEARS, START + DELTA).items())
    assert pairs(state.parts, "id", "part") == set(parts(YEARS, START + DELTA).items())


@pytest.mark.parametrize("most", [2_000_000, 2])
def test_large_ids_are_exact(spark, monkeypatch, most):
    monkeypatch.setattr(kernel, "LOCAL_ROWS", most)
    b = 2**53
    edges = spark.createDataFrame([(b + 1, b + 3), (b + 3, b + 5), (b + 7, b + 9)], "src long, dst long")
    assert {r.id for r in scc.reach(edges, spark.createDataFrame([(b + 1,)], "id long")).collect()} == {b + 1, b + 3, b + 5}


def test_numbers_and_first_rows(spark):
    df = spark.createDataFrame([(i % 3, (i * 7) % 50) for i in range(50)], "k long, v long")
    got = sorted((r.k, r.v, r.nth) for r in numbered(df, "-v", within="k").collect())
    want = [(k, v, n) for k in range(3) for n, v in enumerate(sorted({(i * 7) % 50 for i in range(50) if i % 3 == k}, reverse=True), 1)]
    assert got == sorted(want)
    assert sorted(r.v for r in first_rows(df, 5, "-v").collect()) == [45, 46, 47, 48, 49]


def test_large_islands_are_solved_distributed(spark, monkeypatch):
    nodes, start = frames(spark, YEARS, START)
    state = inc.start(nodes, start)
    monkeypatch.setattr(kernel, "LOCAL_ROWS", 2)
    state, counts = inc.apply_batch(state, spark.createDataFrame(DELTA, "src long, dst long"))
    assert counts["invalid"] > 0 and inc.violations(state).first().violations == 0
    assert pairs(state.members, "id", "component") == set(closure_components(YEARS, START + DELTA).items())


def test_islands(spark):
    spans = [(1, 3), (3, 5), (7, 8), (2, 2), (20, 40), (30, 31), (41, 42), (7, 9)]
    up = spark.createDataFrame([(s, *x) for s in (0, 5) for x in spans[s // 5 * 3 :]], "space long, r_src long, r_dst long")
    assert pairs(inc.islands(up), "space", "lo", "hi") == {(0, 1, 5), (0, 7, 9), (0, 20, 40), (0, 41, 42), (5, 2, 2), (5, 7, 9), (5, 20, 40), (5, 41, 42)}


def test_checkpoints_and_strides(spark):
    assert inc.checkpoints(3000, -1) == [50, 100, 500, 1000, 1500, 2000, 2500, 3000] and inc.checkpoints(100, 7.5) == [25]
    delta = spark.range(31).selectExpr("id as seq", "id as src", "id + 1 as dst")
    assert [(r.seq, r.src) for r in inc.strided(delta, 31, 3).orderBy("seq").collect()] == [(0, 0), (1, 10), (2, 20)] and inc.strided(delta, 31).count() == 31


def test_edge_functions(spark):
    nodes, edges = frames(spark, {1: 2000, 2: 2010, 3: 2009, 4: 2000}, [(1, 2), (1, 3), (2, 1), (1, 4), (4, 4), (9, 1), (1, 2)])
    dated = fe.dated(edges, nodes).withColumn("c", fe.edge_class())
    assert [(r.src, r.dst, r.c) for r in dated.orderBy("src", "dst").collect()] == [(1, 2, "unorder"), (1, 2, "unorder"), (1, 3, "unorder"), (1, 4, "same"), (2, 1, "normal"), (4, 4, "same"), (9, 1, "unorder")]
    assert pairs(dated.filter(fe.within_gap()), "src", "dst") == {(1, 3), (1, 4), (2, 1), (4, 4)}
    assert pairs(fe.degree(edges), "id", "degree") == {(1, 6), (2, 3), (3, 1), (4, 1), (9, 1)}
    assert pairs(fe.degree_sample(nodes, edges.filter("src <> 9"), 0.5), "src", "dst") == {(1, 2), (2, 1)}
    part = spark.createDataFrame([(1, "gm"), (2, "gsi"), (3, "gr"), (4, "gsi")], "id long, part string")
    kinds = spark.createDataFrame([(1, 1), (2, 1), (1, 3), (2, 4), (2, 3), (3, 2), (3, 3)], "src long, dst long")
    assert [r.type for r in fe.insertion_type(kinds, part).orderBy("src", "dst").collect()] == [1, 3, 2, 5, 4, 5, 6]


def test_histograms(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "id long, component long")
    assert pairs(scc.histogram(df), "size", "cnt") == {(1, 2), (2, 1)}
    assert scc.same_histogram(scc.histogram(df), scc.histogram(df)) and not scc.same_histogram(scc.histogram(df), scc.histogram(df.limit(2)))


def test_new_edges_span_short_intervals(spark):
    """A path on which every third node ends, wherever it lies; edges lead on from there. Full searches meet few components."""
    n = 300
    nodes, df = frames(spark, {v: 2000 for v in range(n)}, [(v, w) for v in range(3, n) if v % 3 for w in (v - 1, v - 3)])
    delta = spark.createDataFrame([(k, v, v - 1) for k, v in enumerate(range(3, n, 3))], "seq long, src long, dst long")
    row = inc.maintained(nodes, df, delta, batch=1, cuts=[delta.count()], search="both").filter("id is null").first()
    assert row.inserted == delta.count() and row.visited <= 4 * row.inserted


def test_what_moves_to_gm_stays_near():
    """An edge to a node outside Gm that leads nowhere, and one on from there, don't look at what lies above or below."""
    n = 4000
    ids = np.arange(n + 1)
    r = Replay(ids, ids, [GM] * n + [None], [*range(1, n + 1), None], np.full(n + 1, 2000), ids[1:n], ids[: n - 1], coupled=True, search="both")
    r.insert([n // 2], [n])
    r.insert([n], [n // 2 - 1])
    check_gm = [c for c in sorted(r.rank, key=r.rank.__getitem__)]
    assert r.counts.migrated == 1 and r.counts.visited < 10 and check_gm.index(n) == n // 2


def test_parts_change_before_batches(spark, monkeypatch):
    """Beyond one task, what an increment moves to Gm moves as one set, and batches of one edge each follow, island by island."""
    year = {v: 2000 + v // 40 for v in range(160)}
    r = random.Random(4)
    edges = sorted({(a, max(0, a - r.randint(1, 9))) for a in range(1, 160) for _ in range(2)} | {(39, 41), (79, 82)})
    new = [(a, min(159, a + r.randint(1, 4))) for a in r.sample(range(150), 40)]
    nodes, df = frames(spark, year, [e for e in edges if e[0] != e[1]])
    delta = spark.createDataFrame([(i, *e) for i, e in enumerate(new)], "seq long, src long, dst long")
    monkeypatch.setattr(kernel, "LOCAL_ROWS", 500)
    calls, apply = [], inc.apply_batch
    monkeypatch.setattr(inc, "apply_batch", lambda *a: calls.append(1) or apply(*a))
    rows = inc.maintained(nodes, df, delta, batch=1, cuts=[len(new)], coupled=True, search="both").collect()
    now = [e for e in edges if e[0] != e[1]] + new
    assert {r.id: r.component for r in rows if r.id is not None} == closure_components(year, now)
    assert {r.id: r.part for r in rows if r.id is not None} == parts(year, now)
    assert len(calls) == 0 and [r.migrated for r in rows if r.id is None][0] > 0


def test_cuts_beyond_one_task(spark, monkeypatch):
    """Components and parts at each cut, and upward edges by scope, are those of one task, and all cuts take one replay."""
    year = {v: 2000 + v // 40 for v in range(160)}
    r = random.Random(5)
    edges = sorted({(a, max(0, a - r.randint(1, 9))) for a in range(1, 160) for _ in range(2)} | {(39, 41), (79, 82)})
    edges = [e for e in edges if e[0] != e[1]]
    new = [(a, min(159, a + r.randint(1, 4))) for a in r.sample(range(150), 40)]
    nodes, df = frames(spark, year, edges)
    delta = spark.createDataFrame([(i, *e) for i, e in enumerate(new)], "seq long, src long, dst long")
    monkeypatch.setattr(kernel, "LOCAL_ROWS", 500)
    calls, real = [], inc.in_islands
    monkeypatch.setattr(inc, "in_islands", lambda *a: calls.append(1) or real(*a))
    rows = inc.maintained(nodes, df, delta, batch=1, cuts=[0, 10, 25, 40], coupled=True).collect()
    for n, cut in enumerate((0, 10, 25, 40)):
        now = edges + new[:cut]
        want = closure_components(year, now)
        assert {(x.id, x.component, x.part) for x in rows if x.cut == n and x.id is not None} == {(v, want[v], p) for v, p in parts(year, now).items()}
    assert len(calls) == 1
    scopes = []
    for most in (2_000_000, 500):
        monkeypatch.setattr(kernel, "LOCAL_ROWS", most)
        found = inc.maintained(nodes, df, delta, batch=40, cuts=[40], coupled=True, by="level")
        scopes.append(pairs(inc.invalid_by_scope(found), "part", "year", "invalid"))
    assert scopes[0] == scopes[1] and scopes[0]


def test_what_trimming_leaves_is_solved_at_once(spark, monkeypatch):
    """A graph beyond one task, of which little can lie on cycles, takes no round of colours."""
    edges = [(v, v + 1) for v in range(0, 400, 2)] + [(v, v + 1) for v in range(500, 540)] + [(540, 520)]
    monkeypatch.setattr(kernel, "LOCAL_ROWS", 100)
    rounds, real = [], scc._carried
    monkeypatch.setattr(scc, "_carried", lambda *a: rounds.append(1) or real(*a))
    got = dict(pairs(scc.scc(spark.createDataFrame(edges, "src long, dst long")), "id", "component"))
    assert got == {v: min(v, 520) for e in edges for v in e} and not rounds


@pytest.mark.parametrize("most", [2_000_000, 50, 10])
def test_places_fall_along_edges(spark, monkeypatch, most):
    """By the greatest name, then by paths inside it; the same at any bound, also where one name holds more than fits a task."""
    r = random.Random(9)
    between = sorted({(max(e), min(e)) for e in random_edges(r, 60, 120) if e[0] != e[1]} | {(v, 70) for v in range(20)})
    far, level = {}, {}
    for v in [70, *range(60)]:
        to = [b for a, b in between if a == v]
        far[v] = max([v, *(far[b] for b in to)])
        level[v] = max((1 + level[b] for b in to if far[b] == far[v]), default=0)
    monkeypatch.setattr(kernel, "LOCAL_ROWS", most)
    names = spark.createDataFrame([(v,) for v in far], "component long")
    assert pairs(scc.places(names, spark.createDataFrame(between, "src long, dst long")), "component", "level", "far") == {(v, level[v], far[v]) for v in far}


def test_parts_at_cuts_need_no_components(spark, monkeypatch):
    """Beyond one task, parts at cuts are those of one task, and no state is made for them."""
    year = {v: 2000 + v // 40 for v in range(160)}
    r = random.Random(6)
    edges = sorted({(a, max(0, a - r.randint(1, 9))) for a in range(1, 160) for _ in range(2)} | {(39, 41), (79, 82)})
    new = [(a, min(159, a + r.randint(1, 4))) for a in r.sample(range(150), 40)]
    nodes, df = frames(spark, year, edges)
    delta = spark.createDataFrame([(i, *e) for i, e in enumerate(new)], "seq long, src long, dst long")
    monkeypatch.setattr(kernel, "LOCAL_ROWS", 300)
    monkeypatch.setattr(inc, "started", None)
    rows = pairs(inc.parts_at(nodes, df, delta, [0, 10, 40]), "cut", "id", "part")
    assert rows == {(n, v, p) for n, cut in enumerate((0, 10, 40)) for v, p in parts(year, edges + new[:cut]).items()}


def test_first_metrics_do_not_depend_on_the_bound(spark, monkeypatch):
    """Beyond one task, where no island of the batch fits a task either, counts are those of one task, and none is left out."""
    n = 300
    edges = [(v, w) for v in range(3, n) for w in (v - 1, v - 3)]
    new = [(k, v, v + 30) for k, v in enumerate(range(0, n - 40, 3))] + [(200, n + 1, 5), (201, 7, 7)]
    monkeypatch.setattr(graphs, "local_graph", lambda spark, _: (frames(spark, {v: 2000 for v in range(n)}, [])[0], None, spark.createDataFrame([(a, b, 5) for a, b in edges] + [(a, b, 0) for _, a, b in new], "src long, dst long, b long")))
    found = []
    for most in (2_000_000, 400):
        monkeypatch.setattr(kernel, "LOCAL_ROWS", most)
        found.append([tuple(catalog.QUERIES[name](spark, "").first()) for name in ("inc_metrics", "bat_metrics")])
    assert found[0] == found[1] == [(len(new) - 1, len(new) - 1), (len(new) - 1, len(new) - 1, 1)]
