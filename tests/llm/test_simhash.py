import random

import numpy as np
import pytest
import xxhash

from tidegraph.llm import queries, simhash


def print_of(text):
    """By the definition, bit by bit."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
    words = [w for w in words if w]
    width = min(3, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(len(words) - width + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints):
    """Smallest id of the group of each (id, fingerprint), comparing everything."""
    ids = [i for i, _ in prints]
    group = {i: i for i in ids}
    links = [(a, b) for k, (a, x) in enumerate(prints) for b, y in prints[:k] if a == b or (x ^ y).bit_count() <= 2]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            least = min(group[a], group[b])
            if group[a] != least or group[b] != least:
                group[a] = group[b] = least
                moved = True
    return group


def near(r, x, bits):
    for b in r.sample(range(64), bits):
        x ^= 1 << b
    return x


def test_fingerprints(monkeypatch):
    texts = [None, "", " \n\t", "One", "one two", "one TWO three", "É ß x y É z É", "a\x0bb\x0cc d\re", "x y z " * 500, "w" * 5000 + " b c d"]
    for slab in (1 << 20, 7):
        monkeypatch.setattr(simhash, "SLAB", slab)
        for t in texts:
            assert simhash.fingerprint(t.encode() if t is not None else None) == print_of(t), t
    assert simhash.fingerprint(b"") == 0


def test_whole_query(spark, sf_dir):
    rows = queries.table(spark, sf_dir, "documents").collect()
    prints = [(r.doc_id, print_of(r.text)) for r in rows]
    group = grouped(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op12_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{x:016x}", group[i]) for i, x in prints}
    assert len(set(group.values())) < len(rows)


@pytest.mark.parametrize("shard", [16_384, 40, 10])
def test_links_of_many_shards_and_blocks(spark, monkeypatch, shard):
    """Clusters around the limit, a dense ball, and a chain, over many shards; large shards are cut into blocks."""
    monkeypatch.setattr(simhash, "SHARD_NODES", shard)
    monkeypatch.setattr(simhash, "LEAST_SAMPLED", 4)
    r = random.Random(3)
    points = [r.getrandbits(64) for _ in range(300)]
    points += [near(r, x, r.choice([1, 2, 3, 4])) for x in points[:150] for _ in range(2)]
    points += [points[0] ^ (1 << a) ^ (1 << b) for a in range(10) for b in range(10)]
    chain = [r.getrandbits(64)]
    for k in range(60):
        chain.append(chain[-1] ^ (1 << (2 * k % 64)) ^ (1 << ((2 * k + 1) % 64)))
    points = sorted({*points, *chain, 0, (1 << 64) - 1})
    nodes = spark.createDataFrame([(int(np.array(x, np.uint64).view(np.int64)),) for x in points], "fp long").repartition(3)
    found = simhash.links(nodes, sample_rows=200).collect()
    label = {x: x for x in points}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in found:
        a, b = (int(np.array(x, np.int64).view(np.uint64)) for x in (a, b))
        assert 0 < (a ^ b).bit_count() <= 2
        if root(a) != root(b):
            label[max(root(a), root(b))] = min(root(a), root(b))
    want = grouped([(x, x) for x in points])
    assert {x: root(x) for x in points} == want
    assert len(found) < 4 * len(points)  # forests, not all pairs


def test_odd_rows(spark):
    same = "these few words stand in two rows of one id"
    rows = [(5, None), (4, ""), (9, " \n"), (7, same), (8, same.upper()), (None, same), (None, None), (1, "quite another text than that of the others here"), (1, "and a third one that shares an id with the one before"), (2, "and a third one that shares an id with the one before"), (2, "and a third one that shares an id with the one before")]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, fingerprint string, component int")
    got = sorted(((r.doc_id, r.component) for r in simhash.near_copies(df).collect()), key=str)
    assert got == sorted([(5, 4), (4, 4), (9, 4), (7, 7), (8, 7), (None, None), (None, None), (1, 1), (1, 1), (2, 1), (2, 1)], key=str)
    assert {r.fingerprint for r in simhash.near_copies(df).filter("doc_id in (4, 5, 9)").collect()} == {"0" * 16}
    assert simhash.near_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("leaf", [48, 5])
def test_trees_lose_no_pair(monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF_NODES", leaf)
    monkeypatch.setattr(simhash, "HELD", 3000)
    r = np.random.default_rng(1)
    x = np.unique(np.concatenate([r.integers(0, 1 << 63, 1500, np.uint64), (r.integers(0, 1 << 63, 1, np.uint64) ^ (np.uint64(1) << r.integers(0, 64, (400, 2)).astype(np.uint64)).sum(axis=1, dtype=np.uint64))]))
    shard = simhash.Shard(x)
    got = {(min(i, j), max(i, j)) for a, b in shard.tree.pairs(x, shard.where) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i != j}
    i, j = np.nonzero(np.triu(simhash.distance(x[:, None], x[None]) <= 2, 1))
    assert got == set(zip(i.tolist(), j.tolist(), strict=True)) and len(shard.tree.leaves) > 10
