import random
import re

import numpy as np
import pytest

from tidegraph.llm import ngram_join, queries
from tidegraph.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(1, len(w))))}


def brute(docs, k, num, den):
    """docs: list of (id, text). (id, set size, component) by comparing all pairs."""
    sets = [(i, shingles(t, k)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_gram = {}
    for a, (_, s) in enumerate(sets):
        for g in s:
            by_gram.setdefault(g, []).append(a)
    seen = set()
    for who in by_gram.values():
        for x in range(len(who)):
            for y in range(x):
                if (who[y], who[x]) not in seen:
                    seen.add((who[y], who[x]))
                    s, t = sets[who[x]][1], sets[who[y]][1]
                    if den * len(s & t) >= num * len(s | t):
                        root[find(who[x])] = find(who[y])
    low = {}
    for a, (i, _) in enumerate(sets):
        low[find(a)] = min(low.get(find(a), i), i)
    return sorted((i, len(s), low[find(a)]) for a, (i, s) in enumerate(sets))


def near_copies(r, n_groups, most):
    docs, vocab = [], [f"w{i}" for i in range(300)]
    passage = [r.choice(vocab) for _ in range(20)]
    for _ in range(n_groups):
        base = [r.choice(vocab) for _ in range(r.randint(1, 80))]
        for _ in range(r.randint(1, most)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                at = r.randrange(len(w) + 1)
                w[at : at + r.choice([0, 1])] = [r.choice(vocab)] * r.choice([0, 1])
            if r.random() < 0.2:
                w += passage
            docs.append(" ".join(x.upper() if r.random() < 0.1 else x for x in w))
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("k", "num", "den", "block", "bits"), [(4, 85, 100, 2048, 1 << 20), (5, 80, 100, 2048, 1 << 20), (2, 60, 100, 7, 128)])
def test_equals_brute_force(spark, monkeypatch, k, num, den, block, bits):
    """The last case cuts lists into many blocks, and has signatures so short that verification must mend them."""
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", block)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 50 * block)
    monkeypatch.setattr(ngram_join, "LEAST_BITS", min(bits, 256))
    monkeypatch.setattr(ngram_join, "MOST_BITS", bits)
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 3)
    docs = near_copies(random.Random(k), 60, 12)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(x) for x in ngram_join.jaccard_groups(df, k=k, num=num, den=den).collect())
    assert got == brute(docs, k, num, den)


def drifting_copies(r, n_groups):
    """Copies of copies around the threshold. The first and the last of four link, and the last two share a passage that is rare otherwise, but don't link."""
    docs, passage = [], [f"p{i}" for i in range(12)]
    fresh = lambda: f"w{r.randrange(1 << 40)}"
    for g in range(n_groups):
        first = [fresh() for _ in range(83)]
        rare = [f"{x}_{g}" for x in passage]
        second = [fresh() if i in (10, 30) else x for i, x in enumerate(first)]
        third = [fresh() if i == 2 else x for i, x in enumerate(second)] + rare
        docs += [" ".join(w) for w in (first, second, third, first + rare)]
    return list(enumerate(docs))


def test_drifting_copies_equal_brute_force(spark):
    """Where a link to a pivot fails on whole sets, the root of its component is compared again, too."""
    docs = drifting_copies(random.Random(1), 12)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(x) for x in ngram_join.jaccard_groups(df, k=4, num=80, den=100).collect()) == brute(docs, 4, 80, 100)


def test_link_counts_equal_brute_force(spark, monkeypatch):
    """Groups of near and exact copies, cut into many blocks."""
    monkeypatch.setattr(ngram_join, "LINK_TOKENS", 450)
    docs = near_copies(random.Random(7), 30, 12)
    docs += [(len(docs) + i, t) for i, (_, t) in enumerate(docs[:60])] + [(10_000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(x) for x in ngram_join.jaccard_links(df, k=4, num=85, den=100).collect())
    sets = {i: shingles(t, 4) for i, t in docs}
    linked = lambda s, t: bool(s) and 100 * len(s & t) >= 85 * len(s | t)
    links = {i: sum(i != j and linked(s, t) for j, t in sets.items()) for i, s in sets.items()}
    assert max(links.values()) > 3
    assert got == [(*x, links[x[0]]) for x in brute(docs, 4, 85, 100)]


def test_repeated_ids_keep_all_links(spark):
    """An id with several texts has the links of all of them."""
    r = random.Random(9)
    base = [[f"w{r.randrange(10**6)}" for _ in range(40)] for _ in range(4)]
    texts = [" ".join(w) for w in base]
    rows = [(10, texts[0]), (10, texts[1]), (20, texts[1] + " more"), (30, texts[0] + " more"), (7, texts[2]), (40, texts[2] + " x"), (40, texts[3]), (50, texts[3] + " y"), (50, texts[3] + " y"), (60, None), (60, "one"), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.component or 0) for x in ngram_join.jaccard_groups(df, k=4, num=85, den=100).collect())
    assert got == sorted([(10, 10), (10, 10), (20, 10), (30, 10), (7, 7), (40, 7), (40, 7), (50, 7), (50, 7), (60, 60), (60, 60), (0, 0)])
    kept = sorted(((x.doc_id or 0, x.text) for x in ngram_join.first_of_groups(df, k=4, num=85, den=100).collect()), key=str)
    assert kept == sorted([(0, texts[0]), (7, texts[2]), (10, texts[0]), (10, texts[1]), (40, texts[3]), (60, None), (60, "one")], key=str)


def test_different_texts_of_one_id_stay(spark):
    """A row goes only if its own text is a copy."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (3, c), (3, c), (3, None), (3, ""), (4, b + " more"), (5, b), (None, a), (6, "short text"), (6, c)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, id int")
    kept = ngram_join.first_of_groups(df, k=4, num=85, den=100)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (1, b), (3, c), (3, None), (3, ""), (None, a), (6, "short text")], key=str)


def test_without_ids(spark):
    df = spark.createDataFrame([(i % 900, "t") for i in range(1000)] + [(None, "n")], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 2000, 3)], "doc_id long")
    got = sorted(x.doc_id if x.doc_id is not None else -1 for x in ngram_join._without(df, ids, "doc_id").collect())
    assert got == sorted([-1] + [i % 900 for i in range(1000) if i % 900 % 3])
    assert ngram_join._without(df, ids.limit(0), "doc_id").count() == 1001


def test_linked_with_equals_sets():
    r = random.Random(10)
    sets = [{x for x in range(30) if r.random() < 0.9} | {r.randrange(100, 140)} for _ in range(50)] + [{1}, {2}]
    got = ngram_join.linked_with([np.array(sorted(x)) for x in sets], 80, 100)
    assert got.tolist() == [[100 * len(a & b) >= 80 * len(a | b) and bool(a & b) for b in sets] for a in sets]


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").collect()]
    rows = sorted(tuple(x) for x in queries.op2_jaccard(spark, sf_dir).collect())
    assert [x[:3] for x in rows] == brute(docs, 4, 85, 100)
    sets = {i: shingles(t, 4) for i, t in docs}
    assert [x[3] for x in rows] == [sum(i != j and bool(s) and 100 * len(s & t) >= 85 * len(s | t) for j, t in sets.items()) for i, s in sorted(sets.items())]


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    docs = [(9, None), (8, ""), (7, " \t"), (6, "one"), (5, "ONE"), (5, "ONE"), (4, "one two"), (3, long), (2, long + " more"), (1, "a b c d e")]
    df = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in [*docs, (None, "one")]], "doc_id long, text string, n int, id int, component int")
    got = sorted(tuple(x) for x in ngram_join.jaccard_groups(df, k=4, num=85, den=100).collect() if x.doc_id is not None)
    assert got == sorted([(9, 0, 9), (8, 0, 8), (7, 0, 7), (6, 1, 5), (5, 1, 5), (5, 1, 5), (4, 1, 4), (3, 29997, 2), (2, 29998, 2), (1, 2, 1)])
    assert ngram_join.jaccard_groups(df.limit(0), k=4, num=85, den=100).count() == 0


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 50)]
    root = {x: x for l in links for x in l}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(root[x] == c for x, c in got.items()) and all(x in got or root[x] == x for x in root)


def test_forests_cut_nothing():
    r = random.Random(5)
    sets = [np.unique(np.array([r.randrange(1 << 60) if r.random() < 0.1 else x for x in range(r.randint(20, 30))], np.uint64)) for _ in range(60)]
    group = [r.randrange(20) for _ in range(60)]
    signs = [ngram_join.signature(s) for s in sets]

    def closed(pairs):
        root = {i: group[i] for i in range(60)}
        for a, b in pairs:
            old, new = root[a], root[b]
            root = {i: new if g == old else g for i, g in root.items()}
        return {frozenset(i for i in root if root[i] == g) for g in root.values()}

    jac = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 70 * len(np.union1d(sets[a], sets[b]))
    links = ngram_join.exact_links(list(range(60)), group, [s.view(np.int64) for s in sets], 70, 100)
    assert links and all(jac(a, b) for a, b in links)
    assert closed(links) == closed([(a, b) for a in range(60) for b in range(a) if jac(a, b)])
    n, few = np.array([len(s) for s in sets]), [np.sort((ngram_join.mix(s) >> np.uint64(48)).astype(np.uint16)) for s in sets]
    likely = closed(ngram_join.likely_links(list(range(60)), group, n, signs, np.full(60, 4), few, 70, 100))
    none = ngram_join.likely_links(list(range(60)), group, n, signs, np.full(60, 4), [np.full(3, i, np.uint16) for i in range(60)], 70, 100)
    assert not none  # nothing shares four prefix tokens
    assert all(any(g <= h for h in likely) for g in closed(links))


def test_signatures_never_differ_more_than_sets():
    r = np.random.default_rng(6)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 62, r.integers(1, 900)).astype(np.uint64))
        b = np.union1d(a[r.random(len(a)) < 0.8], r.integers(0, 1 << 62, r.integers(1, 500)).astype(np.uint64))
        s, t = ngram_join.signature(a), ngram_join.signature(b)
        least = min(len(s), len(t))
        differ = int(np.bitwise_count(ngram_join.folded(s, least) ^ ngram_join.folded(t, least)).sum())
        assert differ <= len(np.setxor1d(a, b)) and differ % 2 == len(np.setxor1d(a, b)) % 2
