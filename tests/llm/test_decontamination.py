import hashlib
import random
import re

import pytest

from tidegraph.llm import decontamination as d
from tidegraph.llm import queries

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(text, items, window=13):
    """n_words, hit positions, item ids."""
    w, hit, who = words(text), set(), set()
    for i, item in items:
        v = words(item)
        size = min(window, len(v))
        for a in range(len(v) - size + 1) if v else ():
            for b in range(len(w) - size + 1):
                if w[b : b + size] == v[a : a + size]:
                    hit |= set(range(b, b + size))
                    if i is not None:
                        who.add(str(i))
    return len(w), hit, who


def random_case(r, window):
    vocab = ["ab", "cd", "ef", "G1", "é"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 2, 3, 5, 9]))) for i in range(r.randint(1, 4))]
    doc = text(r.randint(0, 25)) + (" " + r.choice(items)[1] if r.random() < 0.5 else "")
    return doc, items


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_matcher_equals_brute_force(window):
    r = random.Random(window)
    for _ in range(400):
        doc, items = random_case(r, window)
        m = d.Matcher([(str(i), t.encode()) for i, t in items], window)
        spans, who = m.of(d.words_of(doc.encode()))
        n, hit, ids = brute(doc, items, window)
        assert {x for a, b in spans for x in range(a, b)} == hit and who == ids, (doc, items)


def test_query_equals_brute_force(spark, sf_dir):
    items = [(r.item_id, r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    docs = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    rows = queries.op10_decontamination(spark, sf_dir).collect()
    grams = {}
    for i, t in items:
        v = words(t)
        for a in range(max(len(v) - 12, min(1, len(v)))):
            grams.setdefault(tuple(v[a : a + 13]), set()).add(str(i))
    sizes = {len(g) for g in grams}
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    for r in rows:
        w, hit, who = words(docs[r.doc_id]), set(), set()
        for size in sizes:
            for b in range(len(w) - size + 1):
                if found := grams.get(tuple(w[b : b + size])):
                    hit |= set(range(b, b + size))
                    who |= found
        sha = hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(who), sha, bool(hit) and 20 * len(hit) >= len(w))


ITEM = " ".join(f"w{i}" for i in range(15))
DOCS = [(1, None), (2, ""), (3, "?! ,"), (4, f"Before {ITEM.upper()}, after"), (4, f"Before {ITEM.upper()}, after"), (None, "tiny item"), (5, "x " * 30000), (6, f"{ITEM} " + "y " * 400)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 30])
def test_odd_rows_and_blocks(spark, block_bytes):
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in DOCS], "doc_id long, text string, n_words int, spans string")
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (None, "tiny item"), (4, "w3 w4")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, tuple(r.items), r.contaminated) for r in d.find(docs, bench, block_bytes=block_bytes).collect())
    assert got == sorted([(1, 0, 0, (), False), (2, 0, 0, (), False), (3, 0, 0, (), False), (4, 17, 15, ("1", "4"), True), (4, 17, 15, ("1", "4"), True), (0, 2, 2, (), True), (5, 30000, 0, (), False), (6, 415, 15, ("1", "4"), False)])
    kept = d.decontaminate(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 6]
    cut = {r.doc_id: r.text for r in d.decontaminate(docs, bench, remove="spans", block_bytes=block_bytes).collect()}
    assert cut[4] == "Before , after" and cut[6] == " " + "y " * 400 and cut[1] is None and cut[None] == ""


def test_many_blocks_are_one_stage(spark):
    """Fifty blocks and more: one pass over the documents, equal to brute force."""
    r = random.Random(3)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 4, 12, 13, 20, 40])))) for i in range(300)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 30))) + " " + " ".join(items[r.randrange(300)][1].split()[r.randrange(3) :]) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert d.write_blocks(bench, 13, "item_id", "text", 500).n >= 50
    found = d.find(docs, bench, block_bytes=500)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    for x in found.collect():
        n, hit, who = brute(texts[x.doc_id], items)
        assert (x.n_words, x.n_hit, set(x.items)) == (n, len(hit), who)


def test_each_block_is_built_once(spark, monkeypatch):
    """One task over many batches: no block's automaton is built twice, and no block's windows are read twice."""
    r = random.Random(4)
    vocab = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(30))) for i in range(300)]
    texts = [" ".join(r.choice(vocab) for _ in range(20)) + " " + items[r.randrange(300)][1] for _ in range(400)] + ["no such words"] * 50
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    class Caught:  # keeps the function that a task would run
        sparkSession, schema = docs.sparkSession, docs.schema

        def mapInArrow(self, f, _):
            self.f = f

    built, read, caught = [], [], Caught()
    real, windows = d.Matcher, d.Blocks.windows
    monkeypatch.setattr(d, "Matcher", lambda *a: built.append(1) or real(*a))
    monkeypatch.setattr(d.Blocks, "windows", lambda self, k: read.append(k) or windows(self, k))
    d._annotate(caught, bench, 13, "text", "item_id", 1500, ("n", "spans", "items"))
    table = docs.toArrow()
    out = list(caught.f(iter(table.to_batches(max_chunksize=10))))
    blocks = len(set(read))
    assert blocks >= 12 and len(read) == blocks and len(built) <= blocks
    found = {i: set(w) for b in out for i, w in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True)}
    assert len(found) == 450 and all(found[i] == brute(texts[i], items)[2] for i in range(0, 450, 9))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in d.find(docs, bench).collect()] == [0]
    assert d.find(docs.limit(0), bench).count() == 0 and d.decontaminate(docs.limit(0), bench).count() == 0
