import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidegraph.llm import queries, toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op7_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect()}
    test = [(rows[i].score, y) for i, y in labels.items() if rows[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
    s, y = np.array(test).T
    assert ((s >= 0.5) == y).mean() >= 0.97 and (s[y == 1] >= 0.5).mean() >= 0.8


def brute_score(m, text):
    """Word by word, without slabs."""
    vec = [m.table[list(toxicity.word_rows(w))].sum(axis=0) for w in text.split()]
    n = -(-(len(vec) + 2) // toxicity.STRETCH) * toxicity.STRETCH
    none = np.zeros(toxicity.DIM)
    x = np.array([none, none, *vec] + [none] * (n - len(vec)))
    z = np.concatenate([sum(x[j : n + j] @ w[j] for j in range(len(w))) for w in m.filters], axis=1) + m.bias
    top = np.maximum(z, 0).reshape(-1, toxicity.STRETCH, z.shape[1]).max(axis=1)
    return 1 / (1 + np.exp(-(np.concatenate((top.mean(axis=0), top.max(axis=0))) @ m.out + m.shift)))


def test_query_equals_plain_version(spark, sf_dir):
    """Every document of the table, word by word, with the model that the query fits; and that no label, language or id enters."""
    docs, labels = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels")
    m = toxicity.train(docs, labels)
    text = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    rows = queries.op7_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        want = brute_score(m, text[r.doc_id][0] or "")
        assert abs(r.score - want) < 1e-4
        assert r.predicted == int(r.score >= 0.5) and r.toxic == (r.score >= m.thresholds.get(text[r.doc_id][1], 0.5))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 10**6)
    again = {r.doc_id: r.score for r in toxicity.score(other, m).collect()}
    assert all(abs(again[r.doc_id + 10**6] - r.score) < 1e-6 for r in rows)


def sample():
    r = random.Random(3)
    words = [f"{a}{b}" for a in "kmprst" for b in ("an", "el", "in", "or", "ut", "arim")]
    text = lambda bad: " ".join("Vile," if bad and r.random() < 0.05 else r.choice(words) for _ in range(r.randint(30, 200)))
    return [(i, text(i % 4 == 0), int(i % 4 == 0), ("en", "fr")[i % 2]) for i in range(400)]


def test_scores_equal_plain_convolution():
    rows = sample()
    m = toxicity.fit([t for _, t, _, _ in rows], [y for _, _, y, _ in rows], epochs=3)
    texts = ["", "one", rows[0][1], "vile " * 31, "a " * 32, " ".join(t for _, t, _, _ in rows) * 4]
    got = m.score(texts, toxicity._WordIndex())
    assert np.allclose(got, [brute_score(m, t) for t in texts], atol=1e-4)
    p = m.score([t for _, t, _, _ in rows], toxicity._WordIndex())
    assert ((p >= 0.5) == [y for _, _, y, _ in rows]).mean() > 0.95


def test_gradients_equal_differences():
    """Every kind of parameter, by central differences of the loss in double precision."""
    r = np.random.default_rng(4)
    texts = [[1, 2, 3, 4, 5] * 9, [6, 2], [7, 8, 9] * 30]
    table_rows = r.integers(1, 40, (10, 4))
    table_rows[0] = 0
    start, stretches = toxicity.layout([len(t) for t in texts])
    words = np.zeros(int(stretches.sum()) * toxicity.STRETCH, int)
    for t, at in zip(texts, start.tolist(), strict=True):
        words[at : at + len(t)] = t
    y, width = np.array([1.0, 0.0, 1.0]), len(toxicity.WIDTHS) * toxicity.FILTERS
    m = toxicity.Model(r.normal(0, 0.3, (40, toxicity.DIM)), [r.normal(0, 0.4, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS], r.normal(0, 0.1, width), r.normal(0, 0.5, 2 * width), 0.2, {}, True)
    m.table[0] = 0

    def loss():
        x = np.concatenate((m.table[table_rows[words]].sum(axis=1), np.zeros((max(toxicity.WIDTHS) - 1, toxicity.DIM))))
        n = len(x) - max(toxicity.WIDTHS) + 1
        z = np.concatenate([sum(x[j : n + j] @ w[j] for j in range(len(w))) for w in m.filters], axis=1) + m.bias
        z, total, at = np.maximum(z, 0), 0.0, 0
        for k, label in zip(stretches.tolist(), y.tolist(), strict=True):
            top = z[at : at + k * toxicity.STRETCH].reshape(k, toxicity.STRETCH, -1).max(axis=1)
            at += k * toxicity.STRETCH
            s = np.concatenate((top.mean(axis=0), top.max(axis=0))) @ m.out + m.shift
            total += np.log1p(np.exp(-s if label else s)) / len(y)
        return total + toxicity.DECAY / 2 * (sum((w**2).sum() for w in m.filters) + (m.out**2).sum())

    grads, moved = toxicity.gradients(m, table_rows[words], stretches, y)
    e = 1e-5
    for p, g in zip([m.table, *m.filters, m.bias, m.out], grads, strict=True):
        for i in r.integers(0, p.size, 40).tolist():
            at = np.unravel_index(i, p.shape)
            if p is m.table and at[0] == 0:
                continue
            p[at] += e
            up = loss()
            p[at] -= 2 * e
            down = loss()
            p[at] += e
            assert abs((up - down) / (2 * e) - g[at]) < 1e-6
    m.shift += e
    up = loss()
    m.shift -= 2 * e
    assert abs((up - loss()) / (2 * e) - moved) < 1e-6


def test_fitted_on_whole_texts(spark):
    """Toxic words far behind the first thousands of characters are learnt; ids choose rows and nothing else; texts that are too long leave their place to others."""
    r = random.Random(6)
    calm = [f"{a}{b}" for a in "bdfglm" for b in ("elo", "ani", "uro", "ito")]
    body = lambda bad: " ".join([r.choice(calm) for _ in range(1500)] + (["zgrimox"] * 60 if bad else []))
    rows = [(i, body(i % 3 == 0), int(i % 3 == 0)) for i in range(150)]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    m = toxicity.train(docs, labels, epochs=8)
    low, high = m.score([body(False), body(True)], toxicity._WordIndex())
    assert low < 0.5 < high
    few = toxicity.train(docs, labels, most_bytes=20_000)  # a sixteenth of that is less than any text
    assert not few.fitted
    assert toxicity.in_batches([5, 5, 10**6, 1, 1, 1], 2) == [[0, 1], [2], [3, 4], [5]]


def test_odd_rows(spark):
    rows = sample()
    docs = spark.createDataFrame([(i, t, g, 0.0, 1) for i, t, _, g in rows] + [(None, "vile " * 50, None, 0.0, 1), (900, None, "en", 0.0, 1), (901, "", "xx", 0.0, 1), (0, rows[0][1], "en", 0.0, 1), (902, "vile words " * 50000, "en", 0.0, 1)], "doc_id long, text string, lang string, score double, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows] + [(0, 0), (None, 1), (1, None), (2, 7), (77777, 1)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels)
    got = toxicity.score(docs, m).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert [r.predicted for r in got if r.doc_id == 902] == [1]
    kept = toxicity.keep_clean(docs, m)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in got)
    assert toxicity.score(docs.limit(0), m).count() == 0
    unfit = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, unfit).collect()} == {0.0}


def test_thresholds_by_language():
    s = np.array([0.1] * 40 + [0.45] * 20 + [0.6] * 40 + [0.9] * 20)
    y = np.array([0] * 40 + [1] * 20 + [0] * 40 + [1] * 20)
    t = toxicity.calibrate(s, y, ["aa"] * 60 + ["bb"] * 60)
    assert 0.3 <= t["aa"] < 0.45 and 0.6 < t["bb"] <= 0.7
    assert toxicity.calibrate(s[:5], y[:5], ["aa"] * 5) == {}


def test_all_labels_apart_from_the_fit_calibrate(spark, monkeypatch):
    """Thresholds come from every labelled text of the ids apart, also beyond the rows that are fitted on."""
    words = {0: "kind calm good warm", 1: "awful nasty cruel vile"}
    rows = [(i, f"{words[i % 2]} {words[i % 2]}", "en" if i < 2000 else "de", i % 2) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "thresholds", lambda counts, **_: seen.append(counts) or {})
    toxicity.train(docs, docs.select("doc_id", "toxic"), most_rows=200, epochs=1)
    apart = docs.filter(~toxicity.held_out(F.col("doc_id")) & (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0))
    want = {(r["lang"], r["toxic"]): r["count"] for r in apart.groupBy("lang", "toxic").count().collect()}
    got = {}
    for (lang, label, _), n in seen[0].items():
        got[lang, label] = got.get((lang, label), 0) + n
    assert got == want and sum(want.values()) > 200
