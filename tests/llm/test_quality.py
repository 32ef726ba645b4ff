import math
import zlib
from collections import Counter

import numpy as np

from tidegraph.llm import quality, queries

GOOD = "The plain words of a text stand in many different orders and say number {} well. Another line follows it here.\n"
BAD = "BUY!! NOW!! {} BUY!! NOW!! $$$ ### *** BUY!! NOW!!\n"


def test_held_out_accuracy_and_sites(spark, sf_dir):
    rows = {r.doc_id: r for r in queries.op3_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in queries.table(spark, "/root/testdata/sf0.01", "labels").collect()}
    test = [(rows[i].keep, y) for i, y in labels.items() if i in rows and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(test) > 40 and np.mean([k == bool(y) for k, y in test]) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 < r.site < 1 and 0 <= r.score <= 1 for r in rows.values())


def case(spark):
    docs = [(i, GOOD.format(i) * (1 + i % 5), "good.example", "en") for i in range(300)] + [(1000 + i, BAD.format(i) * (1 + i % 5), "bad.example", "en") for i in range(150)]
    docs += [(2000, None, None, None), (2001, "", "good.example", None), (2002, GOOD.format(1) * 3, "bad.example", "en"), (2003, "x " * 100000, "once.example", "en"), (None, GOOD.format(2), "good.example", "en"), (1, GOOD.format(1), "good.example", "en")]
    labels = [(i, int(i < 1000)) for i in [*range(0, 300, 2), *range(1000, 1150, 2)]] + [(0, 0), (5, None), (None, 1), (7, 9), (99999, 1)]
    df = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, source string, lang string, score string, n double")
    return df, spark.createDataFrame(labels, "doc_id long, quality int")


def test_shrinking_follows_the_formula(spark):
    df, labels = case(spark)
    model = quality.train(df, labels)
    at = quality.sites(df, labels, model, *queries.site_of(df))
    site = {(r.host, r.path): r for r in at.collect()}
    assert site["bad.example", "en"].host_mean < 0.3 < 0.7 < site["good.example", "en"].host_mean and ("", "") in site
    got = quality.judge(df, at, model, *queries.site_of(df)).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got}
    for r, key in ((by[2002], ("bad.example", "en")), (by[2003], ("once.example", "en")), (by[2000], ("", ""))):
        s = site[key]
        own = (min(max(s.mass - r.evidence, 0), s.n - 1) + s.path_strength * s.host_mean) / (s.n - 1 + s.path_strength)
        assert abs(r.site - min(max(own, 0.01), 0.99)) < 1e-9
        odds = lambda x: np.log(x / (1 - x))
        assert abs(odds(r.score) - (odds(r.evidence) + odds(r.site) - odds(s.prior))) < 1e-6
    assert by[2002].score < by[2002].evidence  # a good text on a bad site counts for less
    assert not by[1010].keep and by[10].keep


def plain_features(text):
    """Shape of a text, character by character."""
    raw = (text or "").encode()
    share = [0] * 9
    for b in raw:
        c = chr(b)
        if b >= 128 or "a" <= c <= "z":
            share[0] += 1
        elif "A" <= c <= "Z":
            share[1] += 1
        elif c in "0123456789":
            share[2] += 1
        elif c in " \t\r":
            share[3] += 1
        elif c == "\n":
            share[4] += 1
        elif c in ".,;:'\"-()?":
            share[5] += 1
        elif c == "!":
            share[6] += 1
        elif c == "|":
            share[7] += 1
        else:
            share[8] += 1
    words = raw.split()
    n, kinds = len(words), len(set(words))
    per = max(n, 1)
    top = max((words.count(w) for w in set(words)), default=0) if n < 3000 else max(Counter(words).values())
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [math.log1p(100 * x / max(len(raw), 1)) for x in share] + [math.log1p(n), kinds / per, top / per, again / per, len(raw) / per / 10, math.log1p(n) * kinds / per]


def plain_strength(groups):
    """Documents that the prior weighs, from (n, mean, mean around which it is spread)."""
    n = sum(g[0] for g in groups)
    p = sum(g[0] * g[1] for g in groups) / n
    between = sum(g[0] * (g[1] - g[2]) ** 2 for g in groups) - sum(g[1] * (1 - g[1]) for g in groups)
    return min(max(n * p * (1 - p) / max(between, 1e-9) - 1, 2.0), 1000.0)


def test_query_equals_plain_version(spark, sf_dir):
    """The whole query again, in plain loops: features, fit, sites, shrinking, scores."""
    docs = queries.table(spark, sf_dir, "documents").collect()
    label = {r.doc_id: r.quality for r in queries.table(spark, sf_dir, "labels").collect()}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in docs}
    f = {r.doc_id: np.array(plain_features(r.text)) for r in docs}
    seen = [i for i in f if i in label and not held[i]]
    x, y = np.array([f[i] for i in seen]), np.array([label[i] for i in seen], float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = lambda v: np.append(np.clip((v - mean) / scale, -8, 8), 1.0)
    rows = np.array([z(v) for v in x])
    loss_grad = lambda w: rows.T @ (1 / (1 + np.exp(-np.clip(rows @ w, -12, 12))) - y) + np.append(w[:-1], 1e-3 * w[-1])
    model = quality.train(queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels"))
    assert np.abs(loss_grad(model.weight)).max() < 1e-3  # the least loss, by its gradient
    p = {i: 1 / (1 + math.exp(-min(max(float(z(v) @ model.weight), -12), 12))) for i, v in f.items()}
    mass, n = Counter(), Counter()
    for r in docs:
        site = (r.source or "", r.lang or "")
        for value in [p[r.doc_id]] + ([float(label[r.doc_id])] if r.doc_id in label and not held[r.doc_id] else []):
            mass[site] += value
            n[site] += 1
    host_mass, host_n = Counter(), Counter()
    for (h, _), m in mass.items():
        host_mass[h] += m
    for (h, _), k in n.items():
        host_n[h] += k
    prior = min(max(sum(mass.values()) / sum(n.values()), 0.01), 0.99)
    s = plain_strength([(host_n[h], host_mass[h] / host_n[h], prior) for h in host_n])
    host = {h: (host_mass[h] + s * prior) / (host_n[h] + s) for h in host_n}
    inner = plain_strength([(n[k], mass[k] / n[k], host[k[0]]) for k in n])
    odds = lambda v: math.log(v / (1 - v))
    got = {r.doc_id: r for r in queries.op3_quality(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r in docs:
        k, e = (r.source or "", r.lang or ""), p[r.doc_id]
        others = n[k] - 1
        site = min(max((min(max(mass[k] - e, 0), others) + inner * host[k[0]]) / (others + inner), 0.01), 0.99)
        score = 1 / (1 + math.exp(-(odds(e) + odds(site) - odds(prior))))
        assert abs(got[r.doc_id].evidence - e) < 1e-6 and abs(got[r.doc_id].site - site) < 1e-6 and abs(got[r.doc_id].score - score) < 1e-6
        assert got[r.doc_id].keep == (got[r.doc_id].score >= 0.5) and got[r.doc_id].held_out == held[r.doc_id]


def test_keep_good_and_empty(spark):
    df, labels = case(spark)
    model = quality.train(df, labels)
    at = quality.sites(df, labels, model, *queries.site_of(df))
    kept = quality.keep_good(df, at, model, *queries.site_of(df))
    assert kept.columns == df.columns
    judged = quality.judge(df, at, model, *queries.site_of(df)).filter("keep").count()
    assert kept.count() == judged
    none = quality.train(df, labels.limit(0))
    assert set(none.weight) == {0.0}
    empty = df.limit(0)
    assert quality.judge(empty, quality.sites(empty, labels, none, *queries.site_of(empty)), none, *queries.site_of(empty)).count() == 0
    plain = quality.judge(df, quality.sites(df, labels.limit(0), none, *queries.site_of(df)), none, *queries.site_of(df))
    assert {round(r.evidence, 6) for r in plain.collect()} == {0.5}


def test_joined_by_shuffling(spark, monkeypatch):
    df, labels = case(spark)
    model = quality.train(df, labels)
    at = quality.sites(df, labels, model, *queries.site_of(df))
    key = lambda q: sorted((r.doc_id or -1, round(r.score, 9)) for r in q.collect())
    want = key(quality.judge(df, at, model, *queries.site_of(df)))
    monkeypatch.setattr(quality, "MOST_BROADCAST", 0)
    assert key(quality.judge(df, at, model, *queries.site_of(df))) == want
    assert quality.keep_good(df, at, model, *queries.site_of(df)).count() == quality.judge(df, at, model, *queries.site_of(df)).filter("keep").count()
