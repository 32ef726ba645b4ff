import hashlib
import shutil

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontamination import brute as brute_hits
from tests.llm.test_ngram_join import brute as brute_groups
from tidegraph.llm import ngram_join, quality, queries, toxicity


def test_run_equals_plain_version(spark, sf_dir):
    """Each stage by its own plain rule, on what the stage before kept."""
    docs, labels = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels")
    text = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).filter("toxic").collect()}
    left = docs.filter(~docs.doc_id.isin(list(toxic) or [-1]))
    model = quality.train(left, labels)
    judged = quality.judge(left, quality.sites(left, labels, model, *queries.site_of(left)), model, *queries.site_of(left))
    good = {r.doc_id for r in judged.filter("keep").collect()}
    first = {i for i, _, c in brute_groups([(i, text[i]) for i in sorted(good)], 5, 80, 100) if i == c}
    items = [(r.item_id, r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    want = set()
    for i in first:
        if any(len(set(text[i].lower().split()) & set(t.lower().split())) > 8 for _, t in items):
            n, hit, _ = brute_hits(text[i], items)
            if hit and 20 * len(hit) >= n:
                continue
        want.add(i)
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(rows) == want and 0 < len(want) < len(text) and len(first) < len(good)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in rows.items():
        assert list(r.token_ids) == library.encode(text[i], add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(text[i].encode()).hexdigest()


def test_run_on_odd_rows(spark, sf_dir, tmp_path):
    """Null, empty, very long and repeated texts, repeated and null ids, clashing columns; then an empty table."""
    for name in ("labels", "benchmark"):
        shutil.copy(f"{sf_dir}/{name}.parquet", tmp_path)
    docs = queries.table(spark, sf_dir, "documents")
    plain = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    good = max(plain, key=lambda i: -len(text[i]))
    kept = sorted(plain)[:3]
    long = " ".join(text[i] for i in sorted(plain)) * 12
    odd = [(10**6 + i, t, "en", "s", 1) for i, t in enumerate((None, "", " \t\n", long))]
    odd += [(kept[0], text[kept[0]], "en", "s", 1), (kept[1], text[kept[2]], "en", "s", 1), (None, text[good], "en", None, 1), (None, None, None, None, None)]
    extra = spark.createDataFrame(odd, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(extra)
    clash = {c: F.lit(7) for c in ("score", "n_words", "id", "host", "site", "component", "prior", "spans", "token_ids", "evidence", "text_crc32", "label")}
    both.withColumns(clash).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(ids) == len(set(ids)) + 1 and ids.count(kept[1]) == 2  # two different texts, of which the second is copied by kept[2]
    assert len(set(plain) - set(ids)) <= 5 and kept[2] not in ids
    known = text | {10**6 + i: t for i, (_, t, *_) in enumerate(odd[:4])}
    for r in rows:
        if r.doc_id not in (None, kept[0], kept[1]):
            want = known[r.doc_id] or ""
            assert list(r.token_ids) == library.encode(want, add_special_tokens=False).ids
            assert r.decoded_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.n_tokens == len(r.token_ids)
    shutil.rmtree(f"{tmp_path}/documents.parquet")
    both.withColumns(clash).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_first_of_groups(spark):
    a, b = "one two three four five six seven", "other words stand here and say much"
    rows = [(3, a, "x"), (1, a, "y"), (2, b, "z"), (2, b, "z"), (7, "", "e"), (8, None, "n"), (None, a, "i"), (None, a, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    kept = ngram_join.first_of_groups(df, k=5, num=80, den=100)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.component) for r in kept.collect()) == [(0, "i"), (0, "i"), (1, "y"), (2, "z"), (7, "e"), (8, "n")]
    assert ngram_join.first_of_groups(df.limit(0), k=5, num=80, den=100).count() == 0
