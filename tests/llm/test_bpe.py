import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegraph.llm import bpe, queries
from tidegraph.llm.token_counts import Counts, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "\n\n a", "a  b", " lead", "trail ", "it's we'll 12 34%%% x\x1cy", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "漢字🙂 é", "a" * 5000, "ab" * 3000, "x y " * 20000, "\x00\x01", "a b"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts(n, seed):
    r = random.Random(seed)
    letters = "ab AB\n\t  é1'sré\x1c　漢🙂.,#"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_kernels_match_library(library):
    e, c = bpe.Encoder(PATH), Counts(PATH)
    for chunk in (texts(1500, 1), [x or "" for x in ODD]):
        ref = [x.ids for x in library.encode_batch(chunk, add_special_tokens=False)]
        assert [e.encode(x).tolist() for x in chunk] == ref
        assert c.of(chunk) == [len(x) for x in ref]
        assert [e.decode(x) for x in ref] == [library.decode(x, skip_special_tokens=False) for x in ref]


def test_long_words_equal_scanning():
    v, r = bpe.vocabulary(PATH), random.Random(2)
    for _ in range(200):
        w = "".join(r.choice("abcdeeths") for _ in range(r.randint(2, bpe.SHORT))).encode()
        assert bpe.encode_word(w, v) == bpe._encode_long(w, v)


def test_decode_odd_ids():
    e = bpe.Encoder(PATH)
    assert e.decode([None, -1, 10**9]) == ""
    assert e.decode([bpe.vocabulary(PATH).byte_id[0xFF]]) == "�"


def test_operators_on_odd_rows(spark, library):
    rows = [(i, x, 7, 8) for i, x in enumerate(ODD)] + [(None, "a b", 1, 1), (0, "", 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, token_ids int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, list(r.token_ids), r.decoded) for r in bpe.decode(bpe.encode(df, PATH), PATH).collect())
    want = sorted((i if i is not None else -1, ids := library.encode(x or "", add_special_tokens=False).ids, library.decode(ids, skip_special_tokens=False)) for i, x, *_ in rows)
    assert got == want
    at_once = sorted((r.doc_id if r.doc_id is not None else -1, list(r.token_ids), r.decoded) for r in bpe.encode_and_decode(df, PATH).collect())
    assert at_once == want and bpe.encode_and_decode(df.limit(0), PATH).count() == 0
    counted = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, PATH, limit=1024).collect())
    assert counted == sorted((i, len((dict(enumerate(ODD)) | {-1: "a b"})[i].encode() if (dict(enumerate(ODD)) | {-1: "a b"})[i] else b""), len(ids), len(ids) > 1024) for i, ids, _ in want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, PATH), PATH).count() == 0
    assert token_counts(df, PATH, limit=5).count() == 0


def test_queries_match_library(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    counts = {r.doc_id: r for r in queries.op5_token_counts(spark, sf_dir).collect()}
    rows = queries.op1_bpe(spark, sf_dir).collect()
    assert len(rows) == len(docs) == len(counts)
    for r in rows:
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        assert counts[r.doc_id].n_tokens == len(ids) and counts[r.doc_id].n_bytes == len((docs[r.doc_id] or "").encode())
