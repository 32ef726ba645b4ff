import hashlib
import re

import pytest

from tidegraph.llm import fill_in_middle as fim
from tidegraph.llm import queries

TEXTS = [None, "", "one", "  \t\n", "a b  c\nd ", "x <P> y", "<S>", "a <M", "é ü ß 漢字   z", "a\x00b\x0bc\x0cd\re", " lead and trail \n\n", "word " * 30_000, "w" * 200_000]


def plain(key, text):
    """By the definition, with the standard library only."""
    text = text or ""
    units = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
    h = [int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", text, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_outputs_and_round_trip(spark):
    rows = [(i * 17 + j, t, "x", 5) for i in range(12) for j, t in enumerate(TEXTS)]
    rows += [(None, "no id at all", "x", 5), (3, "a b  c\nd ", "x", 5), (3, "a b  c\nd ", "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    got = fim.restored(fim.fill_in_middle(df)).collect()
    want = sorted(((i, *plain("" if i is None else i, t)) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars) for r in got), key=str) == want
    texts = sorted(t or "" for _, t, *_ in rows)
    assert sorted(r.restored.text for r in got) == texts
    assert all(r.restored.sha256 == hashlib.sha256(r.restored.text.encode()).hexdigest() and r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rates_and_empty_tables(spark):
    df = spark.range(400).selectExpr("id as doc_id", "concat('a b c d ', id) as text")
    forms = [r.form for r in fim.fill_in_middle(df, rate=100, spm_rate=0, seed=7).collect()]
    assert set(forms) == {"psm"} and len(forms) == 400
    assert {r.form for r in fim.fill_in_middle(df, rate=0).collect()} == {"plain"}
    assert 0.4 < sum(r.form != "plain" for r in fim.fill_in_middle(df).collect()) / 400 < 0.6
    assert fim.restored(fim.fill_in_middle(df.limit(0))).count() == 0


def test_whole_query(spark, sf_dir):
    got = {r.doc_id: tuple(r) for r in queries.op11_fill_in_middle(spark, sf_dir).collect()}
    for r in queries.table(spark, sf_dir, "documents").collect():
        n, form, out, p, m = plain(r.doc_id, r.text)
        assert got.pop(r.doc_id) == (r.doc_id, n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert not got


@pytest.mark.parametrize(("prefix", "suffix", "middle"), [("<", "<S", "P>"), ("<S", "", "<"), ("", "S><P", ">"), ("<<", "<<", "<<")])
def test_parts_that_look_like_marks(prefix, suffix, middle):
    assert fim.rebuilt(f"<P>{prefix}<S>{suffix}<M>{middle}", "psm") == prefix + middle + suffix
    assert fim.rebuilt(f"<S>{suffix}<P>{prefix}<M>{middle}", "spm") == prefix + middle + suffix
