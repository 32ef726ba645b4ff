import gzip
import hashlib
import random
import zlib

import pytest
from pyarrow import fs

from tidegraph.llm import queries, warc


def plain(pages, least=1000):
    """Rows by the rule, from (id, html) with distinct ids."""
    last = {}
    for i, t in pages:
        last[t or ""] = max(last.get(t or "", i), i)
    out = []
    for i, t in pages:
        raw = (t or "").encode()
        again = len(raw) >= least and last[t or ""] != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[t or ""] if again else None))
    return sorted(out)


def test_query(spark, sf_dir):
    pages = [(r.page_id, r.html) for r in queries.table(spark, sf_dir, "pages").collect()]
    rows = queries.op8_warc(spark, sf_dir)
    assert rows.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(tuple(r) for r in rows.collect()) == plain(pages)


def test_copies_and_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    r = random.Random(1)
    texts = [None, "", "é" * 499, "é" * 500, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 60, "a" * 300_000, "x\x00" * 700]
    pages = [(i, r.choice(texts)) for i in range(120)]
    df = spark.createDataFrame([(i, r.choice([None, "http://a/ü b\r\nX: y", "http://a/"]), t, "z", 1) for i, t in pages], "page_id long, url string, html string, digest string, n int")
    done = warc.archive(df.repartition(5), f"file://{tmp_path}")
    rows = warc.read(done.select("file"), f"file://{tmp_path}/warc").collect()
    assert sorted(tuple(x) for x in rows) == plain(pages)
    assert not (tmp_path / "monolithic").exists()
    for f in (tmp_path / "warc").glob("*.gz"):
        assert len(list(warc.records(iter([gzip.decompress(f.read_bytes())])))) == (tmp_path / "warc" / f"{f.name}.idx").read_text().count("\n")


def test_repeated_rows_and_null_ids(spark, tmp_path):
    big = "b" * 2000
    df = spark.createDataFrame([(1, "u", big)] * 3 + [(None, "u", big), (None, None, "small")], "page_id long, url string, html string")
    done = warc.archive(df.repartition(3), f"file://{tmp_path}")
    rows = [(x.id, x.record_type, x.refers_to) for x in warc.read(done.select("file"), f"file://{tmp_path}/warc").collect()]
    assert sorted(rows, key=str) == sorted([(1, "response", None), (1, "revisit", 1), (1, "revisit", 1), (None, "revisit", 1), (None, "response", None)], key=str)
    empty = warc.archive(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read(empty.select("file"), f"file://{tmp_path}/none/warc").count() == 0


def test_many_empty_pages_fill_several_archives(spark, tmp_path):
    """Records count, not payloads alone: files stay bounded where every page is empty."""
    df = spark.range(200_000).selectExpr("id as page_id", "cast(null as string) as url", "if(id % 2 = 0, '', null) as html").repartition(1)
    done = warc.archive(df, f"file://{tmp_path}").collect()
    assert len(done) == 4 and sum(r.records for r in done) == 200_000 and max(r.records for r in done) == warc.FILE_RECORDS
    rows = warc.read(spark.createDataFrame(done).select("file"), f"file://{tmp_path}/warc")
    assert rows.select("id").distinct().count() == 200_000 and {(r.payload_bytes, r.record_type) for r in rows.select("payload_bytes", "record_type").distinct().collect()} == {(0, "response")}


def test_whole_file_stream_becomes_members(tmp_path):
    made = [warc.response(i, f"0-0-{i}", "http://a/", bytes([i]) * (i * 5000)) for i in range(9)]
    for pack in (gzip.compress(b"".join(made)), b"".join(gzip.compress(x) for x in made)):
        (tmp_path / "one.gz").write_bytes(pack)
        assert warc.normalise_file(fs.LocalFileSystem(), f"{tmp_path}/one.gz", f"{tmp_path}/two.gz", {}) == 9
        got = list(warc.read_members(fs.LocalFileSystem(), f"{tmp_path}/two.gz"))
        assert [warc.record({k: v for k, v in h.items() if k != "Content-Length"}, b) for h, b in got] == made
    (tmp_path / "cut.gz").write_bytes(zlib.compress(b"".join(made)[:-9], wbits=31))
    with pytest.raises(ValueError, match="cut off"):
        warc.normalise_file(fs.LocalFileSystem(), f"{tmp_path}/cut.gz", f"{tmp_path}/three.gz", {})
