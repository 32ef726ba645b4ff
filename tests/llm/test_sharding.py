import zlib
from collections import defaultdict

from tidegraph.llm import queries
from tidegraph.llm.sharding import shard_by_bytes


def check(rows, texts, n, slack=0.02):
    """rows: (id, size, crc, shard, slot); texts: by id, ids unique."""
    assert len(rows) == len(texts)
    slots, size, homes = defaultdict(list), defaultdict(int), defaultdict(set)
    for i, s, crc, shard, slot in rows:
        raw = (texts[i] or "").encode()
        assert (s, crc) == (len(raw) + 1, zlib.crc32(raw)) and 0 <= shard < n
        slots[shard].append(slot)
        size[shard] += s
        homes[texts[i]].add(shard)
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    total, most = sum(size.values()), max((len((t or "").encode()) + 1 for t in texts.values()), default=0)
    for k in range(n):
        assert abs(size[k] - total / n) <= most + slack * total / n + 1
    for t, where in homes.items():
        group = sum(len((x or "").encode()) + 1 for x in texts.values() if x == t)
        assert len(where) == 1 or group > slack * total / n


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    rows = queries.op6_sharding(spark, sf_dir).collect()
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    check([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows], texts, 8)


def test_odd_rows(spark):
    texts = {i: "copy" for i in range(200)} | {i: f"text {i} é" * (i % 7) for i in range(200, 600)} | {600: None, 601: "", 602: "x" * 3000}
    df = spark.createDataFrame([(i, t, i, i) for i, t in texts.items()], "doc_id long, text string, size int, part int")
    check([tuple(r) for r in shard_by_bytes(df, 8).collect()], texts, 8)


def test_a_text_longer_than_a_shard(spark):
    """It goes to one shard whole; the shards that its bytes span beside that one stay empty, and slots have no gaps."""
    texts = {i: f"text {i}" for i in range(300)} | {300: "long " * 8000, 301: None}
    rows = [tuple(r) for r in shard_by_bytes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 8).collect()]
    check(rows, texts, 8)
    assert len({r[3] for r in rows}) < 8 and [r[1] for r in rows if r[0] == 300] == [40001]


def test_repeated_rows_and_small_tables(spark):
    df = spark.createDataFrame([(1, "a")] * 40 + [(None, "b")], "doc_id long, text string")
    rows = shard_by_bytes(df, 4).collect()
    assert len(rows) == 41 and {(r.shard, r.slot) for r in rows}.__len__() == 41
    assert shard_by_bytes(df.limit(0), 4).count() == 0
    assert [(r.shard, r.slot) for r in shard_by_bytes(df.limit(1), 4).collect()] == [(0, 0)]
