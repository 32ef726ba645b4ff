import os

import pytest

from tests.helpers import closure_components, parts
from tests.test_graph import DELTA, START, YEARS, pairs
from tidegraph.__main__ import main
from tidegraph.operators.incremental import start, violations
from tidegraph.plans import registry
from tidegraph.sources import graphs, reports
from tidegraph.storage import filesystem
from tidegraph.streaming import maintain
from tidegraph.streaming.maintain import follow


def put(path, rows, blank=None):
    lines = ["\t".join(map(str, r)) for r in rows]
    if blank is not None:
        lines.insert(blank, "")
    path.write_text("\n".join(lines) + "\n")


def test_readers(spark, tmp_path):
    put(tmp_path / "n.txt", [(0, 1990), (1, 2005), (0, 2000)], blank=2)
    put(tmp_path / "e.txt", [(0, 1), (1, 1), (0, 1), (1, 0), (5, 1)], blank=3)
    read = lambda **k: pairs(graphs.read_nodes(spark, f"{tmp_path}/n.txt", **k), "id", "year")
    assert read() == {(0, 2000), (1, 2005)} and read(stop_at_blank=True) == {(0, 1990), (1, 2005)}
    nodes = graphs.read_nodes(spark, f"{tmp_path}/n.txt")
    assert sorted(tuple(r) for r in graphs.read_edges(spark, f"{tmp_path}/e.txt").collect()) == [(0, 1), (0, 1), (1, 0), (5, 1)]
    assert graphs.read_edges(spark, f"{tmp_path}/e.txt", stop_at_blank=True).count() == 2
    assert pairs(graphs.read_edges(spark, f"{tmp_path}/e.txt", nodes, simplify=True), "src", "dst") == {(0, 1), (1, 0)}  # year 0 to 2005 is too far
    with pytest.raises(ValueError, match="simplify"):
        graphs.read_edges(spark, f"{tmp_path}/e.txt", simplify=True)
    assert [tuple(r) for r in graphs.read_increment(spark, f"{tmp_path}/e.txt").orderBy("seq").collect()] == [(0, 0, 1), (1, 0, 1), (2, 1, 0), (3, 5, 1)]


def test_increment_names():
    assert [graphs.increment_name("", k) for k in ("seq", "rand", "comb", "")] == ["inc_s30.txt", "inc_r30.txt", "inc_c30.txt", ""]
    assert graphs.increment_name("own.txt", "seq") == "own.txt"
    with pytest.raises(ValueError, match="kind"):
        graphs.increment_name("", "other")


def test_names_are_checked():
    for kind, name in (("static", "pk"), ("other", "pk"), ("batch", "pearce2"), ("static_def", "tarjan")):
        with pytest.raises(ValueError, match="unknown"):
            registry.Config("f", kind, name)
    with pytest.raises(ValueError, match="batch"):
        registry.Config("f", "inc", "pk", batch=0)


def test_runs_and_reports(spark, tmp_path):
    put(tmp_path / graphs.NODE_FILE, YEARS.items())
    put(tmp_path / graphs.EDGE_FILE, START)
    put(tmp_path / "inc_c30.txt", DELTA)
    c = registry.Config(str(tmp_path), "static", "tc_pearce2", nodes=12)
    body = registry.report(registry.run(spark, c), c, str(tmp_path / "out"))
    assert "unorder edges: 1" in body and "\n4\t1" in body and len(list((tmp_path / "out").iterdir())) == 1
    c = registry.Config(str(tmp_path), "batch", "bat_cd4cg", "comb", batch=3, percentage=30)
    result = registry.run(spark, c)
    assert pairs(result.dynamic_histogram, "size", "cnt") == {(2, 1), (10, 1)} and result.dynamic["inserted"] == "6"
    assert "10\t1" in reports.text(result)
    reports.write_histogram(result.dynamic_histogram, f"{tmp_path}/h")
    assert [r.value for r in spark.read.text(f"{tmp_path}/h").collect()] == ["2\t1", "10\t1"]


def test_command_line(spark, tmp_path, capsys):
    """A relative folder, the plain baseline, and the report beside the data."""
    put(tmp_path / graphs.NODE_FILE, YEARS.items())
    put(tmp_path / graphs.EDGE_FILE, START)
    put(tmp_path / "inc_c30.txt", DELTA)
    for name, kind in (("dyn_tc_pearce2", "inc"), ("tc_ahrsz", "inc")):
        main(["-f", os.path.relpath(tmp_path), "-t", kind, "-a", name, "-p", "comb", "-c", "30"])
        out = capsys.readouterr().out
        assert "10\t1" in out and ("whole seconds" in out) == (kind == "inc" and name.startswith("dyn"))
    assert len(list(tmp_path.glob("inc-*.txt"))) == 2


def test_component_lists(spark, tmp_path):
    reports.write_components(spark.createDataFrame([(3, 1), (1, 1), (2, 2)], "id long, component long"), f"{tmp_path}/c")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/c").collect()) == ["1\t1", "1\t3", "2\t2"]


def test_paths():
    assert filesystem("file:///a/b/")[1] == "/a/b" and filesystem("/a/b")[1] == "/a/b" and filesystem("a")[1].endswith("/a")


@pytest.mark.parametrize("coupled", [False, True])
def test_stream(spark, tmp_path, coupled):
    """Restarts go on from the newest version, with new files or without; a version that isn't complete doesn't count."""
    nodes = spark.createDataFrame(list(YEARS.items()), "id long, year long")
    first = start(nodes, spark.createDataFrame(START, "src long, dst long"), coupled=coupled)
    run = lambda: follow(spark, f"{tmp_path}/edges", f"{tmp_path}", first, files_per_batch=1)
    spark.createDataFrame(DELTA[:4], "src long, dst long").repartition(2).write.parquet(f"{tmp_path}/edges")
    middle = {(v, c) for v, c in closure_components(YEARS, START + DELTA[:4]).items()}
    assert pairs(run().state().members, "id", "component") == middle
    (tmp_path / "state" / "v=7").mkdir()
    assert pairs(run().state().members, "id", "component") == middle
    spark.createDataFrame(DELTA[4:], "src long, dst long").write.mode("append").parquet(f"{tmp_path}/edges")
    kept = run()
    assert pairs(kept.state().members, "id", "component") == {(v, 10 if v > 9 else 0) for v in YEARS}
    if coupled:
        assert pairs(kept.state().parts, "id", "part") == set(parts(YEARS, START + DELTA).items())
    version = kept.version
    kept.apply(spark.createDataFrame(DELTA, "src long, dst long"), 0)  # a repeated batch changes nothing
    assert pairs(kept.state().members, "id", "component") == {(v, 10 if v > 9 else 0) for v in YEARS}
    assert kept.versions()[-2:] == [version, version + 1] and kept.versions(whole=True) == [-1]


def test_micro_batches_write_what_changed(spark, tmp_path, monkeypatch):
    """One edge of a large graph writes a few rows; after some versions the state is written whole, and old versions go."""
    monkeypatch.setattr(maintain, "COMPACT", 2)
    n = 3000
    nodes = spark.range(n).selectExpr("id", "2000 + id div 100 as year")
    edges = spark.range(1, n).selectExpr("id as src", "id - 1 as dst")
    kept = maintain.Maintained(spark, f"{tmp_path}/state", start(nodes, edges))
    want = {v: v for v in range(n)}
    for k, (a, b) in enumerate([(500, 502), (1000, 1001), (501, 503), (7, 9)]):
        kept.apply(spark.createDataFrame([(a, b)], "src long, dst long"), k)
        least = min(want[v] for v in range(a, b + 1))
        want.update({v: least for v in range(a, b + 1)})
        if k == 0:
            assert sum(spark.read.parquet(f"{tmp_path}/state/v=0/{t}").count() for t in ("members", "order", "edges")) < 100
    assert dict(pairs(kept.state().members, "id", "component")) == want and violations(kept.state()).first().violations == 0
    assert kept.versions() == [2, 3, 4, 5] and kept.versions(whole=True) == [2, 5]


def test_small_files_share_a_micro_batch(spark, tmp_path):
    """Each micro-batch goes over the whole state, so their number follows the bytes that come in, not the files; a restart takes what is new."""
    nodes, edges = spark.createDataFrame([(v, 2000) for v in range(9)], "id long, year long"), spark.createDataFrame([(0, 1)], "src long, dst long")
    first = start(nodes, edges)
    more = spark.createDataFrame([(v, v + 1) for v in range(1, 8)], "src long, dst long")
    more.repartitionByRange(4, "src").write.parquet(f"{tmp_path}/edges")
    assert follow(spark, f"{tmp_path}/edges", f"{tmp_path}", first).version == 0
    spark.createDataFrame([(8, 3)], "src long, dst long").write.mode("append").parquet(f"{tmp_path}/edges")
    kept = follow(spark, f"{tmp_path}/edges", f"{tmp_path}", first)
    assert kept.version == 1 and {(r.id, r.component) for r in kept.state().members.collect()} == {(v, min(v, 3)) for v in range(9)}
