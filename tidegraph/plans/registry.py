"""Names of algorithms, and runs by name. Algorithms that differ only in how one machine searches share one plan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.edges import degree_sample, listed
from tidegraph.operators import incremental as inc
from tidegraph.operators.replay import Counts
from tidegraph.operators.scc import histogram, scc, with_all
from tidegraph.operators.time_coupled import access, classes, partition, tc_scc
from tidegraph.sources import graphs, reports
from tidegraph.storage import saved

#: The names that may be asked for.
STATIC = ("tarjan", "gabow", "kosaraju", "pearce", "pearce2", "tc_tarjan", "tc_gabow", "tc_kosaraju", "tc_pearce2")
SINGLE = ("ahrsz", "hkmst", "pk", "mnr", "tc_ahrsz", "tc_hkmst", "tc_pk", "tc_mnr", "dyn_pearce2", "dyn_tc_pearce2")
BATCH = ("bat_pk2", "bat_ahrsz", "bat_ahrsz_p", "bat_cd4cg", "bat_cd4cg2")
KINDS = {"static": STATIC, "inc": SINGLE, "batch": BATCH}
#: How single edges are searched, and how batches are settled, by name; tc_ before a name changes neither.
SEARCH = {"mnr": "forward", "pk": "both", "ahrsz": "two-way", "hkmst": "two-way"}
SETTLING = {"bat_pk2": "islands", "bat_ahrsz": "islands", "bat_ahrsz_p": "rounds", "bat_cd4cg": "rounds", "bat_cd4cg2": "islands"}


def check(kind: str, name: str) -> None:
    if kind not in KINDS:
        raise ValueError(f"unknown type of algorithm: {kind}")
    if name not in KINDS[kind]:
        raise ValueError(f"unknown {kind} algorithm: {name}")


def coupled(name: str) -> bool:
    """Whether a name maintains the time-coupled parts."""
    return name.startswith("tc_") or "cd4cg" in name


def method(name: str) -> dict[str, str]:
    """How a name settles what it inserts."""
    return {"search": SEARCH.get(name.removeprefix("tc_"), "two-way"), "settling": SETTLING.get(name, "single")}


def static_members(name: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): of all nodes, or, for time-coupled names, of those that the decomposition visits."""
    check("static", name)
    nodes = listed(nodes, edges)
    if name.startswith("tc_"):
        return tc_scc(nodes, edges, "backward" if name == "tc_kosaraju" else "forward").select("id", "component")
    return with_all(nodes, scc(edges))


@dataclass
class Recomputed:
    """One cut of the baseline: what both decompositions find, and the seconds that each took."""

    cut: int
    whole: DataFrame
    parted: DataFrame
    whole_seconds: float
    parted_seconds: float


def baseline(nodes: DataFrame, edges: DataFrame, delta: DataFrame, cuts: list[int]) -> Iterator[Recomputed]:
    """Both searches from scratch at each cut of the increment (seq, src, dst)."""
    for n, cut in enumerate(cuts):
        now = edges.unionByName(delta.filter(F.col("seq") < cut).select("src", "dst"))
        began = perf_counter()
        parted = saved(static_members("tc_pearce2", nodes, now), "parted")
        between = perf_counter()
        whole = saved(static_members("pearce2", nodes, now), "whole")
        yield Recomputed(n, whole, parted, perf_counter() - between, between - began)


def recomputed(nodes: DataFrame, edges: DataFrame, delta: DataFrame, cuts: list[int], parted: bool) -> tuple[DataFrame, list[Recomputed]]:
    """(cut, id, component) from scratch at each cut, and the runs."""
    runs, out = list(baseline(nodes, edges, delta, cuts)), None
    for r in runs:
        found = with_all(listed(nodes, edges, delta), r.parted if parted else r.whole).withColumn("cut", F.lit(r.cut).cast("long")).select("cut", "id", "component")
        out = found if out is None else out.unionByName(found)
    return out, runs


def maintained_members(kind: str, name: str, nodes: DataFrame, edges: DataFrame, delta: DataFrame, *, batch: int = 1, cuts: list[int] | None = None) -> DataFrame:
    """(cut, id, component) after each cut of the increment (seq, src, dst); without cuts, after all of it."""
    check(kind, name)
    cuts = [delta.count()] if cuts is None else cuts
    if name.startswith("dyn_"):
        return recomputed(nodes, edges, delta, cuts, name == "dyn_tc_pearce2")[0]
    rows = inc.maintained(nodes, edges, delta, batch=1 if kind == "inc" else batch, cuts=cuts, coupled=coupled(name), **method(name))
    return rows.filter("id is not null").select("cut", "id", "component")


@dataclass
class Config:
    """What a run needs; the flags of the command line have these names' first letters."""

    folder: str
    kind: str
    name: str
    increment_kind: str = ""
    increment_file: str = ""
    node_file: str = graphs.NODE_FILE
    edge_file: str = graphs.EDGE_FILE
    batch: int = 1
    percentage: float = 0
    simplify: bool = False
    scale: float = 1
    stop_at_blank: bool = False
    nodes: int | None = None

    def __post_init__(self) -> None:
        check(self.kind, self.name)
        if self.batch < 1 or not 0 < self.scale <= 1:
            raise ValueError(f"batch {self.batch}, scale {self.scale}")


@dataclass
class Result:
    general: dict[str, object] = field(default_factory=dict)
    static: dict[str, object] = field(default_factory=dict)
    dynamic: dict[str, object] = field(default_factory=dict)
    static_histogram: DataFrame | None = None
    dynamic_histogram: DataFrame | None = None
    members: DataFrame | None = None


def run(spark: SparkSession, c: Config) -> Result:
    """Read the files of a folder, run the algorithm, and gather what the report shows."""
    at = c.folder.rstrip("/")
    nodes = graphs.read_nodes(spark, f"{at}/{c.node_file}", stop_at_blank=c.stop_at_blank)
    if c.nodes is not None:  # ids 0 to n - 1; those that aren't listed have year 0
        nodes = spark.range(c.nodes).join(nodes, "id", "left").select("id", F.coalesce("year", F.lit(0)).cast("long").alias("year"))
    edges = graphs.read_edges(spark, f"{at}/{c.edge_file}", nodes, simplify=c.simplify, stop_at_blank=c.stop_at_blank)
    if c.scale < 1:
        edges = degree_sample(nodes, edges, c.scale)
    out, years = Result(), graphs.year_range(nodes).first()
    counts = {r.edge_class: r["count"] for r in classes(nodes, edges).groupBy("edge_class").count().collect()}
    first = c.name if c.kind == "static" else "tc_pearce2" if "tc_" in c.name or "cd4cg" in c.name else "pearce2"
    began = perf_counter()
    found = saved(static_members(first, nodes, edges), "found")
    took = perf_counter() - began
    out.static_histogram, out.members = histogram(found), found
    seen = access(nodes, edges, partition(nodes, edges) if first.startswith("tc_") else nodes.select("id", F.lit("gm").alias("part"))).first()
    out.general = {"folder": c.folder, "node file": c.node_file, "edge file": c.edge_file, "unorder edges": counts.get("unorder", 0), "same-year edges": counts.get("same", 0), "normal edges": counts.get("normal", 0), "simplified": c.simplify}
    out.static = {"algorithm": first, "seconds": round(took, 6), "nodes": seen.nodes_all, "edges": seen.edges_all, "first year": years.min_year, "last year": years.max_year, "nodes visited": seen.nodes_visited, "edges visited": seen.edges_visited, "share of nodes visited": round(seen.nodes_visited / max(seen.nodes_all, 1), 6), "share of edges visited": round(seen.edges_visited / max(seen.edges_all, 1), 6)}
    if c.kind == "static":
        return out
    name = graphs.increment_name(c.increment_file, c.increment_kind)
    delta = graphs.read_increment(spark, f"{at}/{name}", nodes, simplify=c.simplify, stop_at_blank=c.stop_at_blank) if name else spark.createDataFrame([], "seq long, src long, dst long")
    n, batch = delta.count(), 1 if c.kind == "inc" or c.percentage == 0 else c.batch
    if c.percentage == 0:
        delta = inc.strided(delta, n)
        n = delta.count()
    cuts = [n] if c.percentage == 0 else inc.checkpoints(n, c.percentage)
    began = perf_counter()
    out.dynamic = {"algorithm": c.name, "seconds": 0.0, "increment file": name, "cuts": " : ".join(map(str, cuts)), "batch": batch}
    if c.name.startswith("dyn_"):
        rows, runs = recomputed(nodes, edges, delta, cuts, c.name == "dyn_tc_pearce2")
        for k in ("parted_seconds", "whole_seconds"):
            out.dynamic[k.replace("_", " ")] = " : ".join(f"{getattr(r, k):.6f}" for r in runs)
    else:
        both = saved(inc.maintained(nodes, edges, delta, batch=batch, cuts=cuts, coupled=coupled(c.name), **method(c.name)), "maintained")
        rows, metrics = both.filter("id is not null"), both.filter("id is null").orderBy("cut").collect()  # one row a cut
        for f in fields(Counts):
            out.dynamic[f.name.replace("_", " ")] = " : ".join("-" if m[f.name] is None else f"{m[f.name]:.6f}" if isinstance(m[f.name], float) else str(m[f.name]) for m in metrics)
    out.dynamic["seconds"] = round(perf_counter() - began, 6)
    out.members = rows.filter(F.col("cut") == len(cuts) - 1).select("id", "component")
    out.dynamic_histogram = histogram(out.members)
    return out


def report(result: Result, c: Config, path: str) -> str:
    """Write the report into a folder; its text."""
    return reports.write(result, path, reports.file_name(c.kind, c.name, result.dynamic.get("cuts", "0"), c.batch, c.scale))
