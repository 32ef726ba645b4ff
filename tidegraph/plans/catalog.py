"""Registered queries over the dated graph, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions import edges as fe
from tidegraph.functions.order import numbered
from tidegraph.operators import incremental as inc
from tidegraph.operators import scc as ops
from tidegraph.operators import time_coupled as tc
from tidegraph.plans import registry
from tidegraph.sources import graphs, reports
from tidegraph.storage import fresh_path, little_sent, saved, scratch
from tidegraph.streaming.maintain import follow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_NODE = "node AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(1980 + (p_partkey * 40) // (SELECT count(*) FROM part) AS BIGINT) AS y FROM part)"
_RAW = """raw AS (
  SELECT l_partkey AS s, l_partkey - 1 - (l_orderkey*7 + l_suppkey*13 + l_linenumber) % 80 AS t, l_orderkey % 10 AS b FROM lineitem WHERE l_orderkey % 17 = 0
  UNION ALL
  SELECT l_partkey AS s, l_partkey + 1 + (l_orderkey*5 + l_suppkey*11 + l_linenumber) % 12 AS t, l_orderkey % 10 AS b FROM lineitem WHERE l_orderkey % 31 = 1)"""
_EDGE = "edge AS (SELECT CAST(s AS BIGINT) AS s, CAST(t AS BIGINT) AS t, CAST(min(b) AS BIGINT) AS b FROM raw WHERE t >= 0 AND t < (SELECT count(*) FROM part) AND s <> t GROUP BY s, t)"
_BASE = f"WITH RECURSIVE {_NODE}, {_RAW}, {_EDGE}"
_DATED = "dated AS (SELECT e.s, e.t, a.y AS ys, b.y AS yt, CASE WHEN a.y < b.y THEN 'unorder' WHEN a.y = b.y THEN 'same' ELSE 'normal' END AS edge_class FROM edge e JOIN node a ON a.id = e.s JOIN node b ON b.id = e.t)"


def _closure(edge: str = "edge", tag: str = "") -> str:
    """Components of all nodes, by the closure of the edges."""
    return f"""r{tag}(s, t) AS (SELECT s, t FROM {edge} UNION SELECT r.s, e.t FROM r{tag} r JOIN {edge} e ON r.t = e.s),
mutual{tag} AS (SELECT a.s AS id, min(a.t) AS m FROM r{tag} a JOIN r{tag} b ON a.s = b.t AND a.t = b.s GROUP BY a.s),
comp{tag} AS (SELECT n.id, least(n.id, coalesce(m.m, n.id)) AS component FROM node n LEFT JOIN mutual{tag} m ON m.id = n.id)"""


def _parts(edge: str = "edge", tag: str = "") -> str:
    """The part of each node."""
    return f"""gm{tag}(id) AS (SELECT DISTINCT e.t AS id FROM {edge} e JOIN node a ON a.id = e.s JOIN node b ON b.id = e.t WHERE a.y < b.y
  UNION SELECT e.t FROM gm{tag} g JOIN {edge} e ON e.s = g.id),
gsi{tag} AS (SELECT DISTINCT e.t AS id FROM {edge} e JOIN node a ON a.id = e.s JOIN node b ON b.id = e.t WHERE a.y = b.y AND e.t NOT IN (SELECT id FROM gm{tag})),
parts{tag} AS (SELECT id, CASE WHEN id IN (SELECT id FROM gm{tag}) THEN 'gm' WHEN id IN (SELECT id FROM gsi{tag}) THEN 'gsi' ELSE 'gr' END AS part FROM node)"""


_BACKWARD = """bgm(id) AS (SELECT DISTINCT t AS id FROM dated WHERE edge_class = 'unorder' UNION SELECT e.s FROM bgm g JOIN edge e ON e.t = g.id),
bsame AS (SELECT s, t FROM dated WHERE edge_class = 'same' AND t NOT IN (SELECT id FROM bgm)),
seen AS (SELECT id FROM bgm UNION SELECT s FROM bsame UNION SELECT t FROM bsame)"""
_HISTOGRAM = "SELECT size, count(*) AS cnt FROM (SELECT component, count(*) AS size FROM {0} GROUP BY component) GROUP BY size"


def query(sql: str | None, *names: str) -> Callable:
    """Register a function under its own name, or under several, which it then gets first. Of what a query writes on its way, only the result stays."""

    def tidy(f: Callable, *first: str) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with little_sent(spark), scratch(spark) as keep:
                return keep(f(*first, spark, sf_dir))

        return run

    def put(f: Callable) -> Callable:
        for name in names or (f.__name__,):
            QUERIES[name] = tidy(f, name) if names else tidy(f)
            if sql:
                ORACLES[name] = sql
        return f

    return put


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and distinct edges, saved for queries that go over them several times."""
    nodes, _, edges = graphs.local_graph(spark, sf_dir)
    return saved(nodes, "nodes"), saved(edges, "edges")


def _grown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, the starting graph and the increment, saved likewise."""
    nodes, edges = _graph(spark, sf_dir)
    start, delta = graphs.split_increment(edges)
    return nodes, start, saved(delta, "increment")


@query(f"{_BASE} SELECT count(*) AS n_nodes, min(y) AS min_year, max(y) AS max_year FROM node")
def nodes_year_range(spark, sf_dir):
    return graphs.year_range(graphs.local_graph(spark, sf_dir)[0])


@query(f"{_BASE} SELECT count(*) AS n_edges, count(*) FILTER (b >= 3) AS n_start, CAST(sum(31*s + 17*t + b) AS BIGINT) AS checksum FROM edge")
def edge_counts(spark, sf_dir):
    edges = graphs.local_graph(spark, sf_dir)[2]
    return edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count(F.when(F.col("b") >= 3, 1)).alias("n_start"), F.sum(31 * F.col("src") + 17 * F.col("dst") + F.col("b")).alias("checksum"))


@query(f"{_BASE}, {_DATED} SELECT edge_class, count(*) AS cnt FROM dated GROUP BY edge_class")
def edge_class_counts(spark, sf_dir):
    nodes, _, edges = graphs.local_graph(spark, sf_dir)
    return tc.classes(nodes, edges).groupBy("edge_class").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"{_BASE}, {_DATED} SELECT ys - (SELECT min(y) FROM node) AS bucket, count(*) AS cnt FROM dated WHERE edge_class = 'same' GROUP BY ys")
def same_year_buckets(spark, sf_dir):
    nodes, _, edges = graphs.local_graph(spark, sf_dir)
    first = nodes.agg(F.min("year")).first()[0]
    return tc.classes(nodes, edges).filter("edge_class = 'same'").groupBy((F.col("y_src") - first).alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))


@query(f"{_BASE} SELECT CAST(l_partkey AS BIGINT) AS src, CAST(l_orderkey % 2000 AS BIGINT) AS dst FROM lineitem WHERE l_partkey <> l_orderkey % 2000")
def self_loop_filter(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return fe.without_loops(item.selectExpr("cast(l_partkey as long) as src", "cast(l_orderkey % 2000 as long) as dst"))


@query("""WITH node AS (SELECT CAST(p_partkey AS BIGINT) AS id, 1980 + p_size AS y FROM part),
raw AS (SELECT l_partkey AS s, (l_orderkey*7 + l_suppkey*13 + l_linenumber) % (SELECT count(*) FROM part) AS t, l_orderkey AS ok FROM lineitem)
SELECT DISTINCT CAST(s AS BIGINT) AS src, CAST(t AS BIGINT) AS dst FROM raw JOIN node a ON a.id = s JOIN node b ON b.id = t WHERE s <> t AND
((a.y > b.y AND ok % 23 = 0) OR (a.y = b.y AND ok % 3 = 0) OR (a.y < b.y AND ok % 115 = 0)) AND NOT (a.y < b.y AND b.y - a.y >= 10)""")
def year_gap_filter(spark, sf_dir):
    nodes, edges = graphs.long_range_graph(spark, sf_dir)
    return _pairs(fe.dated(edges, nodes).filter(fe.within_gap()))


@query(f"{_BASE}, ends AS (SELECT s, t FROM raw WHERE t >= 0 AND t < (SELECT count(*) FROM part) AND s <> t) SELECT CAST(id AS BIGINT) AS id, count(*) AS degree FROM (SELECT s AS id FROM ends UNION ALL SELECT t FROM ends) GROUP BY id")
def degree(spark, sf_dir):
    return fe.degree(graphs.local_graph(spark, sf_dir)[1])


@query(f"""{_BASE}, deg AS (SELECT n.id, count(e.x) AS d FROM node n LEFT JOIN (SELECT s AS x FROM edge UNION ALL SELECT t FROM edge) e ON e.x = n.id GROUP BY n.id),
top AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY d DESC, id) AS k FROM deg) WHERE k <= (SELECT count(*) FROM node) // 5),
inside AS (SELECT s, t, row_number() OVER (ORDER BY (s * 7919 + t * 104729) % 1000003, s, t) AS k FROM edge WHERE s IN (SELECT id FROM top) AND t IN (SELECT id FROM top))
SELECT s AS src, t AS dst FROM inside WHERE k <= (SELECT count(*) FROM edge) // 5""")
def degree_sample(spark, sf_dir):
    nodes, _, edges = graphs.local_graph(spark, sf_dir)
    return fe.degree_sample(nodes, edges, 0.2)


_ALL = f"{_BASE}, {_closure()}"


@query(f"{_ALL} SELECT id, component FROM comp", *[f"scc_members_{a}" for a in ("tarjan", "gabow", "kosaraju", "pearce", "pearce2")])
def _scc_members(name, spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return registry.static_members(name.removeprefix("scc_members_"), nodes, edges)


@query(f"{_ALL} SELECT id, component FROM comp")
def scc_members_distributed(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return ops.with_all(nodes, ops.scc_distributed(edges))


def _members(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return nodes, edges, ops.with_all(nodes, ops.scc(edges))


@query(f"{_ALL} {_HISTOGRAM.format('comp')}")
def scc_histogram(spark, sf_dir):
    return ops.histogram(_members(spark, sf_dir)[2])


@query(f"{_ALL} SELECT component, count(*) AS size FROM comp GROUP BY component HAVING count(*) > 1")
def scc_nontrivial(spark, sf_dir):
    return _members(spark, sf_dir)[2].groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")


_PARTED = f"{_BASE}, {_parts()}"


@query(f"{_PARTED} SELECT id FROM parts WHERE part = 'gm'")
def gm_nodes(spark, sf_dir):
    nodes, _, edges = graphs.local_graph(spark, sf_dir)
    return tc.gm(tc.classed_once(nodes, edges))


@query(f"{_PARTED} SELECT id FROM parts WHERE part = 'gsi'")
def gsi_nodes(spark, sf_dir):
    nodes, _, edges = graphs.local_graph(spark, sf_dir)
    classed = tc.classed_once(nodes, edges)
    return tc.gsi(classed, saved(tc.gm(classed), "gm"))


@query(f"{_PARTED} SELECT id FROM parts WHERE part = 'gr'")
def gr_nodes(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return tc.partition(nodes, edges).filter("part = 'gr'").select("id")


@query(f"{_PARTED}, {_closure()} SELECT part, count(*) AS n_nodes, count(DISTINCT component) AS n_components FROM parts JOIN comp USING (id) WHERE part <> 'gr' GROUP BY part")
def partition_counts(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return tc.component_counts(tc.tc_scc(nodes, edges))


@query(f"{_PARTED} SELECT (SELECT count(*) FROM parts WHERE part <> 'gr') AS nodes_visited, (SELECT count(*) FROM node) AS nodes_all, (SELECT count(*) FROM edge WHERE s IN (SELECT id FROM parts WHERE part <> 'gr')) AS edges_visited, (SELECT count(*) FROM edge) AS edges_all")
def access_ratio(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return tc.access(nodes, edges, tc.partition(nodes, edges))


_TC = f"{_PARTED}, {_closure()}"


@query(f"{_TC} SELECT id, component FROM comp WHERE id IN (SELECT id FROM parts WHERE part <> 'gr')", *[f"tc_members_{a}" for a in ("tarjan", "gabow", "pearce2")])
@query(f"{_BASE}, {_DATED}, {_BACKWARD}, {_closure()} SELECT id, component FROM comp WHERE id IN (SELECT id FROM seen)", "tc_members_kosaraju")
def _tc_members(name, spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return registry.static_members(name.replace("_members", ""), nodes, edges)


@query(f"{_TC} {_HISTOGRAM.format('(SELECT component FROM comp JOIN parts USING (id) WHERE part <> ' + chr(39) + 'gr' + chr(39) + ')')}")
def tc_histogram(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return ops.histogram(tc.tc_scc(nodes, edges))


_CEDGE = "cedge AS (SELECT DISTINCT a.component AS s, b.component AS t FROM edge e JOIN comp a ON a.id = e.s JOIN comp b ON b.id = e.t WHERE a.component <> b.component)"


@query(f"{_ALL}, {_CEDGE} SELECT s AS src, t AS dst FROM cedge")
def condensed_edges(spark, sf_dir):
    _, edges, members = _members(spark, sf_dir)
    return ops.condensed(edges, members)


@query(f"{_ALL}, o AS (SELECT component, count(*) AS n FROM edge JOIN comp ON id = s GROUP BY component), i AS (SELECT component, count(*) AS n FROM edge JOIN comp ON id = t GROUP BY component) SELECT c.component, CAST(coalesce(o.n, 0) AS BIGINT) AS out_degree, CAST(coalesce(i.n, 0) AS BIGINT) AS in_degree FROM (SELECT DISTINCT component FROM comp) c LEFT JOIN o USING (component) LEFT JOIN i USING (component)")
def scc_degrees(spark, sf_dir):
    _, edges, members = _members(spark, sf_dir)
    return ops.component_degrees(edges, members)


_LEVEL = f"{_ALL}, {_CEDGE}, lv(c, d) AS (SELECT DISTINCT component, 0 FROM comp UNION SELECT ce.s, lv.d + 1 FROM lv JOIN cedge ce ON ce.t = lv.c), lvl AS (SELECT c AS component, CAST(max(d) AS BIGINT) AS level FROM lv GROUP BY c)"


@query(f"{_LEVEL} SELECT component, level FROM lvl")
def topo_level(spark, sf_dir):
    _, edges, members = _members(spark, sf_dir)
    return ops.levels(members, ops.condensed(edges, members))


@query(f"{_LEVEL} SELECT component, row_number() OVER (ORDER BY level, component) AS rank FROM lvl")
def topo_rank(spark, sf_dir):
    _, edges, members = _members(spark, sf_dir)
    return numbered(ops.levels(members, ops.condensed(edges, members)), "level", "component", name="rank").select("component", "rank")


_SPACE = "space AS (SELECT id, CASE part WHEN 'gm' THEN CAST(-1 AS BIGINT) WHEN 'gsi' THEN 2 * y END AS space FROM parts JOIN node USING (id))"


@query(f"""{_BASE}, {_parts()}, {_closure()}, {_SPACE}, placed AS (SELECT DISTINCT component, space FROM comp JOIN space USING (id) WHERE space IS NOT NULL),
inner_edge AS (SELECT DISTINCT a.component AS s, b.component AS t FROM edge e JOIN comp a ON a.id = e.s JOIN comp b ON b.id = e.t JOIN placed p ON p.component = a.component JOIN placed q ON q.component = b.component WHERE a.component <> b.component AND p.space = q.space),
lv(c, d) AS (SELECT component, 0 FROM placed UNION SELECT ie.s, lv.d + 1 FROM lv JOIN inner_edge ie ON ie.t = lv.c), lvl AS (SELECT c AS component, max(d) AS level FROM lv GROUP BY c)
SELECT component, space, row_number() OVER (PARTITION BY space ORDER BY level, component) AS rank FROM lvl JOIN placed USING (component)""")
def topo_rank_by_part(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return inc.start(nodes, edges, coupled=True, by="level").order.withColumn("rank", (F.col("rank") / inc.GAP).cast("long"))  # without the gaps


_G0 = "start AS (SELECT s, t FROM edge WHERE b >= 3)"


@query(f"""{_BASE}, {_G0}, {_parts('start')} SELECT CASE WHEN p.part = 'gm' AND q.part = 'gm' THEN 1 WHEN q.part = 'gm' THEN 2 WHEN p.part = 'gm' THEN 3
WHEN p.part = 'gsi' AND q.part = 'gsi' THEN 4 WHEN p.part = 'gsi' OR q.part = 'gsi' THEN 5 ELSE 6 END AS type, count(*) AS cnt FROM edge e JOIN parts p ON p.id = e.s JOIN parts q ON q.id = e.t WHERE e.b < 3 GROUP BY 1""".replace("ELSE 6 END AS type", "ELSE 6 END::BIGINT AS type"))
def alg_type_counts(spark, sf_dir):
    nodes, start, delta = _grown(spark, sf_dir)
    return fe.insertion_type(delta, tc.partition(nodes, start)).groupBy("type").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"{_ALL} SELECT id, component FROM comp", *[f"inc_members_{a}" for a in registry.SINGLE if not a.startswith("dyn_")], *[f"inc_members_{a}" for a in registry.SINGLE if a.startswith("dyn_")])
def _inc_members(name, spark, sf_dir):
    return registry.maintained_members("inc", name.removeprefix("inc_members_"), *_grown(spark, sf_dir)).select("id", "component")


@query(f"{_ALL} SELECT id, component FROM comp", *[f"bat_members_{a.removeprefix('bat_')}" for a in registry.BATCH])
def _bat_members(name, spark, sf_dir):
    return registry.maintained_members("batch", name.replace("bat_members_", "bat_"), *_grown(spark, sf_dir), batch=BATCH).select("id", "component")


@query(f"{_ALL} SELECT id, component FROM comp")
def bat_members_distributed(spark, sf_dir):
    nodes, start, delta = _grown(spark, sf_dir)
    return inc.apply_batch(inc.start(nodes, start), delta)[0].members


@query(f"{_BASE}, {_parts()}, {_closure()} SELECT id, component, part FROM comp JOIN parts USING (id)")
def bat_members_distributed_tc(spark, sf_dir):
    """Two batches with time coupling, as sets: components and parts."""
    nodes, start, delta = _grown(spark, sf_dir)
    state, n = inc.start(nodes, start, coupled=True), delta.count()
    for part in inc.batches(delta, -(-n // 2) or 1, n):
        state, _ = inc.apply_batch(state, part)
    return state.members.join(state.parts.select("id", "part"), "id")


def _cut(n: int, percent: float) -> str:
    """Components after a share of the increment."""
    size = f"(SELECT count(*) FROM delta) * CAST({percent} AS DOUBLE) / 30"
    return f"cut{n} AS (SELECT s, t FROM edge WHERE b >= 3 UNION ALL SELECT s, t FROM delta WHERE seq < floor({size})), {_closure(f'cut{n}', str(n))}"


_DELTA = "delta AS (SELECT s, t, row_number() OVER (ORDER BY b, s, t) - 1 AS seq FROM edge WHERE b < 3)"
_CUTS = ", ".join(_cut(n, p) for n, p in enumerate(inc.CHECKPOINTS))


@query(f"{_BASE}, {_DELTA}, {_CUTS} " + " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS cut, size, cnt FROM ({_HISTOGRAM.format(f'comp{n}')})" for n in range(len(inc.CHECKPOINTS))))
def inc_checkpoints(spark, sf_dir):
    nodes, start, delta = _grown(spark, sf_dir)
    rows = registry.maintained_members("inc", "pk", nodes, start, delta, cuts=inc.checkpoints(delta.count(), -1))
    return rows.groupBy("cut", "component").agg(F.count(F.lit(1)).alias("size")).groupBy("cut", "size").agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT CAST(0 AS BIGINT) AS violations")
def inc_order_invariant(spark, sf_dir):
    nodes, start, delta = _grown(spark, sf_dir)
    state, n = inc.start(nodes, start), delta.count()
    for part in inc.batches(delta, -(-n // 2) or 1, n):
        state, _ = inc.apply_batch(state, part)
    return inc.violations(state)


def _cut_parts(n: int, percent: float) -> str:
    size = f"(SELECT count(*) FROM delta) * CAST({percent} AS DOUBLE) / 30"
    return f"cut{n} AS (SELECT s, t FROM edge WHERE b >= 3 UNION ALL SELECT s, t FROM delta WHERE seq < floor({size})), {_parts(f'cut{n}', str(n))}"


@query(f"{_BASE}, {_DELTA}, " + ", ".join(_cut_parts(n, p) for n, p in enumerate(inc.CHECKPOINTS)) + " " + " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS cut, id, part FROM parts{n}" for n in range(len(inc.CHECKPOINTS))))
def inc_parts(spark, sf_dir):
    """Parts after each checkpoint, kept up edge by edge, or from one checkpoint to the next."""
    nodes, start, delta = _grown(spark, sf_dir)
    return inc.parts_at(nodes, start, delta, inc.checkpoints(delta.count(), -1))


@query(f"""{_BASE}, {_G0}, {_closure('start')}, cedge AS (SELECT DISTINCT a.component AS s, b.component AS t FROM start e JOIN comp a ON a.id = e.s JOIN comp b ON b.id = e.t WHERE a.component <> b.component),
lv(c, d) AS (SELECT DISTINCT component, 0 FROM comp UNION SELECT ce.s, lv.d + 1 FROM lv JOIN cedge ce ON ce.t = lv.c), lvl AS (SELECT c AS component, max(d) AS level FROM lv GROUP BY c),
ranked AS (SELECT id, component, rank FROM comp JOIN (SELECT component, row_number() OVER (ORDER BY level, component) AS rank FROM lvl) USING (component))
SELECT count(*) FILTER (a.component <> b.component) AS inserted, count(*) FILTER (a.component <> b.component AND a.rank < b.rank) AS unsettled FROM edge e JOIN ranked a ON a.id = e.s JOIN ranked b ON b.id = e.t WHERE e.b < 3""")
def inc_metrics(spark, sf_dir):
    """The increment as one batch: edges between components, and those of them that lead upward in the first order."""
    rows = inc.first_faced(*_grown(spark, sf_dir))
    return rows.agg(F.count(F.lit(1)).alias("inserted"), F.count(F.when(F.col("r_src") < F.col("r_dst"), 1)).alias("unsettled"))


@query(f"""{_BASE}, {_DELTA}, {_G0}, {_parts('start')}, {_closure('start')}, {_SPACE}, placed AS (SELECT DISTINCT component, space FROM comp JOIN space USING (id) WHERE space IS NOT NULL),
inner_edge AS (SELECT DISTINCT a.component AS s, b.component AS t FROM start e JOIN comp a ON a.id = e.s JOIN comp b ON b.id = e.t JOIN placed p ON p.component = a.component JOIN placed q ON q.component = b.component WHERE a.component <> b.component AND p.space = q.space),
lv(c, d) AS (SELECT component, 0 FROM placed UNION SELECT ie.s, lv.d + 1 FROM lv JOIN inner_edge ie ON ie.t = lv.c), lvl AS (SELECT c AS component, max(d) AS level FROM lv GROUP BY c),
ranked AS (SELECT component, space, row_number() OVER (PARTITION BY space ORDER BY level, component) AS rank FROM lvl JOIN placed USING (component))
SELECT CASE p.space WHEN -1 THEN 'gm' ELSE 'gsi' END AS part, CASE WHEN p.space <> -1 THEN CAST(p.space // 2 AS BIGINT) END AS year, count(*) AS invalid
FROM delta e JOIN comp a ON a.id = e.s JOIN comp b ON b.id = e.t JOIN ranked p ON p.component = a.component JOIN ranked q ON q.component = b.component WHERE p.space = q.space AND p.rank < q.rank GROUP BY p.space""")
def inc_invalid_by_scope(spark, sf_dir):
    """The increment as one batch: edges that lead upward in the first order of their space, by part and year."""
    rows = inc.first_faced(*_grown(spark, sf_dir), coupled=True)
    return inc.by_scope(rows.filter("r_src < r_dst").groupBy("space").agg(F.count(F.lit(1)).alias("invalid")))


@query(f"{_LEVEL} SELECT row_number() OVER (ORDER BY level, component) AS rank, component FROM lvl")
def order_dump(spark, sf_dir):
    """Components in their order, written as text and read back."""
    _, edges, members = _members(spark, sf_dir)
    path = fresh_path(spark, "order")
    reports.write_order(numbered(ops.levels(members, ops.condensed(edges, members)), "level", "component", name="rank"), path)
    return spark.read.option("sep", "\t").schema("rank long, component long").csv(path)


#: Edges of a batch, and islands of the upward ones in the first order, merged by a running maximum.
BATCH = 100


@query(f"""{_BASE}, {_DELTA}, {_G0}, {_closure('start')}, cedge AS (SELECT DISTINCT a.component AS s, b.component AS t FROM start e JOIN comp a ON a.id = e.s JOIN comp b ON b.id = e.t WHERE a.component <> b.component),
lv(c, d) AS (SELECT DISTINCT component, 0 FROM comp UNION SELECT ce.s, lv.d + 1 FROM lv JOIN cedge ce ON ce.t = lv.c), lvl AS (SELECT c AS component, max(d) AS level FROM lv GROUP BY c),
ranked AS (SELECT id, component, rank FROM comp JOIN (SELECT component, row_number() OVER (ORDER BY level, component) AS rank FROM lvl) USING (component)),
batch AS (SELECT a.component <> b.component AS new, a.rank AS lo, b.rank AS hi FROM delta e JOIN ranked a ON a.id = e.s JOIN ranked b ON b.id = e.t WHERE e.seq < {BATCH}),
span AS (SELECT lo, hi, max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM batch WHERE new AND lo < hi)
SELECT (SELECT count(*) FROM batch WHERE new) AS inserted, count(*) AS invalid, count(*) FILTER (far IS NULL OR lo > far) AS islands FROM span""")
def bat_metrics(spark, sf_dir):
    """The first batch: edges between components, those that lead upward, and the islands that these make."""
    nodes, start, delta = _grown(spark, sf_dir)
    rows = inc.first_faced(nodes, start, delta.filter(F.col("seq") < BATCH))
    upward = rows.filter("r_src < r_dst")
    sums = rows.agg(F.count(F.lit(1)).alias("inserted"), F.count(F.when(F.col("r_src") < F.col("r_dst"), 1)).alias("invalid"))
    return sums.crossJoin(inc.islands(upward).agg(F.count(F.lit(1)).alias("islands")))  # one row each


@query("SELECT true AS same")
def histograms_agree(spark, sf_dir):
    """Whether the maintained components have the histogram of those found from scratch, with time coupling and without."""
    nodes, start, delta = _grown(spark, sf_dir)
    want = ops.histogram(ops.with_all(nodes, ops.scc(start.unionByName(delta.select("src", "dst")))))
    got = [ops.histogram(registry.maintained_members("batch", name, nodes, start, delta, batch=50)) for name in ("bat_pk2", "bat_cd4cg2")]
    return spark.createDataFrame([(all(ops.same_histogram(want, g) for g in got),)], "same boolean")


@query(f"{_BASE}, {_G0}, {_parts('start', '0')}, {_parts()} SELECT a.part AS part_before, b.part AS part_after, count(*) AS cnt FROM parts0 a JOIN parts b USING (id) GROUP BY 1, 2")
def inc_partition_migration(spark, sf_dir):
    """How nodes move between parts, as one set of edges comes in."""
    nodes, start, delta = _grown(spark, sf_dir)
    state = inc.start(nodes, start, coupled=True)
    after = inc.apply_batch(state, delta)[0].parts.select("id", F.col("part").alias("part_after"))
    return state.parts.select("id", F.col("part").alias("part_before")).join(after, "id").groupBy("part_before", "part_after").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"{_ALL} SELECT id, component FROM comp")
def stream_members(spark, sf_dir):
    nodes, start, delta = _grown(spark, sf_dir)
    folder = fresh_path(spark, "stream")
    delta.select("src", "dst").repartition(2).write.parquet(f"{folder}/edges")
    return follow(spark, f"{folder}/edges", folder, inc.start(nodes, start), files_per_batch=1).state().members


@query(f"{_ALL} SELECT id, component FROM comp")
def stream_members_restarted(spark, sf_dir):
    """A stream that ends after half of the files, goes on with the others, and finds none the third time."""
    nodes, start, delta = _grown(spark, sf_dir)
    folder, n = fresh_path(spark, "stream"), delta.count()
    state = inc.start(nodes, start)
    delta.filter(F.col("seq") < n // 2).select("src", "dst").write.parquet(f"{folder}/edges")
    follow(spark, f"{folder}/edges", folder, state)
    delta.filter(F.col("seq") >= n // 2).select("src", "dst").write.mode("append").parquet(f"{folder}/edges")
    follow(spark, f"{folder}/edges", folder, state)
    return follow(spark, f"{folder}/edges", folder, state).state().members


@query(f"{_BASE} SELECT id, y AS year FROM node")
def tsv_nodes(spark, sf_dir):
    """Nodes, written as tab-separated lines and read back."""
    path = f"{fresh_path(spark, 'tsv')}/{graphs.NODE_FILE}"
    graphs.write_pairs(graphs.local_graph(spark, sf_dir)[0], path)
    return graphs.read_nodes(spark, path)


@query(f"{_BASE} SELECT e.s AS src, e.t AS dst FROM edge e JOIN node a ON a.id = e.s JOIN node b ON b.id = e.t WHERE NOT (b.y - a.y >= 10)")
def tsv_edges(spark, sf_dir):
    """Edges, written as tab-separated lines and read back, less loops and those that simplifying drops."""
    nodes, _, edges = graphs.local_graph(spark, sf_dir)
    path = f"{fresh_path(spark, 'tsv')}/{graphs.EDGE_FILE}"
    graphs.write_pairs(_pairs(edges).unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))), path)
    return graphs.read_edges(spark, path, nodes, simplify=True)


@query(f"{_BASE}, {_DELTA} SELECT CAST(seq AS BIGINT) AS seq, s AS src, t AS dst FROM delta")
def tsv_increment(spark, sf_dir):
    """The increment, written in its order and numbered anew as it is read."""
    _, delta = graphs.split_increment(graphs.local_graph(spark, sf_dir)[2])
    path = f"{fresh_path(spark, 'tsv')}/{graphs.increment_name('', 'comb')}"
    graphs.write_pairs(delta, path, "seq")
    return graphs.read_increment(spark, path)


@query(f"{_ALL} {_HISTOGRAM.format('comp')}")
def histogram_sink(spark, sf_dir):
    """The histogram, written as text and read back."""
    path = fresh_path(spark, "histogram")
    reports.write_histogram(ops.histogram(_members(spark, sf_dir)[2]), path)
    return spark.read.option("sep", "\t").schema("size long, cnt long").csv(path)


@query(f"{_BASE}, {_DATED} SELECT s AS src, t AS dst FROM dated WHERE edge_class = 'unorder'")
def unorder_dump(spark, sf_dir):
    """Edges from older to newer nodes, written as text and read back."""
    nodes, _, edges = graphs.local_graph(spark, sf_dir)
    path = fresh_path(spark, "unordered")
    reports.write_unordered(tc.classes(nodes, edges), path)
    return spark.read.option("sep", "\t").schema("src long, dst long").csv(path)


@query(f"{_ALL} SELECT component, id FROM comp")
def component_list(spark, sf_dir):
    """Components with their nodes, written as text and read back."""
    path = fresh_path(spark, "components")
    reports.write_components(_members(spark, sf_dir)[2], path)
    return spark.read.option("sep", "\t").schema("component long, id long").csv(path)
