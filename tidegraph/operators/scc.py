"""Strongly connected components and their order."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.order import numbered
from tidegraph.operators import kernel
from tidegraph.storage import fresh_path, salted, saved

#: Rounds after which it is looked at how many edges still need following.
REST_ROUNDS = 4
#: Edges of a part below which more tasks gain nothing.
PART_ROWS = 100_000


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long"))


def fits(*rows: DataFrame) -> bool:
    """Whether so many rows may go to one task; all that are sent there are counted."""
    return sum(df.count() for df in rows) <= kernel.LOCAL_ROWS


def solved(edges: DataFrame, far: bool = False) -> DataFrame:
    """(id, component, level, rank) of the edges' nodes, and far if asked for, in one task."""
    return kernel.in_one_task(_pairs(edges), lambda t: kernel.solve(t.column(0).to_numpy(), t.column(1).to_numpy(), far), "id long, component long, level long, rank long" + ", far long" * far)


def scc(edges: DataFrame) -> DataFrame:
    """(id, component) of the edges' nodes; a component is known by its smallest id."""
    return solved(edges).select("id", "component") if fits(edges) else scc_distributed(edges)


def with_all(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, component) of all nodes; those that weren't found are their own component."""
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def trimmed(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Edges less those whose source nothing enters or whose target nothing leaves, again and again while that takes a tenth of the edges: such ends are components of their own."""
    n = edges.count()
    for _ in range(rounds):
        ins, outs = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = saved(edges.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"), "trim")
        was, n = n, edges.count()
        if not n or 10 * n > 9 * was:
            break
    return edges


def _reached_in_one_task(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    rows = _pairs(edges).withColumn("seed", F.lit(False)).unionByName(seeds.select(F.col("id").cast("long").alias("src"), F.col("id").cast("long").alias("dst")).withColumn("seed", F.lit(True)))

    def run(t: pa.Table) -> pa.Table:
        s, d, seed = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy()
        return pa.table({"id": kernel.reached(s[~seed], d[~seed], s[seed])})

    return kernel.in_one_task(rows, run, "id long")


def in_parts(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(part, src, dst): neighbours in the order of their sources lie in one part, as many as fit a task, or most. A source of many edges has several parts."""
    if fits(edges):
        return _pairs(edges).withColumn("part", F.lit(0).cast("long"))
    return saved(numbered(_pairs(edges), "src", "dst", name="part").select(F.expr(f"(part - 1) div {most or kernel.LOCAL_ROWS}").alias("part"), "src", "dst"), "parts")


def _share(edges: DataFrame) -> int:
    """Edges of a part where values stay near, so that all tasks have one: as many as fit a task at most, and PART_ROWS at least if these fit."""
    return min(kernel.LOCAL_ROWS, max(PART_ROWS, -(-edges.count() // int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def _carried(edges: DataFrame, front: DataFrame, gain: int) -> DataFrame:
    """(id, value): what paths inside the parts of edges (part, src, dst) bring from the front (id, value) that is more than arrived there. Parts that the front doesn't enter aren't looked at."""
    arrived = edges.select("part", F.col("src").alias("id")).distinct().join(front, "id").select(F.col("part").alias("entered"), "id", "value")
    touched = edges.join(arrived.select(F.col("entered").alias("part")).distinct(), "part", "left_semi").select("part", "src", "dst")

    def run(e: pa.Table, a: pa.Table) -> pa.Table:
        return kernel.carried(*(e.column(x).to_numpy() for x in ("src", "dst")), *(a.column(x).to_numpy() for x in ("id", "value")), gain)

    return touched.groupBy("part").cogroup(arrived.groupBy("entered")).applyInArrow(run, "id long, value long")


def spread(edges: DataFrame, start: DataFrame, gain: int = 0, rest: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None, most: int | None = None) -> DataFrame:
    """(id, value): the greatest that start (id, value) and paths from there bring to each node, gain more with every edge; with a gain, edges hold no cycle.

    Edges lie in parts. A round carries new values along all paths inside each part that they enter; what grew is written
    and goes on to other parts. So rounds count how often a path changes parts, not its edges. ``rest`` gives the edges
    that still need following after so many rounds, by what is known; as soon as they fit, one task ends it. most: edges
    of a part, as many as fit a task if it isn't given.
    """
    spark, folder, k, ended = edges.sparkSession, fresh_path(edges.sparkSession, "spread"), 0, False
    read = lambda at="": spark.read.schema("id long, value long").option("recursiveFileLookup", True).parquet(folder + at)
    known = lambda: read().groupBy("id").agg(F.max("value").alias("value"))
    start.groupBy(F.col("id").cast("long").alias("id")).agg(F.max(F.col("value").cast("long")).alias("value")).write.parquet(f"{folder}/0")
    left, front = in_parts(edges, most), read("/0")
    while not ended and not front.isEmpty():
        if rest and k % REST_ROUNDS == REST_ROUNDS - 1:
            left = saved(rest(left, known(), k).select("part", "src", "dst"), "left")
            ended = fits(left, front)
            if ended:
                left = left.withColumn("part", F.lit(0).cast("long"))
        k += 1
        best = _carried(left, front, gain).groupBy("id").agg(F.max("value").alias("value"))
        grown = best.join(known().withColumnRenamed("value", "was"), "id", "left").filter("was is null or value > was")
        grown.select("id", "value").write.parquet(f"{folder}/{k}")
        front = read(f"/{k}")
    return known()


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): seeds (id), and what paths lead to from them. Of a large graph, edges into what was reached need no following."""
    seeds = seeds.select(F.col("id").cast("long").alias("id")).distinct()
    if fits(edges, seeds):
        return _reached_in_one_task(edges, seeds)
    unmet = lambda left, known, _: left.join(known.select(F.col("id").alias("dst")), "dst", "left_anti")
    return spread(edges, seeds.withColumn("value", F.lit(1)), rest=unmet).select("id")


def mixed(name: str, k: int) -> Column:
    """Another long for each long of a column, in an order that k chooses: either half takes a hash of the other."""
    low, high = F.col(name).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(name, 32)
    cut = lambda half: F.xxhash64(half, F.lit(k)).bitwiseAND(F.lit(0xFFFFFFFF))
    high = high.bitwiseXOR(cut(low))
    low = low.bitwiseXOR(cut(high))
    return F.shiftleft(high.bitwiseXOR(cut(low)), 32).bitwiseOR(low)


def contracted(edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct edges (src, dst) after each cycle that a range of ids holds has become its smallest id, and (id, component) of the nodes that went.

    Nodes lie in ranges in the order of their ids, each with its edges out, half as many rows as fit a task. Edges inside a
    range are at most those and, of its last node, one to each other node of the range. With an odd k, ranges begin halfway.
    """
    half = max(kernel.LOCAL_ROWS // 2, 1)
    rows = edges.unionByName(edges.select(F.explode(F.array("src", "dst")).alias("src")).distinct().withColumn("dst", F.lit(None).cast("long")))
    place = numbered(rows, "src", "dst").groupBy("src").agg(F.min("nth").alias("nth"))
    place = saved(place.select(F.col("src").alias("id"), F.expr(f"(nth - 1 + {k % 2 * (half // 2)}) div {half}").alias("at")), "places")
    inside = salted(edges, place.toDF("src", "at"), ["src"], ["dst"])
    inside = salted(inside, place.toDF("dst", "to"), ["dst"], ["src"]).filter("at = to")

    def run(t: pa.Table) -> pa.Table:
        found = kernel.solve(t.column("src").to_numpy(), t.column("dst").to_numpy())
        return found.filter(pc.not_equal(found["id"], found["component"])).select(["id", "component"])

    went = saved(inside.groupBy("at").applyInArrow(run, "id long, component long"), "went")
    if went.isEmpty():
        return edges, went
    for end in ("src", "dst"):  # a large component's edges keep their own ends until here, so no key is hotter than a node
        other = "dst" if end == "src" else "src"
        edges = salted(edges, went.withColumnRenamed("id", end), [end], [other], how="left").select(F.coalesce("component", end).alias(end), other)
    return saved(edges.filter("src <> dst").distinct(), "contracted"), went


def scc_distributed(edges: DataFrame) -> DataFrame:
    """scc for graphs of any size: trim, and merge cycles inside ranges of ids while that takes a tenth of the edges; then spread the greatest colour of any ancestor, and take what reaches a colour's own node backward within the colour; again with the rest.

    Colours are ids in another order each time, so a chain of components falls apart in pieces instead of losing one a time.
    """
    edges = saved(_pairs(edges).filter("src <> dst").distinct(), "edges")
    everyone = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    spark, folder, k, left = edges.sparkSession, fresh_path(edges.sparkSession, "components"), 0, trimmed(edges)
    large = not fits(edges)  # a small graph is only here to be solved without that one task
    merged, idle = [], 0 if kernel.LOCAL_ROWS >= 6 else 2  # a cycle's nodes have two rows each or more, so ranges of two rows hold none
    while not left.isEmpty():  # a round writes what it found only; its nodes leave the graph
        small = fits(left)
        if small and (large or k or merged):
            solved(left).select("id", "component").write.parquet(f"{folder}/{k}")
            k += 1
            break
        if not small and idle < 2:  # both ways of cutting ranges have to fail
            was = left.count()
            left, went = contracted(left, len(merged))
            merged.append(went)
            if went.isEmpty():
                idle += 1
                continue
            left = trimmed(left)
            idle = idle + 1 if 10 * left.count() > 9 * was else 0
            continue
        ends = left.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        colour = saved(spread(left, ends.withColumn("value", mixed("id", k))).withColumnRenamed("value", "colour"), "colour")
        within = left.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("d")), "dst").filter("c = d")
        back = saved(within.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "back")
        found = saved(reach(back, colour.filter(F.col("colour") == mixed("id", k)).select("id")).join(colour, "id"), "found")
        names = found.groupBy("colour").agg(F.min("id").alias("component"))
        salted(found, names, ["colour"], ["id"]).select("id", "component").write.parquet(f"{folder}/{k}")
        k, idle = k + 1, 1 if any(not went.isEmpty() for went in merged) else 2
        left = back.select(F.col("dst").alias("src"), F.col("src").alias("dst"))  # no cycle leaves its colour
        left = left.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti")
        left = trimmed(saved(left.select("src", "dst"), "left"))
    known = spark.read.schema("id long, component long").option("recursiveFileLookup", True).parquet(folder) if k else spark.createDataFrame([], "id long, component long")
    for went in reversed(merged):  # a node that went is where its new name is in the end
        of = salted(went.toDF("id", "now"), known.toDF("now", "component"), ["now"], ["id"], how="left")
        known = saved(known.unionByName(of.select("id", F.coalesce("component", "now").alias("component"))), "known")
    return with_all(everyone, known)


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(src, dst): distinct edges between different components."""
    for end in ("src", "dst"):
        edges = edges.join(components.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}")), end)
    return edges.filter("c_src <> c_dst").select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).distinct()


def component_degrees(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, out_degree, in_degree): edges that leave, and enter, the members of each component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e")).select("e.*")
    sums = ends.groupBy("id").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    return components.join(sums, "id", "left").groupBy("component").agg(F.coalesce(F.sum("out"), F.lit(0)).alias("out_degree"), F.coalesce(F.sum("in"), F.lit(0)).alias("in_degree"))


def levels(components: DataFrame, between: DataFrame) -> DataFrame:
    """(component, level): the longest path of each component to a sink of the condensed graph.

    In a large graph, paths grow from their ends. After k rounds a component whose path is shorter than k has its final
    level, and all it leads to has seen that.
    """
    names = components.select(F.col("component").cast("long").alias("component")).distinct()
    if fits(between):
        found = solved(between).select(F.col("id").alias("component"), "level")
    else:
        ends = between.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        longer = lambda left, known, k: left.join(known.filter(F.col("value") >= k).select(F.col("id").alias("src")), "src", "left_semi")
        found = spread(between.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ends.withColumn("value", F.lit(0)), 1, longer).select(F.col("id").alias("component"), F.col("value").alias("level"))
    return names.join(found, "component", "left").select("component", F.coalesce("level", F.lit(0)).cast("long").alias("level"))


def places(components: DataFrame, between: DataFrame) -> DataFrame:
    """(component, level, far): the greatest name that each component leads to, its own included, and the longest path to a sink among those of one such name. No edge leads to a greater name, and one inside a name leads to a lower level."""
    names = components.select(F.col("component").cast("long").alias("component")).distinct()
    if fits(between):
        found = solved(between, far=True).select(F.col("id").alias("component"), "level", "far")
        return names.join(found, "component", "left").select("component", F.coalesce("level", F.lit(0)).cast("long").alias("level"), F.coalesce("far", "component").alias("far"))
    names = saved(names, "names")
    back = between.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    far = saved(spread(back, names.select(F.col("component").alias("id"), F.col("component").alias("value")), most=_share(back)).toDF("component", "far"), "far")
    inside = between
    for end in ("src", "dst"):
        inside = inside.join(far.select(F.col("component").alias(end), F.col("far").alias(f"f_{end}")), end)
    n = max(int(between.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * between.count() // kernel.LOCAL_ROWS))
    inside = saved(inside.filter("f_src = f_dst").select("src", "dst", F.pmod(F.xxhash64("f_src"), F.lit(n)).alias("dealt")), "inside")
    if inside.groupBy("dealt").count().filter(F.col("count") > kernel.LOCAL_ROWS).isEmpty():
        level = inside.groupBy("dealt").applyInArrow(lambda t: kernel.solve(t.column("src").to_numpy(), t.column("dst").to_numpy()).select(["id", "level"]), "id long, level long").withColumnRenamed("id", "component")
    else:
        level = levels(names, inside.select("src", "dst"))
    return far.join(level, "component", "left").select("component", F.coalesce("level", F.lit(0)).cast("long").alias("level"), "far")


def histogram(components: DataFrame) -> DataFrame:
    """(size, cnt): how many components have each size."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("cnt"))


def same_histogram(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
