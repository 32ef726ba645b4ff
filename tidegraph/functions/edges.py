"""Columns and filters over dated edges. Nodes are (id, year); edges are (src, dst, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.order import first_rows

#: Fixed value: an edge from an older to a newer node that is so many years apart is dropped when simplifying.
YEAR_GAP = 10


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def listed(nodes: DataFrame, *edges: DataFrame) -> DataFrame:
    """nodes (id, year) and, with year 0, the ends of edges that aren't among them."""
    ends = [e.select(F.explode(F.array(F.col("src").cast("long"), F.col("dst").cast("long"))).alias("id")) for e in edges]
    more = ends[0] if len(ends) == 1 else ends[0].unionByName(ends[1])
    own = nodes.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("year").cast("long"), F.lit(0)).alias("year"))
    return own.unionByName(more.filter("id is not null").distinct().join(own.select("id"), "id", "left_anti").withColumn("year", F.lit(0).cast("long")))


def dated(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the years of both ends; a node that isn't listed has year 0."""
    for end, year in (("src", "y_src"), ("dst", "y_dst")):
        edges = edges.join(nodes.select(F.col("id").alias(end), F.col("year").alias(year)), end, "left").withColumn(year, F.coalesce(year, F.lit(0)))
    return edges


def edge_class() -> F.Column:
    """Of a dated edge: unorder (older to newer), same (year), or normal."""
    return F.when(F.col("y_src") < F.col("y_dst"), "unorder").when(F.col("y_src") == F.col("y_dst"), "same").otherwise("normal")


def within_gap(gap: int = YEAR_GAP) -> F.Column:
    """Of a dated edge: whether simplifying keeps it."""
    return ~((F.col("y_src") < F.col("y_dst")) & (F.col("y_dst") - F.col("y_src") >= gap))


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): ends that each node has, counting parallel edges and no loops."""
    return without_loops(edges).select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def spread(src: F.Column, dst: F.Column) -> F.Column:
    """A fixed scattering of edges, in place of random choice."""
    return (src * 7919 + dst * 104729) % 1000003


def degree_sample(nodes: DataFrame, edges: DataFrame, factor: float) -> DataFrame:
    """Edges among the floor(factor n) nodes of the highest degree (ties to smaller ids), at most floor(factor m) of them, by a fixed scattering."""
    ranked = nodes.select("id").join(degree(edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    top = first_rows(ranked, int(nodes.count() * factor), "-degree", "id").select("id")
    inner = edges.join(top.select(F.col("id").alias("src")), "src", "left_semi").join(top.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    return first_rows(inner.withColumn("spread", spread(F.col("src"), F.col("dst"))), int(edges.count() * factor), "spread", "src", "dst").select("src", "dst")


def insertion_type(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """edges with type 1 to 6 by the parts (gm, gsi, gr) of their ends: gm to gm, other to gm, gm to other, gsi to gsi, gsi and gr, gr to gr."""
    for end, part in (("src", "p_src"), ("dst", "p_dst")):
        edges = edges.join(parts.select(F.col("id").alias(end), F.col("part").alias(part)), end, "left").withColumn(part, F.coalesce(part, F.lit("gr")))
    s, t = F.col("p_src"), F.col("p_dst")
    kind = F.when((s == "gm") & (t == "gm"), 1).when(t == "gm", 2).when(s == "gm", 3).when((s == "gsi") & (t == "gsi"), 4).when((s == "gsi") | (t == "gsi"), 5).otherwise(6)
    return edges.withColumn("type", kind.cast("long"))
