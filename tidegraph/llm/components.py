"""Connected components of links between ids, by contraction; everything stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import release, salted, saved


def roots(parents: DataFrame) -> DataFrame:
    """(id, root) of (id, parent), where parents are smaller ids and a root is its own parent, or has no row, by pointer jumping."""
    now = saved(parents.select("id", F.col("parent").alias("root")), "roots")
    while True:
        up = now.select(F.col("id").alias("root"), F.col("root").alias("above"))
        now = saved(salted(now, up, ["root"], ["id"], how="left").select("id", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            release(now.sparkSession)
            return now.select("id", "root")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in the links (a, b); the component is its smallest id.

    In each round every id points to its smallest neighbour, if that is smaller; trees of pointers become single ids,
    and the links between those go on. Ids of one group of any size meet in sums only, never in one task: joins on roots
    and ends of links deal the rows of a hub over many tasks.
    """
    left = saved(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    done: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = roots(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("parent")))
        if done is None:
            done = step.withColumnRenamed("root", "component")
        else:
            up = step.select(F.col("id").alias("component"), F.col("root").alias("above"))
            done = salted(done, up, ["component"], ["id"], how="left").select("id", F.coalesce("above", "component").alias("component"))
        done = saved(done, "components")
        for end in ("a", "b"):
            left = salted(left, step.select(F.col("id").alias(end), F.col("root").alias(f"r{end}")), [end], ["b" if end == "a" else "a"])
        left = saved(left.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        release(left.sparkSession)  # rounds are many small jobs, whose plans and broadcasts else pile up in the driver
    return done if done is not None else links.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
