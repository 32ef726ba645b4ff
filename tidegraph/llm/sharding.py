"""Contiguous shards of near-equal bytes, from a global prefix sum of per-partition totals. DataFrame operations only.

Rows are put in one global order, by the hash of their text and then by id, so that equal texts stand together while
a large group of them still spreads over many range partitions. Each partition's bytes and rows are summed; the sums,
one row a partition, are added up to where each partition starts; a window within each partition does the rest. The
order is cut at equal byte targets. A cut that falls into a group of equal texts moves to the nearer end of the group
where the group is small against a shard (``slack``); a larger group is cut between two rows.

Texts of any length are whole; one that is longer than a shard's share fills it alone, and shards beside it may stay empty.
Null text has no bytes and size 1 (its CRC-32 is that of no bytes, 0). Repeated rows are rows of their own. A table
with fewer rows than shards leaves shards empty; an empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import saved


def _hash(text: F.Column) -> F.Column:
    """60 bits of the text's MD5; -1 without a text."""
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(-1))


def shard_by_bytes(df: DataFrame, n_shards: int, *, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.02) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row."""
    spark = df.sparkSession
    text = df[text_col].cast("string")
    rows = df.select(df[id_col].alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"), _hash(text).alias("h"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # what is written keeps each row's partition for good, however often it is read
    ordered = saved(rows.repartitionByRange(parts, "h", "id").withColumn("part", F.spark_partition_id()), "ranges")
    totals = ordered.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = totals.select("part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"))
    within = Window.partitionBy("part").orderBy("h", "id", "size", "crc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ordered.withColumns({"upto": F.sum("size").over(within), "nth": F.count(F.lit(1)).over(within)}).join(F.broadcast(starts), "part")
    placed = saved(placed.select("id", "size", "crc", "h", (F.col("bytes_before") + F.col("upto") - F.col("size")).alias("start"), (F.col("rows_before") + F.col("nth") - 1).alias("row")), "placed")

    cuts = _cuts(placed, n_shards, slack)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + F.when(F.col("start") >= cut, 1).otherwise(0)
    sharded = placed.withColumn("shard", shard.cast("int"))
    first = sharded.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row a shard
    return sharded.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def _cuts(placed: DataFrame, n_shards: int, slack: float) -> list[int]:
    """Byte positions at which shards 1, 2, ... start."""
    total = placed.agg(F.sum("size")).first()[0] or 0
    even = [-(-total * k // n_shards) for k in range(1, n_shards)]
    end = F.col("start") + F.col("size")
    inside = F.lit(False)
    for cut in even:
        inside = inside | ((F.col("start") <= cut) & (end > cut))
    at = placed.filter(inside).select("h").distinct()  # n_shards - 1 rows at most
    groups = placed.join(F.broadcast(at), "h").groupBy("h").agg(F.min("start").alias("lo"), F.max(end).alias("hi")).collect()
    most, cuts = slack * total / n_shards, []
    for cut in even:
        for g in groups:
            if g.lo < cut < g.hi and g.hi - g.lo <= most:
                cut = g.lo if cut - g.lo <= g.hi - cut else g.hi
                break
        cuts.append(cut)
    return cuts
