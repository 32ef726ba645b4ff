"""Numbers for rows in a global order, without gathering them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.storage import saved


def numbered(df: DataFrame, *order: str, name: str = "nth", within: str | None = None) -> DataFrame:
    """df with numbers from 1 in the order of the columns (``-x``: descending), apart for each value of within. Ranges are numbered apart, and moved by what lies before them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c[1:]).desc() if c[0] == "-" else F.col(c).asc() for c in order]
    key = [F.col(within)] if within else []
    ranged = saved(df.repartitionByRange(parts, *key, *by).withColumn("range_", F.spark_partition_id()), "ranges")
    at = ["range_", within] if within else ["range_"]
    counts = ranged.groupBy(*at).agg(F.count(F.lit(1)).alias("n_"))  # one row a range and value
    earlier = (Window.partitionBy(within) if within else Window.partitionBy()).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*at, F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("before_"))
    nth = F.row_number().over(Window.partitionBy(*at).orderBy(*by))
    return ranged.withColumn(name, nth.cast("long")).join(F.broadcast(before), at).withColumn(name, F.col("before_") + F.col(name)).select(*df.columns, name)


def first_rows(df: DataFrame, most: int, *order: str) -> DataFrame:
    """The first rows in an order, however many."""
    return numbered(df, *order, name="nth_").filter(F.col("nth_") <= most).drop("nth_")
