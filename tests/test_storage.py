from pyspark.sql import functions as F

from tidegraph.storage import little_sent, saved


def test_larger_tables_are_not_sent_through_the_driver(spark):
    """Joins inside queries shuffle what has over 64 KB; the session's bound returns."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(name)
    table = saved(spark.range(100_000).select("id", F.xxhash64("id").alias("x")))
    joined = lambda: table.join(table.select("id", F.col("x").alias("y")), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in joined()
    with little_sent(spark):
        assert "Broadcast" not in joined()
    assert spark.conf.get(name) == was
