"""Tables between steps."""

from pyspark.sql import functions as F

from itemforge.llm.storage import materialise, scope


def test_large_tables_are_not_broadcast_by_the_size_of_their_files(spark):
    """Labels of consecutive ids are a hundredth of their rows on disk."""
    with scope(spark):
        large = materialise(spark.range(600_000).select("id", F.lit(0).cast("long").alias("label")), "large", None)
        small = materialise(spark.range(10), "small", None)
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan(large.join(large.groupBy("id").agg(F.max("label").alias("m")), "id"))
        assert "BroadcastHashJoin" in plan(spark.range(600_000).join(small, "id"))
        assert large.count() == 600_000
