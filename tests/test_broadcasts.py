"""What goes through the driver is measured in rows, not in compressed bytes."""

from pyspark.sql import functions as F


def test_a_small_file_with_many_rows_is_not_broadcast(spark, stages):
    key = F.sha2((F.col("id") % 50).cast("string"), 256)      # repeats, so the file is small
    many = stages.save(spark.range(400_000).select("id", key.alias("group_id"), F.repeat(key, 4).alias("note")), "many")
    more = stages.save(spark.range(500_000).select("id"), "more")
    assert "BroadcastHashJoin" not in more.join(many, "id")._jdf.queryExecution().executedPlan().toString()
    few = stages.save(spark.range(10).select("id"), "few")
    assert "BroadcastHashJoin" in more.join(few, "id")._jdf.queryExecution().executedPlan().toString()
