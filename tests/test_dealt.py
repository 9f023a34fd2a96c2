from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill import queries as Q
from glyphmill.caching import settings
from glyphmill.operators import intervals as I


def test_tasks_grow_with_the_input(spark):
    """Rows of a task, and with them its memory, stay as they are; a key is in one task."""
    counts = []
    for n in (1 << 19, 1 << 21):
        rows = I.dealt(spark.range(n).withColumn("key", F.expr("id div 8")), "key").withColumn("task", F.spark_partition_id())
        assert rows.groupBy("key").agg(F.count_distinct("task").alias("n")).where("n > 1").count() == 0
        sizes = [r["count"] for r in rows.groupBy("task").count().collect()]
        counts.append(len(sizes))
        assert max(sizes) < 20_000
    assert counts[1] == 4 * counts[0] > 100


def test_lines_of_orders_are_shuffled_once(spark, tmp_path):
    spark.range(1000).selectExpr("id div 4 as l_orderkey", "int(id % 4) as l_linenumber", "double(id % 50) as l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        for query in (Q.interval_nesting, Q.interval_nesting_join, Q.outermost_spans):
            plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
            assert "ENSURE_REQUIREMENTS" not in plan and plan.count("REPARTITION_BY_NUM") == 2  # of both sides, the second reused
