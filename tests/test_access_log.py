"""The access log is dealt into a named number of parts."""

from tidemark.plans.inputs import Inputs


def test_lists_of_queries_are_not_joined_into_few_parts(spark, tmp_path):
    spark.range(2000).selectExpr("id % 500 as l_orderkey", "id as l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(500).selectExpr("id as o_orderkey", "id % 9 as o_custkey", "timestamp_ntz '2001-07-01 00:00:00' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    log = Inputs(spark, str(tmp_path)).access_log
    assert log.rdd.getNumPartitions() == 16 * spark.sparkContext.defaultParallelism  # was 1, whatever the number of queries
    assert "Broadcast" not in log._jdf.queryExecution().executedPlan().toString()
    rows = log.collect()
    assert len(rows) == 500 and all(len(r.objects) == 4 for r in rows)
