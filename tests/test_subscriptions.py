"""Subscriptions hear of each update once, without a shuffle of the result."""

from pyspark.sql import functions as F

from archivolt.streaming import subscriptions as u

UPDATES = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, None), (None, "b"), (4, "c")]
SUBSCRIPTIONS = [(1, [1, 1, None], ""), (1, None, "a"), (1, [2], "a"), (2, [], None), (2, [1], "a"), (3, [3, 4], "c"), (4, None, "none"), (5, [1], "b"), (None, None, ""), (None, [1], "a"), (6, None, None), (6, None, "")]


def _tables(spark):
    return spark.createDataFrame(UPDATES, "task_id long, batch_id string"), spark.createDataFrame(SUBSCRIPTIONS, "subscriber long, task_ids array<long>, batch_id string")


def test_each_update_once(spark):
    updates, subs = _tables(spark)
    pairs = updates.crossJoin(subs.select("subscriber", "task_ids", F.col("batch_id").alias("own"))).filter(u.hears(F.col("task_ids"), F.col("own"), F.col("task_id"), F.col("batch_id")))
    want = pairs.select("subscriber", "task_id", "batch_id").distinct().collect()
    assert sorted(map(str, u.notified(updates, subs).collect())) == sorted(map(str, want))


def test_the_result_is_not_shuffled(spark):
    plan = u.notified(*_tables(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")  # before: an aggregation over all rows


def test_a_batch_is_told_by_many_tasks(spark):
    updates = spark.range(3000).selectExpr("id AS task_id", "concat('a', id % 1) AS batch_id")
    subs = spark.range(40).selectExpr("id AS subscriber", "CAST(NULL AS array<bigint>) AS task_ids", "CASE WHEN id < 30 THEN concat('a', id % 1) END AS batch_id")
    rows = u.notified(updates, subs).groupBy(F.spark_partition_id().alias("p"), (F.col("subscriber") < 30).alias("of_batch")).agg(F.count("*").alias("n")).collect()
    for of_batch, total in ((True, 90_000), (False, 30_000)):
        told = [r.n for r in rows if r.of_batch == of_batch]
        assert sum(told) == total and len(told) > u.SHARES // 4 and max(told) < total // 4  # before: as few as Spark makes by bytes
