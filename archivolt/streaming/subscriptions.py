"""Who hears of an update, what is still valid at a time, and what is acknowledged; for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds that a subscription, a task, a list, a search, a merge and an answer stay valid.
TTL = {"subscription": 300, "task": 3600, "list": 30, "search": 120, "merge": 1800, "answer": 900}

#: Shares of the updates of one batch, or of all updates for catch-alls.
SHARES = 32


def hears(task_ids: Column, batch: Column, task: Column, task_batch: Column) -> Column:
    """J-22: a subscription names the task, or its batch, or nothing at all."""
    ids, own = F.coalesce(task_ids, F.array().cast("array<bigint>")), F.coalesce(batch, F.lit(""))
    named = F.coalesce(F.array_contains(ids, task), F.lit(False))
    return named | ((own != "") & F.coalesce(own == task_batch, F.lit(False))) | ((F.size(ids) == 0) & (own == ""))


def notified(updates: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """K-09, J-22: (subscriber, task_id, batch_id) of each update that a subscription hears of, once.

    Three joins by key in place of all pairs: named tasks, named batches, and catch-alls, which hear of every update. What is
    said twice goes before the joins, and each join leaves out what another one gives, so that the result, which is as
    large as subscriptions times their updates, is never shuffled. Batches and catch-alls are few keys: their updates are
    dealt to SHARES, and each share meets a copy of the subscriptions. Tasks are told by their number, as few bytes meet
    where many rows come out, so that Spark would leave all of them to a task or two.
    """
    tasks = max(int(updates.sparkSession.conf.get("spark.sql.shuffle.partitions")), SHARES)
    ids, own = F.coalesce("task_ids", F.array().cast("array<bigint>")), F.coalesce("batch_id", F.lit(""))
    subs, updates = subscriptions.select("subscriber", ids.alias("ids"), own.alias("own")), updates.select("task_id", "batch_id").distinct()
    every = subs.filter("size(ids) = 0 AND own = ''").select(F.col("subscriber").alias("__all")).distinct()
    rest = lambda rows: rows.join(every, F.expr("subscriber <=> __all"), "left_anti")
    of_batch = rest(subs.filter("own <> ''").select("subscriber", F.col("own").alias("batch_id")).distinct())
    of_task = rest(subs.select("subscriber", F.explode("ids").alias("task_id")).filter("task_id IS NOT NULL").distinct())
    batches = of_batch.select(F.col("subscriber").alias("__s"), F.col("batch_id").alias("__b"))
    by_task = updates.join(of_task, "task_id").join(batches, F.expr("batch_id = __b AND subscriber <=> __s"), "left_anti")
    dealt = updates.withColumn("__share", F.pmod(F.xxhash64("task_id", "batch_id"), F.lit(SHARES)))
    met = lambda rows: rows.withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    meet = lambda rows, *key: dealt.repartition(tasks, *key).hint("shuffle_hash").join(met(rows).repartition(tasks, *key), list(key))
    by_batch = meet(of_batch, "batch_id", "__share")
    all_ = meet(every.withColumnRenamed("__all", "subscriber"), "__share")
    columns = ["subscriber", "task_id", "batch_id"]
    return by_task.select(*columns).unionByName(by_batch.select(*columns)).unionByName(all_.select(*columns))


def valid_at(rows: DataFrame, time: str, now: Column, seconds: int) -> DataFrame:
    """K-11, R-07, R-08: rows of which `seconds` have not passed yet; rows without time are gone."""
    return rows.filter(F.col(time) > now - F.make_dt_interval(secs=F.lit(seconds)))


def acknowledged(commands: DataFrame, persisted: DataFrame, key: str) -> DataFrame:
    """R-10: each command with whether its callback is stored; the others are queued again."""
    known = persisted.select(key).distinct().withColumn("__known", F.lit(True))
    return commands.join(known, key, "left").withColumn("state", F.when(F.col("__known"), "acknowledged").otherwise("requeued")).drop("__known")


def first_provider(rows: DataFrame, group: str, order: str, answer: str) -> DataFrame:
    """R-11: the answer of the first provider that gave one."""
    return rows.filter(F.col(answer).isNotNull()).groupBy(group).agg(F.min_by(F.struct(order, answer), order).alias("r")).select(group, f"r.{order}", f"r.{answer}")


def resumed(states: DataFrame, inputs: DataFrame) -> DataFrame:
    """R-04: tasks that wait for a person and have an answer go on; those without one wait. states: task_id, status; inputs: task_id."""
    told = inputs.select("task_id").distinct().withColumn("__told", F.lit(True))
    waits = (F.col("status") == "human_review") & F.coalesce("__told", F.lit(False))
    return states.join(told, "task_id", "left").withColumn("status", F.when(waits, "processing").otherwise(F.col("status"))).drop("__told")
