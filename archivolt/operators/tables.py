"""Joins, rollups and rewrites of task tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.layout import page_text


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """K-06: one row per key, the last by `order`; a blank new value keeps the older one."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key).orderBy("__new", order)
    last = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    value = lambda c, t: F.last(F.nullif(F.col(c), F.lit("")) if t == "string" else F.col(c), ignorenulls=True).over(last).alias(c)
    kinds = dict(old.dtypes)
    ranked = rows.select(key, *(value(c, kinds[c]) for c in old.columns if c != key), F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__new"), F.desc(order))).alias("__rank"))
    return ranked.filter("__rank = 1").select(*old.columns)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """D-01 to D-03: rows whose key isn't among the deleted ones."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def status_of(requested: DataFrame, tasks: DataFrame) -> DataFrame:
    """J-05: requested (position, id) in order, each with its task's status; a missing task failed."""
    found = requested.join(tasks.select("id", "status"), "id", "left")
    out = found.withColumn("error", F.when(F.col("status").isNull(), "Task not found.").otherwise("")).withColumn("status", F.coalesce("status", F.lit("failed")))
    return out.orderBy("position", "id")


def adjacent(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """J-07: each row with the next one of its group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.select(group, F.col(order).alias("left_id"), F.lead(order).over(w).alias("right_id"), F.col(value).alias("left_value"), F.lead(value).over(w).alias("right_value")).filter("right_id is not null")


def attach_lists(folders: DataFrame, pairs: DataFrame, key: str, value: str) -> DataFrame:
    """J-04: folders with the sorted distinct values of their pairs; none gives an empty array."""
    lists = pairs.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))
    return folders.join(lists, key, "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))


def pair_scores(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """J-09, A-12: pairwise precision, recall and F1 of groupings (id, group), on ids of both; without pairs as the definitions of empty sets say.

    Pair counts come from group sizes, not from pairs.
    """
    both = predicted.select("id", F.col("group").alias("p")).join(truth.select("id", F.col("group").alias("t")), "id")
    pairs = lambda df, *by: df.groupBy(*by).count().select(F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0)).alias("n"))
    counts = pairs(both, "p", "t").select(F.col("n").alias("tp")).crossJoin(pairs(both, "p").select(F.col("n").alias("pp"))).crossJoin(pairs(both, "t").select(F.col("n").alias("tt")))  # three single rows
    precision = F.when(F.col("pp") > 0, F.round(F.col("tp") / F.col("pp"), 6)).when(F.col("tt") > 0, 0.0).otherwise(1.0)
    recall = F.when(F.col("tt") > 0, F.round(F.col("tp") / F.col("tt"), 6)).otherwise(1.0)
    scores = counts.select("tp", F.col("pp").alias("predicted_pairs"), F.col("tt").alias("truth_pairs"), precision.alias("precision"), recall.alias("recall"))
    both = F.col("precision") + F.col("recall")
    return scores.withColumn("f1", F.when(both > 0, F.round(2 * F.col("precision") * F.col("recall") / both, 6)).otherwise(0.0))


def updated_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """D-06: tasks with the pages (and so text and page count) or the text that a result gives; a task in work is an error.

    tasks: id, status, pages, full_text, page_count; results: id, new_pages, new_text. Tasks without a result stay.
    """
    rows = tasks.join(results.withColumn("__told", F.lit(True)), "id", "left")
    told, paged = F.coalesce("__told", F.lit(False)), F.col("new_pages").isNotNull()
    wrong = F.raise_error(F.concat(F.lit("Task result cannot be edited while it is still processing: "), F.col("id").cast("string")))
    pages = F.when(told & ~F.col("status").isin("done", "failed"), wrong.cast(tasks.schema["pages"].dataType)).when(told & paged, F.col("new_pages")).otherwise(F.col("pages"))
    text = F.when(told & paged, page_text(F.col("new_pages"))).when(told & F.col("new_text").isNotNull(), F.col("new_text")).otherwise(F.col("full_text"))
    count = F.when(told & paged, F.size("new_pages")).otherwise(F.col("page_count"))
    return rows.select("id", "status", pages.alias("pages"), text.alias("full_text"), count.alias("page_count"))
