"""Evaluation of groupings against truth, and roll-ups of merged documents. Nothing here gathers more than a document's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.operators.columns import FIELDS
from archivolt.operators.review import confidence
from archivolt.operators.rollups import dominant, fill_rates, rate
from archivolt.operators.tables import pair_scores

# The marks around the text of a member, and the confidence of a page that has only text.
BEGIN, END, TEXT_ONLY = "--- 文件片段开始: %s (task_id=%d) ---", "--- 文件片段结束: %s (task_id=%d) ---", 0.55


def mapped(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """U-04: (id, group, doc) of the tasks that are in a predicted group and have a truth document."""
    return predicted.select("id", "group").join(truth.filter(F.col("doc") != "").select("id", "doc"), "id")


def coverage(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """A-15: tasks with truth, predicted and mapped ones, and truth documents that are some group's dominant one. One row."""
    both = mapped(predicted, truth)
    marked = truth.filter(F.col("doc") != "").select(F.lit("truth").alias("k"), F.col("id").cast("string").alias("v"))
    marked = marked.unionByName(predicted.select(F.lit("predicted").alias("k"), F.col("id").cast("string").alias("v")))
    marked = marked.unionByName(both.select(F.lit("mapped").alias("k"), F.col("id").cast("string").alias("v")))
    marked = marked.unionByName(dominant(both, "group", "doc").select(F.lit("documents").alias("k"), F.col("dominant_doc").alias("v"))).distinct()
    names = {"truth": "truth_task_count", "predicted": "predicted_task_count", "mapped": "mapped_task_count", "documents": "mapped_document_count"}
    return marked.agg(*(F.count_if(F.col("k") == k).alias(n) for k, n in names.items()))


def truth_metrics(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """G-21 (A.11): one row: coverage, pairwise scores and the share of tasks in their group's dominant document."""
    both = mapped(predicted, truth)
    shares = dominant(both, "group", "doc").agg(F.coalesce(F.sum("correct"), F.lit(0)).alias("c"), F.coalesce(F.sum("total"), F.lit(0)).alias("t"))
    pairs = pair_scores(both.select("id", "group"), both.select("id", F.col("doc").alias("group")))
    one = coverage(predicted, truth).crossJoin(pairs).crossJoin(shares.select(rate(F.col("c"), F.col("t")).alias("task_assignment_accuracy")))  # single rows
    return one


def operational_metrics(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """A-11, G-21: documents (doc, confidence, agreement) and their fields (rule, llm, recommended, conflict): one row."""
    mean = lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(f"avg_{c}")
    own = documents.agg(F.count("*").alias("documents_count"), mean("confidence"), mean("agreement"))
    return own.crossJoin(fill_rates(fields, ("rule", "llm", "recommended")))  # two single rows


def reader_confidence(lines: Column, region_lines: Column, text: Column) -> Column:
    """A-19: the mean confidence of a page's lines and its regions' lines; of a page with text alone TEXT_ONLY, else 0."""
    none = F.array().cast("array<double>")
    values = F.transform(F.concat(F.coalesce(lines, none), F.coalesce(region_lines, none)), confidence)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    return F.when(F.size(values) > 0, F.round(mean, 4)).when(F.trim(F.coalesce(text, F.lit(""))) != "", TEXT_ONLY).otherwise(0.0)


def ordered_distinct(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """A-22: the values of a group that aren't empty, each once, in the order of first occurrence."""
    first = rows.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(group, value).agg(F.min(order).alias("__at"))
    return first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__at", value))).alias("v")).select(group, F.col(f"v.{value}").alias("values"))


def merged_text(members: DataFrame, group: str, order: str) -> DataFrame:
    """A-23: the texts of a document's members between marks, in order, and the sum of their pages. One document's text is one row."""
    marks = [F.format_string(mark, "filename", F.col("id")) for mark in (BEGIN, END)]
    part = F.concat_ws("\n", marks[0], F.coalesce("full_text", F.lit("")), marks[1])
    rows = members.select(group, F.struct(F.col(order).alias("at"), "id", part.alias("part")).alias("p"), F.greatest(F.lit(0), F.coalesce("page_count", F.lit(0))).alias("n"))
    out = rows.groupBy(group).agg(F.array_sort(F.collect_list("p")).alias("p"), F.sum("n").alias("page_count"))
    return out.select(group, F.array_join("p.part", "\n\n").alias("merged_text"), "page_count")


def overall_threshold(thresholds: DataFrame) -> DataFrame:
    """A-25: the mean of the sequences' thresholds, halves to even; one row, null without any."""
    return thresholds.agg(F.bround(F.avg("threshold"), 0).cast("long").alias("threshold"))


def latest_update(*tables: tuple[DataFrame, str]) -> DataFrame:
    """A-27: the newest time of several tables; one row."""
    newest = [t.agg(F.max(c).alias("at")) for t, c in tables]
    out = newest[0]
    for t in newest[1:]:
        out = out.unionByName(t)
    return out.agg(F.max("at").alias("latest_update"))


def version(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """A-30: 16 hex digits that change with the rows of a group, whatever their order.

    Each row's JSON is hashed first; a group's sorted digests are hashed together, so no group's texts are gathered.
    """
    each = rows.select(group, F.sha1(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("h"))
    return each.groupBy(group).agg(F.left(F.sha1(F.array_join(F.array_sort(F.collect_list("h")), ",")), F.lit(16)).alias("version"))


def page_summary(pages: DataFrame, group: str) -> DataFrame:
    """A-31: mean confidence, number of pages and distinct issues of a document."""
    issues = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("issues", F.array().cast("array<string>"))))))
    return pages.groupBy(group).agg(F.round(F.avg(confidence(F.col("confidence"))), 4).alias("confidence"), F.count("*").alias("pages"), issues.alias("issues"))


def counters(tasks: DataFrame, groups: DataFrame) -> DataFrame:
    """A-33: of a batch: tasks, done, eligible and skipped ones, and groups. tasks: batch_id, done, eligible; groups: batch_id."""
    own = tasks.groupBy("batch_id").agg(F.count("*").alias("total_tasks"), F.count_if("done").alias("done_tasks"), F.count_if("eligible").alias("eligible_tasks"), F.count_if(~F.col("eligible")).alias("skipped_tasks"))
    return own.join(groups.groupBy("batch_id").agg(F.count("*").alias("groups_count")), "batch_id", "left").withColumn("groups_count", F.coalesce("groups_count", F.lit(0)))


def group_documents(groups: DataFrame, documents: DataFrame) -> DataFrame:
    """J-11, P-14: groups with their document; a title is the recommended, else the second reader's, else the rules' one."""
    title = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in ("recommended_title", "llm_title", "rule_title")))
    return groups.join(documents, "group_id", "left").withColumn("display_title", F.coalesce(title, F.col("group_id")))


def filled_fields(prefix: str) -> Column:
    """How many of the archive fields of one reader are filled."""
    return sum((F.trim(F.coalesce(F.col(f"{prefix}_{f}"), F.lit(""))) != "").cast("int") for f in FIELDS)
