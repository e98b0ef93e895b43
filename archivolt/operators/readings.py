"""Repeated readings of unsure pages, and the result of a task out of its pages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions.text import coerced
from archivolt.operators.graph import _written as written
from archivolt.operators.review import confidence, review_route
from archivolt.operators.rollups import CRITICAL, page_votes

# Ways to prepare a page, in the order they are tried, the confidence that ends it, and how often a page is read again.
STRATEGIES, SURE, RETRIES = ("none", "opencv_document", "enhance_contrast", "crop_and_zoom", "deskew", "denoise", "sharpen"), 0.85, 2
FIELDS = ("archive_no", "doc_no", "responsible", "title", "date", "pages", "classification", "remarks")


def next_strategy(now: Column, retries: Column) -> Column:
    """The way after this one; after the last one the first that as many retries haven't tried; an unknown way counts as the first."""
    names = F.array(*map(F.lit, STRATEGIES))
    at = F.greatest(F.lit(1), F.array_position(names, now).cast("int"))
    after = F.element_at(names, F.least(at + 1, F.lit(len(STRATEGIES))))
    return F.when((after == now) & (retries + 1 < len(STRATEGIES)), F.get(names, (retries + 1).cast("int"))).otherwise(after)


def read_until_sure(pages: DataFrame, reader: Callable[[DataFrame], DataFrame], sure: float = SURE, retries: int = RETRIES) -> DataFrame:
    """G-14: pages (with strategy, null: none) with what reader adds and `retries`; only pages below `sure` are read again.

    reader adds confidence and other columns to pages with strategy and retries. Every reading is written, so that none is
    made twice; a round without unsure pages ends it. At most retries + 1 readings a page.
    """
    own = coerced(F.col("strategy")) if "strategy" in pages.columns else F.lit("")
    todo = pages.withColumn("strategy", F.coalesce(F.nullif(own, F.lit("")), F.lit(STRATEGIES[0]))).withColumn("retries", F.lit(0))
    names, done = todo.columns, []
    for k in range(retries + 1):
        read = written(reader(todo))
        low = confidence(F.col("confidence")) < sure if k < retries else F.lit(False)
        done.append(read.filter(~low))
        todo = read.filter(low).select(*names)
        if k == retries or todo.isEmpty():
            break
        todo = todo.withColumn("strategy", next_strategy(F.col("strategy"), F.col("retries"))).withColumn("retries", F.col("retries") + 1)
    return reduce(DataFrame.unionByName, done)


def distinct_issues(of_pages: Column) -> Column:
    """All issues of pages in their order, each once, without blank ones."""
    return F.array_distinct(F.filter(F.transform(F.flatten(of_pages), coerced), lambda x: x != ""))


def archived(pages: DataFrame, group: str = "task_id") -> DataFrame:
    """G-17: one row a task: its text, fields, quality and review, and whether its record is to be written.

    pages: the group, page_num, text, confidence, retries, issues (array, null: none), fields (map of text). A field has the
    value that most pages give (A-16); a critical field with several values is a conflict. Records of tasks that ask for a
    review are not written (archive_saved). A task's pages meet in one row, as its text does.
    """
    none = F.array().cast("array<string>")
    page = F.struct("page_num", coerced(F.col("text")).alias("text"), confidence(F.col("confidence")).alias("confidence"), F.coalesce("retries", F.lit(0)).alias("retries"), F.coalesce("issues", none).alias("issues"))
    rows = pages.groupBy(group).agg(F.array_sort(F.collect_list(page)).alias("p"))
    each = lambda f: F.transform("p", f)
    numbers = lambda test: F.transform(F.filter("p", test), lambda x: x["page_num"])
    heads = each(lambda x: F.when(F.size("p") > 1, F.concat(F.lit("--- Page "), x["page_num"].cast("string"), F.lit(" ---\n"), x["text"])).otherwise(x["text"]))
    said = F.filter(F.zip_with(heads, F.col("p"), lambda h, x: F.when(x["text"] != "", h)), lambda x: x.isNotNull())
    sure = each(lambda x: x["confidence"])
    # in whole ten-thousandths, half up, so that the order of sums doesn't decide
    parts, n = F.aggregate(sure, F.lit(0).cast("long"), lambda a, x: a + F.round(x * 10_000).cast("long")), F.size("p")
    mean = F.floor((2 * parts + n) / (2 * n)) / 10_000
    rows = rows.select(
        group, F.size("p").alias("page_count"), F.array_join(said, "\n\n").alias("full_text"), mean.alias("average_confidence"), F.array_min(sure).alias("min_confidence"), F.array_max(sure).alias("max_confidence"),
        numbers(lambda x: x["retries"] > 0).alias("retry_pages"), numbers(lambda x: F.size(x["issues"]) > 0).alias("pages_with_issues"), distinct_issues(each(lambda x: x["issues"])).alias("issues"),
    )
    values = pages.select(group, F.col("page_num").alias("page"), "confidence", F.explode("fields").alias("field", "value")).filter(F.col("field").isin(*FIELDS))
    votes = page_votes(values, group).select(group, "field", "value")
    clash = values.filter(F.col("field").isin(*CRITICAL)).groupBy(group, "field").agg(F.count_distinct(F.nullif(F.regexp_replace(coerced(F.col("value")), r"\s+", ""), F.lit(""))).alias("k")).filter("k > 1")
    merged = votes.groupBy(group).agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS))
    conflicts = clash.groupBy(group).agg(F.array_sort(F.collect_list("field")).alias("conflicts"))
    rows = rows.join(merged, group, "left").join(conflicts, group, "left")
    route = review_route(F.col("conflicts"), F.col("issues"), F.col("average_confidence"))
    out = rows.select("*", *(c.alias(n) for n, c in route.items())).withColumn("conflict_count", F.coalesce(F.size("conflicts"), F.lit(0))).drop("conflicts")
    return out.select("*", (~F.col("human_review")).alias("archive_saved")).na.fill("", list(FIELDS))
