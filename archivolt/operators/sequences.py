"""Operators over ordered pages of a sequence, and rewrites of groups and batches."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.text import hamming


def pairs_of_characters(c: Column) -> Column:
    """Distinct character pairs of a text without its white space; one character is its own."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \n\r\t]", "")
    return F.when(F.length(s) < 2, F.array(s)).otherwise(F.array_distinct(F.regexp_extract_all(s, F.lit("(?s)(?=(..))"), F.lit(1))))


def adjacent_similarity(rows: DataFrame, group: str, order: str, text: str, linked: float = 0.08, least: int = 10) -> DataFrame:
    """W-13: Jaccard similarity of neighbours by character pairs; texts under `least` characters give 0."""
    # arrays are made once a row and read again by the window, not made as left and as right
    rows = rows.select(group, F.col(order).alias("left_id"), (F.coalesce(F.length(text), F.lit(0)) < least).alias("__s"), pairs_of_characters(F.col(text)).alias("__a"))
    after = lambda c: F.lead(c).over(w)
    w = Window.partitionBy(group).orderBy("left_id")
    pairs = rows.select("*", after("left_id").alias("right_id"), after("__s").alias("__t"), after("__a").alias("__b")).filter("right_id is not null")
    pairs = pairs.select(group, "left_id", "right_id", (F.col("__s") | F.col("__t")).alias("__s"), F.size("__a").alias("__m"), F.size("__b").alias("__n"), F.size(F.array_intersect("__a", "__b")).alias("__i"))
    share = F.when(F.col("__s"), 0.0).otherwise(F.col("__i") / (F.col("__m") + F.col("__n") - F.col("__i")))
    return pairs.select(group, "left_id", "right_id", share.alias("s")).select(group, "left_id", "right_id", F.round("s", 4).alias("similarity"), (F.col("s") > linked).alias("linked"))


def smoothed(rows: DataFrame, group: str | list[str], order: str, score: str = "score") -> DataFrame:
    """W-02 (A.3): lifts a weak score between two strong ones of one family.

    rows: one per neighbouring pair, with left_family, right_family and strong_split. The scores of the neighbours
    are those before smoothing.
    """
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(order)
    before, after, first = F.lag(score).over(w), F.lead(score).over(w), F.lag("left_family").over(w)
    weak = (F.col(score) < 0.58) & (before >= 0.78) & (after >= 0.78) & ~F.col("strong_split")
    one = (F.col("left_family") != "") & (first == F.col("left_family")) & (F.col("left_family") == F.col("right_family"))
    return rows.withColumn("smoothed", F.when(F.coalesce(weak & one, F.lit(False)), F.round(F.least(F.lit(0.79), F.col(score) + 0.16), 4)).otherwise(F.col(score)))


def segments(rows: DataFrame, group: str, order: str, starts: Column) -> DataFrame:
    """W-03: numbers the runs of a sequence, from 1; `starts` marks the first row of a new run."""
    w = Window.partitionBy(group).orderBy(order)
    first = F.row_number().over(w) == 1
    return rows.withColumn("segment", F.sum(F.when(first | F.coalesce(starts, F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def islands(rows: DataFrame, group: str, order: str, limit: Column) -> DataFrame:
    """W-09: runs of rows that lie no farther from the one before than `limit`."""
    gap = F.col(order) - F.lag(order).over(Window.partitionBy(group).orderBy(order))
    return segments(rows.withColumn("__gap", gap), group, order, F.col("__gap") > limit).drop("__gap")


def numbered_groups(rows: DataFrame, batch: str, *by: str) -> DataFrame:
    """W-04: running numbers of a batch's groups, in the order of prefix and first page; null keys come first and keep their rows."""
    keys = rows.select(batch, *by).distinct()
    numbers = keys.withColumn("number", F.row_number().over(Window.partitionBy(batch).orderBy(*by)).cast("long"))
    numbers = numbers.select("number", *(F.col(c).alias(f"__{c}") for c in (batch, *by)))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (batch, *by)))
    return rows.join(numbers, same).select(*rows.columns, "number")


def first_rows(rows: DataFrame, by: list[str], order: str, last: bool = False) -> DataFrame:
    """W-06 and, with last, W-07: one row per key. Rows combine before the shuffle, so a hot key costs nothing."""
    pick = F.max_by if last else F.min_by
    return rows.groupBy(*by).agg(pick(F.struct(*rows.columns), F.col(order)).alias("__row")).select("__row.*")


def page_gaps(rows: DataFrame, group: str, page: str) -> DataFrame:
    """W-08, U-08: the page numbers missing between a sequence's first and last page."""
    w = Window.partitionBy(group).orderBy(page)
    after = rows.select(group, page).distinct().withColumn("__next", F.lead(page).over(w))
    return after.filter(F.col("__next") - F.col(page) > 1).select(group, F.explode(F.sequence(F.col(page) + 1, F.col("__next") - 1)).alias("missing"))


def previous_distance(rows: DataFrame, group: str, order: str, hash_column: str) -> DataFrame:
    """W-12: differing bits between a page's fingerprint and the one before; null for the first page."""
    return rows.withColumn("distance", hamming(F.col(hash_column), F.lag(hash_column).over(Window.partitionBy(group).orderBy(order))).cast("long"))


def feedback_labels(rows: DataFrame, truth: DataFrame, group: str, page: str) -> DataFrame:
    """G-23: same or different for neighbours of a sequence that both have a truth document."""
    known = rows.join(truth.select("id", "doc_key"), "id", "left")
    w = Window.partitionBy(group).orderBy(page, "id")
    pairs = known.select(group, F.col("id").alias("a"), F.lead("id").over(w).alias("b"), F.col("doc_key").alias("x"), F.lead("doc_key").over(w).alias("y"))
    return pairs.filter((F.col("x") != "") & (F.col("y") != "")).select(group, F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), F.when(F.col("x") == F.col("y"), "same").otherwise("different").alias("label"))


def truth_override(groups: DataFrame, truth: DataFrame) -> DataFrame:
    """J-21, G-24: tasks with a truth document form its group; the others keep theirs, without those that left (B-3, B-4).

    groups: id, group_id, page_no. Returns one row per group with its kind, bounds recomputed, and size.
    """
    rows = groups.join(truth.select("id", "doc_key"), "id", "left")
    of_truth = F.coalesce(F.col("doc_key") != "", F.lit(False))
    return rows.groupBy(F.when(of_truth, "truth").otherwise("auto").alias("kind"), F.when(of_truth, F.col("doc_key")).otherwise(F.col("group_id")).alias("group_key")).agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count("*").alias("tasks"))


def stale(cached: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """U-05, G-25: ids on one side only; a stored analysis is valid if there is none."""
    return cached.select(key).distinct().withColumn("only_in", F.lit("cached")).unionByName(current.select(key).distinct().withColumn("only_in", F.lit("current"))).groupBy(key).agg(F.count("*").alias("n"), F.min("only_in").alias("only_in")).filter("n = 1").drop("n")


def replaced_batches(old: DataFrame, new: DataFrame, batch: str) -> DataFrame:
    """K-07: the rows of a batch that comes again go as a whole."""
    return old.join(new.select(batch).distinct(), batch, "left_anti").unionByName(new)


def filled_from(rows: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """J-19, D-05: blank values taken from the row of the other table."""
    there = other.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    out = rows.join(there, key, "left")
    return out.select(*(F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.col(f"__{c}")).alias(c) if c in columns else c for c in rows.columns))


def invalid_truth(submitted: DataFrame, tasks: DataFrame, key: str) -> DataFrame:
    """J-20: submitted rows of tasks that the batch doesn't have."""
    return submitted.join(tasks.select(key), key, "left_anti")


def valid_truth(submitted: DataFrame, tasks: DataFrame, key: str, order: str) -> DataFrame:
    """J-20: the submitted rows, of those that repeat a task the first one by `order`; a task that the batch doesn't have is an error."""
    first = first_rows(submitted, [key], order)
    known = tasks.select(key, F.lit(True).alias("__known")).distinct()
    wrong = F.raise_error(F.concat(F.lit("not a task of the batch: "), F.col(key).cast("string")))
    return first.join(known, key, "left").filter(F.coalesce("__known", wrong.cast("boolean"))).drop("__known")


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """Extension: each left row with the newest right value not after it, by one union and a window instead of a range join."""
    rows = left.select(by, time, "id", F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("__side")).unionByName(right.select(by, time, F.lit(None).cast("long").alias("id"), value, F.lit(0).alias("__side")))
    w = Window.partitionBy(by).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("__side = 1").drop("__side")


def redrafted(rows: DataFrame, edits: DataFrame, batch: str, order: str, key: str) -> DataFrame:
    """W-11: draft keys after merges and splits: from an edit's row on, as far as the key stays the same, rows get its new key.

    edits: batch, order (of the row where it begins), new_key; one for each run at most, as edits are made one by one.
    """
    w = Window.partitionBy(batch).orderBy(order)
    runs = segments(rows, batch, order, F.coalesce(F.col(key) != F.lag(key).over(w), F.lit(True)))
    starts = edits.select(F.col(batch).alias("__b"), F.col(order).alias("__from"), "new_key")
    at = runs.join(starts, (F.col(batch) == F.col("__b")) & (F.col(order) == F.col("__from"))).select(F.col(batch).alias("__b"), F.col("segment").alias("__s"), "__from", "new_key")
    out = runs.join(at, (F.col(batch) == F.col("__b")) & (F.col("segment") == F.col("__s")), "left")
    changed = F.coalesce(F.col(order) >= F.col("__from"), F.lit(False))
    return out.withColumn(key, F.when(changed, F.col("new_key")).otherwise(F.col(key))).select(*rows.columns)
