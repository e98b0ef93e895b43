"""Lists of tasks and records: filters with optional parameters, pages, names and rows as they are shown."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.text import coerced
from archivolt.operators.columns import blank
from archivolt.operators.graph import _written as written
from archivolt.operators.rollups import effective_status

# Archive fields as they are written and as columns, parts of a submission's name, and ratings.
RENAMED = {"档号": "archive_no", "文号": "doc_no", "责任者": "responsible", "题名": "title", "日期": "date", "页数": "pages", "密级": "classification", "备注": "remarks"}
SUBMISSION, OLD_SUBMISSION, NOBODY = "%s-%s-第%d次提交", "-历史任务", "匿名用户"
RATINGS = ("helpful", "not_helpful")
SUMMARY = ("id", "filename", "file_path", "batch_id", "file_type", "mode", "page_count", "created_at", "updated_at")


def summary(rows: DataFrame, status: str = "status", payload: str = "payload", review: str = "review_status") -> DataFrame:
    """P-01: the row of a list; its status is the effective one."""
    return rows.select(*(c for c in SUMMARY if c in rows.columns), effective_status(F.col(status), F.col(payload), F.col(review)).alias("status"))


def renamed(rows: DataFrame) -> DataFrame:
    """P-05: archive fields under their column names; other columns stay."""
    return rows.withColumnsRenamed({k: v for k, v in RENAMED.items() if k in rows.columns})


def submission_name(name: Column, user: Column, day: Column, number: Column, filename: Column) -> Column:
    """P-12: a submission's own name, else user, day and number of the day, else the file name, else user and day of an old task."""
    who = F.left(F.when(blank(user), NOBODY).otherwise(coerced(user)), F.lit(120))
    date = F.date_format(day, "yyyyMMdd")
    made = F.left(F.format_string(SUBMISSION, who, date, F.greatest(F.lit(1), number).cast("int")), F.lit(255))
    old = F.when(~blank(filename), coerced(filename)).otherwise(F.concat(who, F.lit("-"), date, F.lit(OLD_SUBMISSION)))
    return F.when(~blank(name), name).when(number.isNotNull(), made).otherwise(old)


def without_evidence(rows: DataFrame, fields: str, wanted: bool) -> DataFrame:
    """P-16: the struct without its evidence, unless it is asked for."""
    return rows if wanted else rows.withColumn(fields, F.col(fields).dropFields("evidence"))


def folder_like(path: Column, folder: str) -> Column:
    """F-02: what begins with the folder's name, its neighbours of a longer name included; an empty folder is no condition."""
    return path.startswith(folder) if folder.strip() else F.lit(True)


def equals_or_any(c: Column, value: str) -> Column:
    """F-03: equality, or no condition where the value is blank."""
    return c == value if value.strip() else F.lit(True)


def has_vector(c: Column) -> Column:
    """F-08."""
    return c.isNotNull()


def of_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """F-09: rows whose key is among the ids, by a semi join, however many there are."""
    return rows.join(ids.select(key), key, "left_semi")


def within_roots(path: Column, roots: list[str]) -> Column:
    """F-12: a path that is an allowed root or lies in one."""
    bare = [r.rstrip("/") for r in roots]
    return reduce(or_, ((path == r) | path.startswith(r + "/") for r in bare), F.lit(False))


def unassigned(batch: Column) -> Column:
    """F-14: no batch, or an empty one."""
    return batch.isNull() | (batch == "")


def facets(rows: DataFrame, first: str = "", last: str = "", statuses: tuple[str, ...] = (), modes: tuple[str, ...] = ()) -> DataFrame:
    """F-20, F-19: rows by day, status and mode, newest first; an empty facet is no condition."""
    day = F.to_date("created_at")
    tests = [day >= F.to_date(F.lit(first))] * bool(first) + [day <= F.to_date(F.lit(last))] * bool(last)
    tests += [F.col("status").isin(*statuses)] * bool(statuses) + [F.col("mode").isin(*modes)] * bool(modes)
    return reduce(DataFrame.filter, tests, rows).orderBy(F.desc("created_at"), F.desc("id"))


def submitted_between(user: Column, who: str, time: Column, first: str, end: str) -> Column:
    """F-13: a submitter's rows from the first moment up to the end, which is not included."""
    return (user == who) & (time >= F.to_timestamp_ntz(F.lit(first))) & (time < F.to_timestamp_ntz(F.lit(end)))


def total(rows: DataFrame) -> DataFrame:
    """A-01: how many rows the filters of a page leave."""
    return rows.agg(F.count("*").alias("total"))


def page(rows: DataFrame, order: list, number: int, size: int, most: int = 500) -> DataFrame:
    """T-01, T-02, T-12: one page of an order; number and size are at least 1, size at most `most`. A page beyond the end is empty."""
    size = min(max(1, size), most)
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def newest_first(time: str, key: str) -> list[Column]:
    """T-09: rows without time come last."""
    return [F.desc_nulls_last(time), F.asc(key)]


def candidate_order(page_no: str, sequence: str, created: str, key: str) -> list[Column]:
    """T-07, W-01: by page number, else number in the file name, else last; then by time, null first, and key."""
    return [F.coalesce(F.col(page_no), F.col(sequence), F.lit(10**9)).asc(), F.asc_nulls_first(created), F.asc(key)]


def ordered_groups(members: DataFrame, group: str, key: str) -> DataFrame:
    """T-10, A-34: groups by their first member, numbered from 1."""
    first = members.groupBy(group).agg(F.min(key).alias("first_member"), F.count("*").alias("members"))
    return numbered(first, "position", "first_member", group)


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with their place from 1 in an order of all: ranges of the order are sorted by tasks, and each starts after the rows of those before it.

    The sorted rows are written, so that ranges don't change between the two looks at them; only a count a task is gathered.
    """
    done = written(rows.orderBy(*order).withColumn("__n", F.monotonically_increasing_id()))
    task = F.shiftright("__n", 33)
    sizes = done.groupBy(task.alias("__t")).agg(F.count("*").alias("__k"))
    before = sizes.select("__t", (F.sum("__k").over(Window.orderBy("__t")) - F.col("__k")).alias("__before"))  # a row a task
    out = done.withColumn("__t", task).join(F.broadcast(before), "__t")
    return out.withColumn(name, F.col("__before") + F.col("__n").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__t", "__n", "__before")


def deleted(rows: DataFrame, batch: str = "", folder: str = "", everything: bool = False) -> DataFrame:
    """D-04: what stays when the rows of a batch go, else of a folder; all go only if `everything` says so."""
    if batch.strip():
        return rows.filter(~F.col("batch_id").eqNullSafe(F.lit(batch)))
    if folder.strip():
        return rows.filter(~F.coalesce(folder_like(F.col("file_path"), folder), F.lit(False)))
    if not everything:
        raise ValueError("neither batch nor folder: say everything=True to delete all rows")
    return rows.limit(0)


def checked_feedback(rows: DataFrame) -> DataFrame:
    """D-07: feedback with a known rating, and a reason where it isn't helpful; anything else is an error. Blank texts become null."""
    rating, reason = F.lower(coerced(F.col("rating"))), coerced(F.col("reason"))
    wrong = F.when(~rating.isin(*RATINGS), F.raise_error(F.lit("rating must be either helpful or not_helpful.")).cast("string"))
    wrong = wrong.when((rating == "not_helpful") & (reason == ""), F.raise_error(F.lit("reason is required when rating is not_helpful.")).cast("string"))
    texts = {c: F.nullif(coerced(F.col(c)), F.lit("")) for c in ("reason", "comment", "corrected_answer") if c in rows.columns}
    return rows.withColumns(texts | {"rating": wrong.otherwise(rating)})


def record(rows: DataFrame, columns: list[str], feedback: list[str]) -> DataFrame:
    """P-13: a record as one row with its feedback nested; null without any."""
    some = reduce(or_, (F.col(c).isNotNull() for c in feedback))
    return rows.select(*columns, F.when(some, F.struct(*feedback)).alias("feedback"))
