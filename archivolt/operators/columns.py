"""Projections and predicates over task and archive rows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("archive_no", "doc_no", "responsible", "title", "date", "pages", "classification", "remarks")


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def record_text(columns: list[str], keep_blanks: bool) -> Column:
    """P-03: fields joined by a space; the search form keeps blanks, the embedding form drops them."""
    parts = [F.coalesce(F.col(c), F.lit("")) if keep_blanks else F.nullif(F.col(c), F.lit("")) for c in columns]
    return F.concat_ws(" ", *parts)


def snippet(text: Column, word: str, around: int = 50) -> Column:
    """P-04: what stands around the first hit of a word, with ellipses where it is cut; null without a hit."""
    at = F.locate(word.lower(), F.lower(text))
    first = F.greatest(at - around, F.lit(1))
    n = at - first + len(word) + around
    cut = F.regexp_replace(F.substring(text, first, n), "\n", " ")
    return F.when(at > 0, F.concat(F.when(first > 1, "...").otherwise(""), cut, F.when(first + n - 1 < F.length(text), "...").otherwise("")))


def review_flag(c: Column) -> Column:
    """P-06."""
    return F.when(blank(c), "review").otherwise("accepted")


def parent_folder(path: Column) -> Column:
    """P-07."""
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def shortened(c: Column, n: int) -> Column:
    """P-10: an over-long value keeps n - 3 characters and an ellipsis; n of 3 or less is a hard cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("...")) if n > 3 else F.substring(c, 1, n)).otherwise(c)


def submission_id(batch: Column, task: Column) -> Column:
    """P-11."""
    return F.when(~blank(batch), F.concat(F.lit("batch:"), batch)).otherwise(F.concat(F.lit("single:"), task.cast("string")))


def group_filename(prefix: Column, first: Column, last: Column) -> Column:
    """P-15."""
    return F.format_string("%s-%03d-%03d.pdf", prefix, first, last)


def percent(done: Column, total: Column) -> Column:
    """P-17: 0 to 100, two digits; no total is 0."""
    return F.when(total > 0, F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), done * 100.0 / total)), 2)).otherwise(0.0)


def in_folder(path: Column, folder: str) -> Column:
    """F-01: inside a folder, its own trailing separators aside."""
    base = folder.rstrip("/\\")
    return path.startswith(base + "/") | path.startswith(base + "\\")


def has_keyword(word: str, *columns: Column) -> Column:
    """F-05 and F-06: case-insensitive containment in any column; wildcards are plain characters."""
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(word.lower()))
    return out


def not_in_batch(batch: Column, value: str) -> Column:
    """F-07: another batch or none."""
    return ~batch.eqNullSafe(F.lit(value))


def first_snippet(word: str, *texts: Column, around: int = 50) -> Column:
    """P-04: of texts in order (the whole, its regions, its lines, its file name) what stands around the word in the first that has it."""
    return F.coalesce(*(snippet(t, word, around) for t in texts))
