"""Archive fields by the place of their texts: every item of a document is scored, the best one wins. Aggregations only.

items: id, page_index, page_total, y_ratio (0 top, 1 bottom of the page), x1, y1, text, kind, seq (number on its page). Each
combines before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions.fields import CLASSIFICATION, first_match
from archivolt.functions.text import dates, once

# Document numbers in normalised brackets, kinds of titles, and words near a date of issue or of a period.
DOC_NUMBERS = (
    r"([\x{4e00}-\x{9fa5}A-Za-z]{2,20}(?:字|发|函|办|通|报|党组|工)?(?:\[\d{4}\]|\(\d{4}\)|\d{4})\s*(?:第\s*)?\d+\s*号)",
    r"([\x{4e00}-\x{9fa5}A-Za-z]{2,20}(?:发|函|字|办)\s*(?:\[\d{4}\]|\(\d{4}\))\s*\d+\s*号)",
)
NUMBER_END = "号"
TITLE_KINDS = ("doc_title", "title", "paragraph_title", "content_title", "abstract_title", "reference_title")
ISSUED, PERIOD = ("印发", "成文", "日期"), ("起", "截至", "会议", "活动", "培训", "实施")
PAGE_HEAD = r"^---\s*第\s*\d+\s*页\s*---$"
ENDS = r"^[ \t\r\n，。；;:：]+|[ \t\r\n，。；;:：]+$"


def clean_line(c: Column) -> Column:
    """A line with single blanks, without blanks and closing marks at its ends."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "　\xa0", "  "), r"\s+", " "), ENDS, "")


def one_bracket(c: Column) -> Column:
    return F.translate(c, "〔〕（）【】", "[]()[]")


def search_text(c: Column) -> Column:
    """A clean line with one form of each bracket."""
    return one_bracket(clean_line(c))


def text_lines(text: Column) -> Column:
    """The clean lines of a text without the heads of its pages."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), clean_line), lambda x: (x != "") & ~x.rlike(PAGE_HEAD))


def doc_number(c: Column) -> Column:
    """C-22: the document number of a line with its year in one form of brackets; empty without any."""
    found = once(search_text(c), lambda t: once(first_match(t, DOC_NUMBERS, 1), lambda n: F.translate(F.regexp_replace(n, r"\s+", ""), "[]()", "〔〕〔〕")))
    return F.when(F.contains(c, F.lit(NUMBER_END)), found).otherwise("")  # all patterns end so


def distinct_items(items: DataFrame, step: float = 12.0) -> DataFrame:
    """C-21: of items of a page with one text, white space aside, and nearly one place the first, from the top, regions before lines.

    seq numbers the items of a page, regions first. Places are rounded half to even.
    """
    near = [F.bround(F.col(c) / step).alias(f"__{c}") for c in ("y1", "x1")]
    bare = F.regexp_replace("text", r"\s+", "").alias("__text")
    rows = items.groupBy("id", "page_index", bare, *near).agg(F.min_by(F.struct(*items.columns), F.struct("y1", "x1", "seq")).alias("r"))
    return rows.select("r.*")


def _points(*parts: tuple[Column, int]) -> Column:
    return sum((F.when(test, n).otherwise(0) for test, n in parts), F.lit(0))


def _has(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def _first(value: Column, score: Column, *ties: Column) -> Column:
    """The value of the greatest score; of equal ones the first in the order of ties. Null values don't count."""
    return F.max_by(value, F.when(value.isNotNull(), F.struct(score.alias("s"), *((-t).alias(f"t{k}") for k, t in enumerate(ties)))))


def scored_fields(items: DataFrame) -> DataFrame:
    """C-27, C-28, C-29 (A.12): (id, doc_no, date, classification) by score; null where no item has one.

    Of equal scores the first item wins, in the order of pages and places; for a date the last page and the lowest place.
    """
    y, page, n = F.col("y_ratio"), F.col("page_index"), F.length("text")
    filled = lambda c: once(c, lambda x: F.nullif(x, F.lit("")))
    number = filled(doc_number(F.col("text")))
    of_number = _points((page == 0, 8), (n <= 40, 2), (F.col("kind").isin(*TITLE_KINDS), 1)) + F.when(y < 0.35, 10).when(y < 0.5, 4).otherwise(-4)
    level = filled(F.regexp_extract(clean_line(F.col("text")), CLASSIFICATION, 0))
    of_level = _points((page == 0, 4), ((y < 0.2) | (y > 0.75), 6), (n <= 12, 4))
    items = items.withColumns({"__number": number, "__level": level, "__dates": dates(search_text(F.col("text")))})
    number, level, found = F.col("__number"), F.col("__level"), F.col("__dates")
    last = page == F.col("page_total") - 1
    of_date = _points((last, 4), (n <= 24, 2), (_has(F.col("text"), ISSUED), 4), (_has(F.col("text"), PERIOD), -4)) + F.when(y > 0.6, 10).when((page == 0) & (y < 0.35), 4).otherwise(0)
    date = F.max_by(F.get(found, F.lit(0)), F.when(F.size(found) > 0, F.struct(of_date.alias("s"), "page_index", "y1", (-F.col("x1")).alias("x"), (-F.col("seq")).alias("k"))))
    place = tuple(F.col(c).cast("double") for c in ("page_index", "y1", "x1", "seq"))
    return items.groupBy("id").agg(_first(number, of_number, *place).alias("doc_no"), date.alias("date"), _first(level, of_level, *place).alias("classification"))


def fall_backs(lines: Column, text: Column) -> dict[str, Column]:
    """Of a text and its lines (text_lines): a number in its first 12 lines, any date, a level in its first 600 characters; null without any."""
    number = F.get(F.filter(F.transform(F.slice(lines, 1, 12), doc_number), lambda x: x != ""), F.lit(0))
    date = F.get(dates(one_bracket(F.array_join(lines, "\n"))), F.lit(0))  # lines are clean
    level = F.nullif(F.regexp_extract(F.left(search_text(text), F.lit(600)), CLASSIFICATION, 0), F.lit(""))
    return {"doc_no": number, "date": date, "classification": level}


def with_fall_backs(fields: DataFrame, texts: DataFrame) -> DataFrame:
    """Fields of documents (id), and from the text (id, full_text) those that no item gives."""
    rows = texts.join(fields, "id", "left").withColumn("lines", text_lines(F.col("full_text")))
    return rows.select("id", *(F.coalesce(F.col(c), other, F.lit("")).alias(c) for c, other in fall_backs(F.col("lines"), F.col("full_text")).items()))
