"""Archive fields and tables read from file names and texts by rule, as column expressions that stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import coerced

# Patterns of archive numbers, document numbers, responsible parties, dates, titles and classifications.
ARCHIVE_NUMBERS = (r"(?i)^WS[·.]?\d{4}[·.]?[A-Z]\d+(?:-\d+)+$", r"(?i)^KJ(?:-[A-Za-z0-9]+){4,}$", r"(?i)^KJ(?:-[^-]*){4}")
DOC_NUMBERS = (
    r"[\x{4e00}-\x{9fa5}]+[\[〔\(（]?\d{4}[\]〕\)）]?\s*(?:第\s*)?\d+\s*号",
    r"[\x{4e00}-\x{9fa5}]{2,10}发[\[〔\(（]\d{4}[\]〕\)）]\d+号",
    r"[\x{4e00}-\x{9fa5}]{2,10}[\[〔\(（]\d{4}[\]〕\)）]\s*\d+\s*号",
)
RESPONSIBLE = (r"([\x{4e00}-\x{9fa5}]{2,20}(?:局|部|委员会|委|办|厅|院|会|中心|处|科|室))\s*(?:关于|发布|印发)", r"([\x{4e00}-\x{9fa5}]{4,20}(?:人民政府|人力资源|档案馆|档案局))")
HAN = r"^([\x{4e00}-\x{9fa5}]+)"
DATES = (r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", r"(\d{4})[.\-/](\d{1,2})[.\-/](\d{1,2})", r"(\d{4})(\d{2})(\d{2})")
TITLE_WORDS = "关于|通知|决定|意见|办法|规则|方法|规范|条例|规定"
PAGE_HEAD = r"^第?\d+页"
CLASSIFICATION = "绝密|机密|秘密|内部|公开"


def first_match(c: Column, patterns, group: int = 0) -> Column:
    """The match of the first pattern that has one; empty without any."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, group), F.lit("")) for p in patterns), F.lit(""))


def stem(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.element_at(F.split(coerced(name), "/"), -1), r"^(.+)\.[^.]*$", "$1"))


def archive_number(name: Column) -> Column:
    """C-19: the file name's archive number; of other names of five or more parts that begin with KJ, the first five parts."""
    return first_match(stem(name), ARCHIVE_NUMBERS)


def iso_date(c: Column) -> Column:
    """The first date of the first notation that occurs, as year-month-day; months and days are not checked."""
    found = [F.when(F.regexp_extract(c, p, 0) != "", F.concat_ws("-", F.regexp_extract(c, p, 1), *(F.lpad(F.regexp_extract(c, p, g), 2, "0") for g in (2, 3)))) for p in DATES]
    return F.coalesce(*found, F.lit(""))


def text_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), coerced), lambda x: x != "")


def legacy_title(titles: Column, lines: Column) -> Column:
    """The longest title region; else one of the first lines that names a kind of document; else the longest of them."""
    region = F.aggregate(F.coalesce(titles, F.array().cast("array<string>")), F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), coerced(x)).otherwise(best))
    named = F.get(F.filter(F.slice(lines, 1, 10), lambda x: (F.length(x) >= 6) & ~x.rlike(PAGE_HEAD) & x.rlike(TITLE_WORDS)), F.lit(0))
    longest = F.aggregate(F.slice(lines, 1, 8), F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return F.coalesce(F.nullif(region, F.lit("")), named, F.left(longest, F.lit(100)))


def legacy_fields(name: Column, text: Column, titles: Column, page_count: Column) -> dict[str, Column]:
    """C-29b: the eight fields of one task; what is not found is empty. A null text is an empty one, null titles are none."""
    plain = coerced(F.regexp_replace(coerced(text), r"\s+", " "))
    number = F.trim(first_match(plain, DOC_NUMBERS))
    return {
        "archive_no": archive_number(name),
        "doc_no": number,
        "responsible": F.coalesce(F.nullif(first_match(plain, RESPONSIBLE, 1), F.lit("")), F.regexp_extract(number, HAN, 1)),
        "title": legacy_title(titles, text_lines(text)),
        "date": iso_date(plain),
        "pages": F.coalesce(F.nullif(page_count, F.lit(0)).cast("string"), F.lit("")),
        "classification": F.regexp_extract(F.left(plain, F.lit(200)), CLASSIFICATION, 0),
        "remarks": F.lit(""),
    }


def markdown_plain(c: Column) -> Column:
    """C-34: a Markdown line without images, link targets, heading and list marks and emphasis."""
    steps = ((r"!\[[^\]]*\]\([^)]+\)", " "), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"^\s{0,3}#{1,6}\s*", ""), (r"^\s*[-*+]\s+", ""), (r"^\s*\d+[.)]\s+", ""), (r"\*\*", ""), ("__", ""), ("`", ""), (r"\s+", " "))
    return F.trim(reduce(lambda x, step: F.regexp_replace(x, *step), steps, F.coalesce(c, F.lit(""))))


def markdown_rows(c: Column) -> Column:
    """C-33: the cells of a Markdown table by rows; null for a text that is none, or whose cells are all blank.

    A table has two lines or more with two bars, the second of them the divider. Every line with a bar is a row.
    """
    lines = text_lines(c)
    divider = F.regexp_replace(F.get(F.filter(lines, lambda x: x.rlike(r"\|.*\|")), F.lit(1)), r"[|:\- ]", "") == ""
    rows = F.filter(F.filter(lines, lambda x: F.contains(x, F.lit("|"))), lambda x, i: (i != 1) | (F.regexp_replace(x, r"[|:\- ]", "") != ""))
    cells = F.transform(rows, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), coerced))
    return F.when(divider & F.exists(F.flatten(cells), lambda x: x != ""), cells)


def table_text(rows: Column) -> Column:
    """C-32: rows that are not blank, cells joined by tabs and rows by line ends."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda x: coerced(F.replace(x, F.lit("\0"), F.lit("")))))
    return F.array_join(F.transform(F.filter(clean, lambda r: F.exists(r, lambda x: x != "")), lambda r: F.array_join(r, "\t")), "\n")
