"""Nested pages, layouts and tables of one task, as column expressions over arrays; nothing is exploded or shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import text_lines
from .text import coerced

# Heads of excerpts, marks of images in table cells, and the size above which a result is stored apart.
PARTS = ("[前部摘录]", "[中部摘录]", "[尾部摘录]")
WHOLE, TITLES, NUMBERS = "[OCR全文摘录]", "标题候选：", "文号候选："
IMAGES = r"(?i)<img\b[^>]*>|!\[[^\]]*\]\([^)]+\)"
PAGE_HEAD = r"^---\s*第\s*\d+\s*页\s*---$"
SPILL_BYTES = 1 << 20


def _said(items: Column, name: str) -> Column:
    return F.filter(F.transform(items, lambda x: coerced(F.replace(x[name], F.lit("\0"), F.lit("")))), lambda x: x != "")


def page_text(pages: Column) -> Column:
    """C-31: the text of pages (regions: array of content, lines: array of text); lines only where no region says anything.

    Of several pages each has its number as its head. Null or empty arrays say nothing.
    """

    def one(page: Column, i: Column) -> Column:
        regions = F.coalesce(_said(page["regions"], "content"), F.array().cast("array<string>"))
        text = coerced(F.array_join(F.when(F.size(regions) > 0, regions).otherwise(_said(page["lines"], "text")), "\n"))
        return F.when(text != "", F.when(F.size(pages) > 1, F.concat(F.lit("--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), text)).otherwise(text))

    return F.coalesce(F.array_join(F.filter(F.transform(pages, one), lambda x: x.isNotNull()), "\n\n"), F.lit(""))


def looked_up(layouts: Column, items: Column, key: str = "layout_id") -> Column:
    """J-14: (layout, item) of each layout; of items that share its key the last one, null without any."""
    return F.transform(layouts, lambda x: F.struct(x.alias("layout"), F.get(F.filter(F.reverse(items), lambda y: y[key] == x[key]), F.lit(0)).alias("item")))


def gathered(lines: Column, places: Column) -> Column:
    """J-15: the lines at these places from 0, each once, in the order of the places; others than existing ones are left out."""
    return F.transform(F.filter(F.array_distinct(places), lambda i: (i >= 0) & (i < F.size(lines))), lambda i: F.get(lines, i))


def cell_rows(cells: Column, matrix: Column) -> Column:
    """J-16: rows of a table from a matrix of cell numbers. A merged cell, whose number recurs, is written where it first occurs.

    Rows that are blank go; a row that says one thing three times or more says it once. Without content, one blank cell is left.
    """
    clean = F.transform(cells, lambda x: coerced(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), IMAGES, " "), r"\s+", " ")))
    flat = F.flatten(matrix)

    def row(numbers: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(matrix, F.lit(1), i), F.lit(0), lambda n, r: n + F.size(r))
        written = lambda c, j: (c >= 0) & (c < F.size(clean)) & (F.array_position(flat, c) == before + j + 1)
        return F.transform(numbers, lambda c, j: F.when(written(c, j), F.get(clean, c)).otherwise(""))

    def once(cells: Column) -> Column:
        said = F.filter(cells, lambda x: x != "")
        merged = (F.size(said) >= 3) & (F.size(F.array_distinct(said)) == 1)
        return F.when(merged, F.transform(cells, lambda x, j: F.when(j == 0, F.get(said, F.lit(0))).otherwise(""))).otherwise(cells)

    rows = F.transform(F.filter(F.transform(matrix, row), lambda r: F.exists(r, lambda x: x != "")), once)
    return F.when(F.size(rows) > 0, rows).otherwise(F.array(F.array(F.lit(""))))


def candidates_text(titles: Column, numbers: Column) -> Column:
    """C-35: the candidates that go before an excerpt, each once; empty without any."""

    def section(head: str, values: Column) -> Column:
        own = F.array_distinct(F.filter(F.transform(values, coerced), lambda x: x != ""))
        return F.when(F.size(own) > 0, F.concat(F.lit(head + "\n"), F.array_join(F.transform(own, lambda x: F.concat(F.lit("- "), x)), "\n")))

    return F.concat_ws("\n\n", section(TITLES, titles), section(NUMBERS, numbers))


def excerpt(text: Column, extra: Column, most: int) -> Column:
    """C-35: the lines of a text but the heads of its pages, or, of a longer one or with candidates before it, its start, middle and end; `most` characters at most."""
    clean = F.array_join(F.filter(text_lines(text), lambda x: ~x.rlike(PAGE_HEAD)), "\n")
    left = F.greatest(F.lit(most) - F.length(extra) - 260, F.lit(360))
    front, middle, tail = (F.greatest(F.floor(left * share).cast("int"), F.lit(least)) for share, least in ((0.45, 200), (0.2, 120), (0.35, 200)))
    start = F.greatest(F.floor(F.length(clean) / 2) - F.floor(middle / 2), F.lit(0)).cast("int")
    cuts = F.left(clean, front), F.substring(clean, start + 1, middle), F.right(clean, tail)
    parts = coerced(F.concat_ws("\n\n", *(F.concat(F.lit(head + "\n"), cut) for head, cut in zip(PARTS, cuts))))
    whole = F.when(extra == "", parts).otherwise(F.concat(extra, F.lit(f"\n\n{WHOLE}\n"), parts))
    return F.when((F.length(clean) <= most) & (extra == ""), clean).otherwise(F.left(whole, F.lit(most)))


def spilled(payload: Column, most: int = SPILL_BYTES, home: str = "results") -> dict[str, Column]:
    """K-08: whether a result is stored apart, its digest then, and where it is."""
    apart = F.coalesce(F.octet_length(payload), F.lit(0)) > most
    return {"apart": apart, "sha256": F.when(apart, F.sha2(payload.cast("binary"), 256)), "locator": F.when(apart, F.concat(F.lit(f"{home}/"), F.sha2(payload.cast("binary"), 256)))}
