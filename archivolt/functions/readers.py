"""What other readers return as pages of one shape: Markdown, layouts with tables and images by id, lines of words. Nothing is exploded or shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fields import markdown_plain, markdown_rows, table_text
from .grids import bar_rows, markdown_html, with_content
from .layout import IMAGES, cell_rows
from .shapes import entries, items, location, member, number, once, plain, points, rectangle
from .text import coerced, foreign_region

# What stands for a table in a text, the head of a page, and names of a place and of a probability.
TABLE_MARK, PAGE_HEAD = "[表格]", "--- 第 %d 页 ---\n%s"
PLACES, CHANCES = ("poly_location", "words_location", "location"), ("probability", "average", "score", "confidence")


def markdown_page(text: Column) -> Column:
    """S-15: struct<regions,lines> of a page given as Markdown: blocks between blank lines are tables or texts, their lines without marks.

    regions: array of struct<type,content,table_data,html,region_lines>; lines: all lines in order, numbered by place.
    """
    blocks = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), r"\n(?:[^\S\n]*\n)+"), lambda x: coerced(x) != "")
    clean = lambda c: F.filter(F.transform(F.split(c, "\n"), markdown_plain), lambda x: x != "")

    def block(x: Column) -> Column:
        rows = F.coalesce(with_content(bar_rows(x)), F.array(F.array(F.lit(""))))
        # a block is a table by its bars and divider, whether its cells say anything or not
        bars = F.filter(F.transform(F.split(x, "\n"), coerced), lambda y: y.rlike(r"\|.*\|"))
        is_table = (F.size(bars) >= 2) & (F.regexp_replace(F.get(bars, F.lit(1)), r"[|:\- ]", "") == "")
        own = F.struct(F.lit("table").alias("type"), table_text(rows).alias("content"), rows.alias("table_data"), markdown_html(x).alias("html"), clean(table_text(rows)).alias("region_lines"))
        of_text = F.struct(F.lit("text").alias("type"), F.array_join(clean(x), "\n").alias("content"), F.lit(None).cast("array<array<string>>").alias("table_data"), F.lit(None).cast("string").alias("html"), clean(x).alias("region_lines"))
        return F.when(F.coalesce(is_table, F.lit(False)), own).when(F.size(clean(x)) > 0, of_text)

    regions = F.filter(F.transform(blocks, block), lambda r: r.isNotNull())
    return once(regions, lambda r: F.struct(r.alias("regions"), F.flatten(F.transform(r, lambda x: x["region_lines"])).alias("lines")))


def _told(v: Column) -> Column:
    return coerced(F.try_variant_get(v, "$", "string"))


def _last(found: Column, id_: Column) -> Column:
    """The last of found objects that has this layout_id."""
    return F.get(F.reverse(F.filter(found, lambda t: (_told(member(t, "layout_id")) == id_) & (id_ != ""))), F.lit(0))


def foreign_table(t: Column) -> Column:
    """The cells of a table given by cells and a matrix of their numbers (merged cells recur), else by Markdown; one blank cell without either."""
    texts = F.transform(items(member(t, "cells")), lambda c: F.try_variant_get(member(entries(c), "text"), "$", "string"))
    matrix = F.transform(items(member(t, "matrix")), lambda r: F.transform(items(r), lambda n: F.try_variant_get(n, "$", "int")))
    blank = F.array(F.array(F.lit("")))

    def of_markdown(c: Column) -> Column:
        tidy = F.transform(bar_rows(c), lambda r: F.transform(r, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, IMAGES, " "), r"\s+", " "))))

        def merged(r: Column) -> Column:
            some = F.filter(r, lambda x: x != "")
            return F.when((F.size(some) >= 3) & (F.size(F.array_distinct(some)) == 1), F.transform(r, lambda x, k: F.when(k == 0, F.get(some, F.lit(0))).otherwise(""))).otherwise(r)

        return F.coalesce(with_content(F.transform(tidy, merged)), blank)

    markdown = F.try_variant_get(member(t, "markdown"), "$", "string")
    return F.when((F.size(texts) > 0) & (F.size(matrix) > 0), cell_rows(texts, matrix)).when(markdown != "", of_markdown(markdown)).otherwise(blank)


def layout_regions(page: Column) -> Column:
    """S-16: the regions of a page (an object): its layouts with the tables and images of their ids; layouts that are no objects go.

    array of struct<type,bbox,content,table_data,html,region_lines>; region_lines: array of struct<text,bbox>.
    """
    objects = lambda name: F.filter(F.transform(items(member(page, name)), entries), lambda o: o.isNotNull())

    def region(x: Column) -> Column:
        kind = F.coalesce(F.nullif(F.try_variant_get(member(x["o"], "type"), "$", "string"), F.lit("")), F.lit("text"))
        table = (kind == "table") & x["table"].isNotNull()
        text = F.when(table | (kind == "image") & x["image"].isNotNull(), "").otherwise(plain(member(x["o"], "text")))
        markdown = F.try_variant_get(member(x["table"], "markdown"), "$", "string")
        spans = F.transform(items(member(x["o"], "span_boxes")), lambda s: once(entries(s), lambda o: F.struct(plain(member(o, "text")).alias("text"), location(member(o, "location")).alias("bbox"))))
        return F.struct(
            foreign_region(kind).alias("type"), location(member(x["o"], "position")).alias("bbox"), text.alias("content"), F.when(table, foreign_table(x["table"])).alias("table_data"),
            F.when(table & (markdown != ""), F.nullif(markdown_html(markdown), F.lit(""))).alias("html"), F.coalesce(F.filter(spans, lambda s: s["text"] != ""), F.array().cast("array<struct<text:string,bbox:array<double>>>")).alias("region_lines"),
        )

    both = F.struct(objects("tables").alias("tables"), objects("images").alias("images"), objects("layouts").alias("layouts"))

    def looked_up(p: Column) -> Column:
        return F.transform(p["layouts"], lambda o: once(F.coalesce(_told(member(o, "layout_id")), F.lit("")), lambda k: F.struct(o.alias("o"), _last(p["tables"], k).alias("table"), _last(p["images"], k).alias("image"))))

    return F.transform(once(both, looked_up), region)


def foreign_documents(rows: DataFrame, json: str) -> DataFrame:
    """S-16: rows with pages (page_num from 1, regions), page_count and full_text of a document's JSON; without pages one empty page."""
    out = rows.withColumn("__o", F.transform(items(member(entries(F.try_parse_json(json)), "pages")), entries))
    out = out.withColumn("__r", F.transform("__o", layout_regions))
    found = F.transform("__o", lambda o, i: F.struct((F.coalesce(number(member(o, "page_num")).cast("int"), F.lit(0)) + 1).alias("page_num"), F.coalesce(F.get("__r", i), F.array().cast(out.schema["__r"].dataType.elementType)).alias("regions")))
    empty = F.array(F.struct(F.lit(1).alias("page_num"), F.array().cast(out.schema["__r"].dataType.elementType).alias("regions")))
    out = out.withColumn("pages", F.when(F.size("__o") > 0, found).otherwise(empty))
    said = lambda r: F.filter(F.transform(r, lambda x: F.when(x["type"] == "table", TABLE_MARK).otherwise(F.nullif(x["content"], F.lit("")))), lambda x: x.isNotNull())
    texts = F.transform("pages", lambda p: F.array_join(said(p["regions"]), "\n"))
    out = out.withColumn("__t", texts).withColumn("page_count", F.size("pages"))
    whole = F.array_join(F.transform("__t", lambda t, i: F.format_string(PAGE_HEAD, i + 1, t)), "\n\n")
    return out.withColumn("full_text", F.when(F.size("__t") > 1, whole).otherwise(F.get("__t", F.lit(0)))).select(*rows.columns, "pages", "page_count", "full_text")


def chance(v: Column) -> Column:
    """A probability given as a number, an object with one under a known name, or an array, of which those over 0 are averaged."""
    scalar = lambda x: F.coalesce(number(x), F.lit(0.0))
    named = lambda x: F.coalesce(*(F.when(F.map_contains_key(entries(x), c), scalar(member(entries(x), c))) for c in CHANCES), F.when(entries(x).isNotNull(), 0.0))
    one = lambda x: F.coalesce(named(x), scalar(x))
    some = lambda a: F.round(F.coalesce(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a)), F.lit(0.0)), 4)
    return F.when(items(v).isNotNull(), once(F.filter(F.transform(items(v), one), lambda x: x > 0), some)).otherwise(one(v))


def office_lines(result: Column) -> Column:
    """S-17: array of struct<line_num,text,confidence,bbox> of a result (an object): lines as words or arrays of words; those without text go, but keep their number."""
    none = F.array().cast("array<struct<x:double,y:double>>")
    first = lambda o, names: F.coalesce(*(F.when(member(o, n).isNotNull() & ~F.coalesce(F.is_variant_null(member(o, n)), F.lit(False)), member(o, n)) for n in names))
    around = lambda o: once(first(o, PLACES), lambda v: once(points(v), lambda p: F.when(F.size(p) > 0, rectangle(p)).otherwise(location(v))))
    word = lambda o: F.coalesce(F.nullif(plain(member(o, "word")), F.lit("")), plain(member(o, "words")))
    corner = lambda r: F.when(F.size(r) == 4, F.array(F.struct(F.get(r, F.lit(0)).alias("x"), F.get(r, F.lit(1)).alias("y")), F.struct(F.get(r, F.lit(2)).alias("x"), F.get(r, F.lit(3)).alias("y")))).otherwise(none)

    def parts(x: Column, i: Column) -> Column:
        def of(o: Column) -> Column:
            words = member(o, "words")
            each = F.transform(items(words), lambda w: once(entries(w), lambda e: F.struct(F.when(e.isNotNull(), word(e)).otherwise(plain(w)).alias("text"), F.when(e.isNotNull(), around(e)).alias("box"))))
            single = entries(words)
            text = F.when(items(words).isNotNull(), F.array_join(F.transform(each, lambda w: w["text"]), "")).when(single.isNotNull(), word(single)).otherwise(word(o))
            box = F.when(items(words).isNotNull(), rectangle(F.flatten(F.transform(each, lambda w: F.coalesce(corner(w["box"]), none))))).when(single.isNotNull(), around(single))
            return F.struct((i + 1).alias("line_num"), text.alias("text"), F.round(chance(first(o, ("line_probability", "probability"))), 4).alias("confidence"), F.when(F.size(box) == 4, box).otherwise(around(o)).alias("bbox"))

        return once(entries(x), of)

    return F.filter(F.transform(items(member(result, "results")), parts), lambda y: y["text"] != "")
