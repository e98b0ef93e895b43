"""Titles, responsible parties and all eight archive fields of a document, from its placed items.

items as in scored.py, with x2, y2, height, source (region, line or text) and seq, the item's number on its page (regions first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.fields import archive_number
from archivolt.functions.text import dates, is_page_number, once
from archivolt.operators.graph import _written as written

from . import scored
from .scored import TITLE_KINDS, clean_line, doc_number, search_text, text_lines

# Words and ends of titles, names and marks of organisations, and lines that are no title.
TITLE_WORDS = ("关于", "通知", "决定", "意见", "办法", "规则", "方法", "规范", "条例", "规定", "请示", "通报", "公告", "方案", "细则", "会议纪要")
TITLE_ENDS = ("通知", "决定", "意见", "办法", "规则", "方法", "规范", "条例", "规定", "请示", "通报", "公告", "方案", "细则", "会议纪要")
ABOUT = "关于"
ORGANISATIONS = (
    "工会委员会", "委员会办公室", "人力资源和社会保障局", "人力资源和社会保障厅", "人力资源和社会保障部", "人民政府", "总工会", "办公室", "工会", "委员会", "档案馆", "档案局", "有限责任公司", "集团有限公司",
    "股份有限公司", "有限公司", "检察院", "法院", "医院", "学校", "大学", "学院", "集团", "公司", "政府", "党委", "支部", "协会", "中心", "银行", "局", "厅", "部", "院", "馆",
)
ACTS = "关于|印发|发布|转发|公布|报送|请示|通知|决定|意见|办法|规定|通报|公告|方案"
PARTY_ENDS = "有限公司|集团有限公司|集团|公司|委员会|办公室|档案局|档案馆|政府|中心|银行|局|厅|部|院|馆"
NAME = r"\x{4e00}-\x{9fa5}A-Za-z0-9·（）()"
PARTY, CLAUSE = r"^[甲乙丙丁]方[:：]", r"^(第[一二三四五六七八九十百零\d]+条|[（(]?[一二三四五六七八九十百零\d]+[）).、])"
SEALED = r"[（(][^()（）]*(?:盖章|印章|公章|章)[^()（）]*[）)]"
SEALS, NO_PARTY = ("盖章", "印章", "公章"), ("附件", "目录", "日期")
MARKS = "[ ，。；;:：]+"
NUMBER_HEAD = r"^([\x{4e00}-\x{9fa5}A-Za-z]{2,20})"
# The same patterns put together: the longest end of a name is tried first.
ORGANISATION = rf"[{NAME}]{{2,60}}(?:{'|'.join(sorted(ORGANISATIONS, key=len, reverse=True))})"
ACTING, ENDING, ANYWHERE = rf"({ORGANISATION})\s*(?:{ACTS})", rf"({ORGANISATION})$", f"({ORGANISATION})"
#: What the name of any organisation or party ends with: a text without one holds no name.
LAST = f"[{''.join(sorted({w[-1] for w in (*ORGANISATIONS, *PARTY_ENDS.split('|'))}))}]"
PARTY_NAME = rf"{PARTY}\s*([{NAME}]+(?:{PARTY_ENDS}))"
#: Top part of a page that can hold a title; groups that are compared; the least gap between two lines of a title and its share of the line above.
TOP, GROUPS, GAP, GAP_SHARE = 0.55, 6, 18.0, 1.8


def _is_title(c: Column) -> Column:
    return scored._has(c, TITLE_WORDS)


def title_score(text: Column, kind: Column, source: Column, page: Column, y: Column) -> Column:
    """How likely an item is a line of the title; what can't be one has less than 0."""
    n = F.length(text)
    plain = scored._points((kind.isin(*TITLE_KINDS), 14), (source == "region", 3), (_is_title(text), 10), (y < 0.35, 4)) + F.when(n.between(6, 40), 5).when(n <= 80, 2).otherwise(-4)
    office = F.coalesce(F.regexp_extract(text, f"({'|'.join(ORGANISATIONS)})$", 0), F.lit("")) != ""
    plain = plain + scored._points((office & ~F.contains(text, F.lit(ABOUT)), -5), (F.length(F.regexp_replace(text, "[^0-9]", "")) >= 8, -4))
    out = F.when((page != 0) | (y > TOP) | text.rlike(PARTY) | text.rlike(CLAUSE) | is_page_number(search_text(text)), -100)
    out = out.when(doc_number(text) != "", -80).when((F.size(dates(search_text(text))) > 0) & (n <= 24), -40)
    return out.when(text.rlike(f"^(?:{scored.CLASSIFICATION})$"), -40).otherwise(plain)


def titles(items: DataFrame) -> DataFrame:
    """C-25, T-08: (id, title) of documents with an item that can be one.

    Such items of the first page, from its top, make runs: an item belongs to the run above if the gap is no more than
    GAP or GAP_SHARE of the height of the item before it. Of the first GROUPS runs the first of greatest score is the title.
    Windows hold a page's title lines only.
    """
    lines = items.filter((F.col("page_index") == 0) & (F.col("y_ratio") <= TOP)).withColumn("score", title_score(*(F.col(c) for c in ("text", "kind", "source", "page_index", "y_ratio")))).filter("score > 0")
    order = Window.partitionBy("id").orderBy("y1", "x1", "seq")
    gap = F.col("y1") - F.lag("y2").over(order)
    apart = F.coalesce(gap > F.greatest(F.lit(GAP), F.lag("height").over(order) * GAP_SHARE), F.lit(False))
    lines = lines.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(order)).filter(F.col("run") < GROUPS)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y1", "x1", "seq", "text"))), lambda x: x["text"]), "")
    runs = lines.groupBy("id", "run").agg(F.left(F.regexp_replace(text, r"\s+", ""), F.lit(120)).alias("title"), F.sum("score").alias("score"))
    more = scored._points((_is_title(F.col("title")), 6), (F.length("title").between(8, 80), 4), (F.col("title").rlike(f"(?:{'|'.join(TITLE_ENDS)})$"), 2))
    return runs.groupBy("id").agg(F.max_by("title", F.struct((F.col("score") + more).alias("s"), -F.col("run"))).alias("title"))


def organisation(c: Column) -> Column:
    """A name without marks of seals and what it did; empty if none of 4 to 40 characters is left."""
    bare = lambda x: F.regexp_replace(x, f"^{MARKS}|{MARKS}$", "")
    clean = bare(F.regexp_replace(F.regexp_replace(clean_line(c), SEALED, ""), f"(?:{ACTS}).*$", ""))
    inner = lambda x: once(bare(F.regexp_extract(x, ANYWHERE, 1)), lambda n: F.when(n == "", x).otherwise(n))
    return once(once(clean, inner), lambda name: F.when(F.length(name).between(4, 40), name).otherwise(""))


def organisations(c: Column) -> Column:
    """The names in a text, each once: of a party to a contract, before an act, at the end, and anywhere."""
    found = lambda line: F.concat(F.array(F.regexp_extract(line, PARTY_NAME, 1)), *(F.regexp_extract_all(line, F.lit(p), F.lit(1)) for p in (ACTING, ENDING, ANYWHERE)))
    names = F.array_distinct(F.filter(F.transform(once(clean_line(c), found), organisation), lambda x: x != ""))
    return F.when(c.rlike(LAST), names).otherwise(F.array().cast("array<string>"))


def responsible(items: DataFrame) -> DataFrame:
    """C-26: (id, responsible): the name of greatest score among all names of all items; of equal ones the first in the document."""
    each = items.select("*", F.posexplode(organisations(F.col("text"))).alias("nth", "name"))
    text, name, page, y = F.col("text"), F.col("name"), F.col("page_index"), F.col("y_ratio")
    score = scored._points(
        ((page == 0) & (y < 0.35), 8), ((page == F.col("page_total") - 1) & (y > 0.55), 12), (F.col("kind") == "seal", 5), (scored._has(text, SEALS), 4), (text.rlike(ACTING), 6),
        (clean_line(text).rlike(ENDING), 4), (F.length(name).between(4, 24), 3), (F.length(name) > 32, -2), (doc_number(text) != "", -2), (scored._has(name, NO_PARTY), -4),
    )
    first = F.struct(score.alias("s"), *((-F.col(c)).alias(c) for c in ("page_index", "y1", "x1", "seq", "nth")))
    return each.groupBy("id").agg(F.max_by("name", first).alias("responsible"))


def text_items(texts: DataFrame) -> DataFrame:
    """Items of documents (id, full_text) without placed ones: their lines, one below the other on one page."""
    lines = texts.select("id", text_lines(F.col("full_text")).alias("l"))
    rows = lines.select("id", F.size("l").alias("n"), F.posexplode("l").alias("k", "text"))
    k = F.col("k").cast("double")
    return rows.select("id", F.lit(0).alias("page_index"), F.lit(1).alias("page_total"), (k / F.col("n")).alias("y_ratio"), F.lit(0.0).alias("x1"), k.alias("y1"), F.lit(100.0).alias("x2"), (k + 1).alias("y2"), F.lit(1.0).alias("height"), "text", F.lit("text").alias("kind"), F.lit("text").alias("source"), F.col("k").alias("seq"))


def all_items(items: DataFrame, texts: DataFrame) -> DataFrame:
    """C-21: the distinct placed items, and the lines of documents that have none."""
    without = texts.join(items.select("id").distinct(), "id", "left_anti")
    return scored.distinct_items(items).unionByName(text_items(without))


def title_of_lines(lines: Column) -> Column:
    """The first of ten lines that names a kind of document; else the longest of eight."""
    named = F.filter(F.slice(lines, 1, 10), lambda x: (F.length(x) >= 6) & _is_title(x) & ~is_page_number(search_text(x)) & (doc_number(x) == ""))
    longest = F.aggregate(F.slice(lines, 1, 8), F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return F.left(F.coalesce(F.get(named, F.lit(0)), longest), F.lit(120))


def eight_fields(items: DataFrame, texts: DataFrame) -> DataFrame:
    """C-20: one row of eight fields for each of texts (id, filename, full_text, page_count); what is not found is ''.

    items may lack documents, whose lines are used then, and may repeat an item, which counts once. Items are written
    once, and a text is cut into lines once.
    """
    own = written(all_items(items, texts))
    found = scored.scored_fields(own).join(titles(own), "id", "full").join(responsible(own), "id", "full")
    rows = texts.join(found, "id", "left").withColumn("lines", text_lines(F.col("full_text")))
    other = scored.fall_backs(F.col("lines"), F.col("full_text"))
    rows = rows.withColumns({c: F.coalesce(F.col(c), v, F.lit("")) for c, v in other.items()})
    party = F.coalesce("responsible", F.regexp_extract("doc_no", NUMBER_HEAD, 1))
    pages = F.coalesce(F.nullif(F.col("page_count").cast("long"), F.lit(0)).cast("string"), F.lit(""))
    return rows.select("id", archive_number(F.col("filename")).alias("archive_no"), "doc_no", party.alias("responsible"), F.coalesce(F.nullif(F.col("title"), F.lit("")), title_of_lines(F.col("lines"))).alias("title"), "date", pages.alias("pages"), "classification", F.lit("").alias("remarks"))
