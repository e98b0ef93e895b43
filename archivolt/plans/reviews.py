"""Queries of rule fields, tables in texts and review routes, beside their SQL. Tasks get made-up heads, names and issues by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import fields as x
from archivolt.functions import layout as y
from archivolt.operators import review as r
from archivolt.plans.data import TASKS, tasks

# SQL of both engines.
NAME = "CASE id % 6 WHEN 0 THEN 'WS·2024·D10-0311-' || id || '.jpg' WHEN 1 THEN '/in/KJ-JJ-2017-02-001-' || id || '.tif' WHEN 2 THEN 'kj-a b-1-2-3-4.jpg' WHEN 3 THEN 'WS2024D10.jpg' ELSE batch_id || '.txt' END"
HEAD = "CASE id % 5 WHEN 0 THEN '市档案局 关于印发档案管理办法的通知' || chr(10) || '渝人社发〔2015〕188号' || chr(10) || '2015年3月7日 内部' WHEN 1 THEN '  第3页' || chr(10) || '某县人民政府 第 12 号' || chr(10) || '印于 2016-1-05' WHEN 2 THEN '秘密 编号20170304' ELSE '' END || chr(10) || coalesce(full_text, '')"
LINE = "CASE id % 5 WHEN 0 THEN ' ## [a](b) **' || batch_id || '** ![i](j)' WHEN 1 THEN '- `x` ' WHEN 2 THEN '12) __' ELSE '' END || full_text"
TABLE = "CASE id % 4 WHEN 0 THEN '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || batch_id || ' | ' || id || '|' WHEN 1 THEN 'a|b|c' || chr(10) || id || '|x|' WHEN 2 THEN '||' || chr(10) || '|-|' || chr(10) || ' | | ' END"
ISSUE = "CASE id % 9 WHEN 0 THEN '第1页签名模糊' WHEN 1 THEN '文号缺失' WHEN 2 THEN '置信度低于阈值，需人工复核' WHEN 3 THEN 'Vision LLM unavailable' WHEN 4 THEN ' 日期不一致' WHEN 5 THEN '无需人工审核，已处理错误' WHEN 6 THEN '识别失败' WHEN 7 THEN '' END"
MODE = "CASE id % 4 WHEN 0 THEN 'vl' WHEN 1 THEN 'layout' WHEN 2 THEN 'ocr' ELSE 'basic' END"
CONFIDENCE, OTHER = "CAST(coalesce(n_chars, 0) % 101 AS DOUBLE) / 100", "CAST(id % 7 AS DOUBLE) / 10"


def archive_numbers(s, d):
    return tasks(s, d).select("id", x.archive_number(F.expr(NAME)).alias("archive_no"))


def legacy(s, d):
    titles = F.when(F.col("id") % 3 == 0, F.array(F.lit("ab"), F.lit("abcd"), F.lit("xyzw")))
    found = x.legacy_fields(F.expr(NAME), F.expr(HEAD), titles, F.col("id") % 4)
    return tasks(s, d).select("id", *(c.alias(n) for n, c in found.items()))


def markdown(s, d):
    rows = x.markdown_rows(F.expr(TABLE))
    return tasks(s, d).select("id", F.md5(x.markdown_plain(F.expr(LINE)).cast("binary")).alias("plain"), F.size(rows).cast("long").alias("n_rows"), x.table_text(rows).alias("table_text"))


def issues(s, d):
    t = tasks(s, d).withColumn("issue", F.expr(ISSUE))
    c = F.coalesce("issue", F.lit(""))
    return t.select("id", *(f(c).alias(f.__name__) for f in (r.illegible, r.optional_absence, r.operational, r.blocking)))


def routes(s, d):
    t = tasks(s, d).select("id", F.expr(ISSUE).alias("issue"), F.expr(CONFIDENCE).alias("confidence"))
    clash = F.when(F.col("id") % 4 == 0, F.array(F.lit("文号"), F.lit("日期")))
    return t.select("id", *(c.alias(n) for n, c in r.review_route(clash, F.array("issue"), F.col("confidence")).items()))


def pages(s, d):
    t = tasks(s, d).select("id", F.expr(MODE).alias("mode"), F.expr(CONFIDENCE).alias("complexity"))
    strategy = F.when(F.col("id") % 5 == 0, " deskew ")
    return t.select("id", *(c.alias(n) for n, c in r.page_route(F.col("mode"), F.col("complexity"), F.col("id") % 3 - 1, strategy).items()))


def readers(s, d):
    t = tasks(s, d).select("id", "lang", "batch_id", F.expr(CONFIDENCE).alias("x"), F.expr(OTHER).alias("y"))
    a, b = F.when(F.col("id") % 3 > 0, F.col("lang")), F.when(F.col("id") % 5 > 0, F.concat(F.lit(" "), F.col("batch_id")))
    field = r.two_readers(a, b, F.col("x"), F.col("y"))
    return t.select("id", field.alias("field"), r.corrected(field, F.when(F.col("id") % 7 == 0, "fixed").otherwise(" ")).alias("corrected"), *(c.alias(n) for n, c in r.two_confidences(F.col("x"), F.col("y")).items()))


def excerpts(s, d):
    extra = y.candidates_text(F.when(F.col("id") % 3 == 1, F.array("batch_id", "lang", "batch_id")), F.when(F.col("id") % 4 == 1, F.array(F.lit(" x "))))
    return tasks(s, d).select("id", F.md5(extra.cast("binary")).alias("extra"), F.md5(y.excerpt(F.col("full_text"), extra, 2000).cast("binary")).alias("excerpt"))


def gathered(s, d):
    lines = F.split(F.coalesce("full_text", F.lit("")), "\n")
    places = F.array((F.col("id") % 5).cast("int"), F.lit(0), (F.col("id") % 3).cast("int"), F.lit(-1), F.lit(100000))
    return tasks(s, d).select("id", F.md5(F.array_join(y.gathered(lines, places), "|").cast("binary")).alias("lines"))


def spilled(s, d):
    return tasks(s, d).select("id", *(c.alias(n) for n, c in y.spilled(F.col("full_text"), 4096).items()))


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
LINES = f"list_filter(list_transform(string_split({{}}, chr(10)), lambda v: {STRIP.format('v')}), lambda v: v <> '')"


def _first(c: str, patterns, group: int = 0) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, '{p}', {group}), '')" for p in patterns) + ", '')"


def _any(c: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches({c}, '{'|'.join(words)}')"


NUMBER_SQL = _first("stem", x.ARCHIVE_NUMBERS)
STEM_SQL = rf"trim(regexp_replace(string_split({NAME}, '/')[-1], '^(.+)\.[^.]*$', '\1'))"
DATE_SQL = "coalesce(" + ", ".join(f"CASE WHEN regexp_extract(p, '{q}', 0) <> '' THEN concat_ws('-', regexp_extract(p, '{q}', 1), lpad(regexp_extract(p, '{q}', 2), 2, '0'), lpad(regexp_extract(p, '{q}', 3), 2, '0')) END" for q in x.DATES) + ", '')"
LEGACY_SQL = rf"""
WITH a AS (SELECT id, coalesce({STEM_SQL}, '') AS stem, {HEAD} AS t FROM {TASKS}),
b AS (SELECT *, {STRIP.format(r"regexp_replace(t, '\s+', ' ', 'g')")} AS p, {LINES.format('t')} AS lines FROM a),
c AS (SELECT *, trim({_first('p', x.DOC_NUMBERS)}) AS doc_no FROM b)
SELECT id, {NUMBER_SQL} AS archive_no, doc_no, coalesce(nullif({_first('p', x.RESPONSIBLE, 1)}, ''), regexp_extract(doc_no, '{x.HAN}', 1)) AS responsible,
  CASE WHEN id % 3 = 0 THEN 'abcd' ELSE coalesce(list_filter(lines[1:10], lambda v: length(v) >= 6 AND NOT regexp_matches(v, '{x.PAGE_HEAD}') AND regexp_matches(v, '{x.TITLE_WORDS}'))[1],
    left(list_reduce(list_concat([''], lines[1:8]), lambda u, v: CASE WHEN length(v) > length(u) THEN v ELSE u END), 100)) END AS title,
  {DATE_SQL} AS date, CASE WHEN id % 4 = 0 THEN '' ELSE CAST(id % 4 AS VARCHAR) END AS pages, regexp_extract(left(p, 200), '{x.CLASSIFICATION}', 0) AS classification, '' AS remarks FROM c
"""
MARKDOWN_SQL = rf"""
SELECT id, md5(trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({LINE}, ''), '!\[[^\]]*\]\([^)]+\)', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'),
  '^\s{{0,3}}#{{1,6}}\s*', ''), '^\s*[-*+]\s+', ''), '^\s*\d+[.)]\s+', ''), '**', ''), '__', ''), '`', ''), '\s+', ' ', 'g'))) AS plain,
  CASE WHEN id % 4 = 0 THEN 2::BIGINT END AS n_rows, CASE WHEN id % 4 = 0 THEN 'a' || chr(9) || 'b' || chr(10) || batch_id || chr(9) || id END AS table_text FROM {TASKS}
"""
ISSUES = f"""(SELECT *, operational_ IS FALSE AND (illegible OR {_any('t', r.BLOCKING)}) AS blocking FROM (SELECT *, regexp_matches(t, '{r.NO_RESULT}') OR regexp_matches(t, '{r.NO_TEXT}')
  OR ((contains(lower(t), 'vision llm') OR contains(lower(t), 'pp-ocr-vl') OR contains(lower(t), 'paddleocr-vl')) AND (contains(lower(t), 'unavailable') OR contains(lower(t), 'not configured')))
  OR {_any('t', r.HARMLESS)} OR (contains(t, '置信度') AND contains(t, '低于阈值') AND contains(t, '人工复核') AND NOT illegible) OR optional_absence AS operational_
  FROM (SELECT *, NOT illegible AND {_any('t', r.OPTIONAL_FIELDS)} AND {_any('t', r.ABSENCE)} AS optional_absence FROM (SELECT *, {_any('t', r.LEGIBILITY)} AS illegible
  FROM (SELECT *, trim(coalesce({ISSUE}, '')) AS t FROM {TASKS})))))"""
ROUTES_SQL = f"""
SELECT id, review AS human_review, CASE WHEN NOT review THEN 'approved' WHEN id % 4 = 0 OR c >= 0.6 THEN 'pending_human_review' ELSE 'required' END AS review_status,
  concat_ws('；', CASE WHEN id % 4 = 0 THEN '跨页关键字段冲突：文号, 日期' END, CASE WHEN blocking THEN t END,
    CASE WHEN review AND c < 0.6 THEN printf('总体置信度 %.2f 低于 0.60', c) WHEN review AND c <= 0.85 THEN printf('总体置信度 %.2f 落在人工审核区间', c) END) AS review_reason
FROM (SELECT *, id % 4 = 0 OR blocking AS review, {CONFIDENCE} AS c FROM {ISSUES})
"""
PAGES_SQL = f"""
SELECT id, mode = 'vl' OR id % 3 = 2 OR c >= 0.45 AS second_reader, CASE WHEN id % 5 = 0 THEN 'deskew' WHEN mode IN ('layout', 'ocr') AND c >= 0.35 THEN 'opencv_document' ELSE 'none' END AS strategy
FROM (SELECT id, {MODE} AS mode, {CONFIDENCE} AS c FROM {TASKS})
"""
READERS_SQL = f"""
SELECT id, field, CASE WHEN id % 7 = 0 THEN 'fixed' ELSE field END AS corrected, CASE WHEN x > 0 AND y > 0 THEN round(least(1.0, x * 0.45::DOUBLE + y * 0.55::DOUBLE), 4) ELSE greatest(x, y, 0.35::DOUBLE) END AS confidence,
  CASE WHEN x > 0 AND y > 0 THEN 'hybrid' WHEN x >= y THEN 'ocr' ELSE 'ppocr_vl' END AS source
FROM (SELECT *, CASE WHEN a <> '' AND b <> '' AND a <> b AND x < y THEN b WHEN a <> '' THEN a ELSE b END AS field
  FROM (SELECT id, CASE WHEN id % 3 > 0 THEN coalesce(lang, '') ELSE '' END AS a, CASE WHEN id % 5 > 0 THEN coalesce(batch_id, '') ELSE '' END AS b, {CONFIDENCE} AS x, {OTHER} AS y FROM {TASKS}))
"""
EXCERPT_SQL = rf"""
WITH a AS (SELECT id, array_to_string({LINES.format("coalesce(full_text, '')")}, chr(10)) AS c, concat_ws(chr(10) || chr(10),
    CASE WHEN id % 3 = 1 AND coalesce(batch_id, lang) IS NOT NULL THEN '{y.TITLES}' || chr(10) || concat_ws(chr(10), '- ' || batch_id, '- ' || lang) END, CASE WHEN id % 4 = 1 THEN '{y.NUMBERS}' || chr(10) || '- x' END) AS e FROM {TASKS}),
b AS (SELECT *, greatest(2000 - length(e) - 260, 360) AS r FROM a),
s AS (SELECT *, greatest(CAST(floor(r * 0.45::DOUBLE) AS BIGINT), 200) AS f, greatest(CAST(floor(r * 0.2::DOUBLE) AS BIGINT), 120) AS m, greatest(CAST(floor(r * 0.35::DOUBLE) AS BIGINT), 200) AS t FROM b),
p AS (SELECT *, {STRIP.format(f"'{y.PARTS[0]}' || chr(10) || left(c, f) || chr(10) || chr(10) || '{y.PARTS[1]}' || chr(10) || substring(c, greatest(length(c) // 2 - m // 2, 0) + 1, m) || chr(10) || chr(10) || '{y.PARTS[2]}' || chr(10) || right(c, t)")} AS x FROM s)
SELECT id, md5(e) AS extra, md5(CASE WHEN length(c) <= 2000 AND e = '' THEN c ELSE left(CASE WHEN e = '' THEN x ELSE e || chr(10) || chr(10) || '{y.WHOLE}' || chr(10) || x END, 2000) END) AS excerpt FROM p
"""
GATHERED_SQL = f"""
SELECT id, md5(l[a + 1] || CASE WHEN a <> 0 AND len(l) > 0 THEN '|' || l[1] ELSE '' END || CASE WHEN b <> 0 AND b <> a AND b < len(l) THEN '|' || l[b + 1] ELSE '' END) AS lines
FROM (SELECT id, string_split(coalesce(full_text, ''), chr(10)) AS l, id % 5 AS a, id % 3 AS b FROM {TASKS}) WHERE a < len(l)
UNION ALL SELECT id, md5(l[1] || CASE WHEN b <> 0 AND b < len(l) THEN '|' || l[b + 1] ELSE '' END)
FROM (SELECT id, string_split(coalesce(full_text, ''), chr(10)) AS l, id % 5 AS a, id % 3 AS b FROM {TASKS}) WHERE a >= len(l)
"""

QUERIES = {
    "C-35_excerpts": (excerpts, EXCERPT_SQL),
    "J-15_gathered_lines": (gathered, GATHERED_SQL),
    "K-08_spilled_results": (spilled, f"SELECT id, coalesce(strlen(full_text), 0) > 4096 AS apart, CASE WHEN strlen(full_text) > 4096 THEN sha256(full_text) END AS sha256, CASE WHEN strlen(full_text) > 4096 THEN 'results/' || sha256(full_text) END AS locator FROM {TASKS}"),
    "C-19_archive_number": (archive_numbers, f"SELECT id, {NUMBER_SQL} AS archive_no FROM (SELECT id, coalesce({STEM_SQL}, '') AS stem FROM {TASKS})"),
    "C-29b_legacy_fields": (legacy, LEGACY_SQL),
    "C-32_C-33_C-34_markdown": (markdown, MARKDOWN_SQL),
    "F-18_issue_kinds": (issues, f"SELECT id, illegible, optional_absence, operational_ AS operational, blocking FROM {ISSUES}"),
    "G-11_page_route": (pages, PAGES_SQL),
    "G-12_G-16_two_readers": (readers, READERS_SQL),
    "G-15_review_route": (routes, ROUTES_SQL),
}
