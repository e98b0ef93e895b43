"""Queries of titles, responsible parties and the eight archive fields, beside their SQL. Items are made-up lines placed by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions.fields import ARCHIVE_NUMBERS, CLASSIFICATION
from archivolt.functions.text import DATE, PAGE_NUMBER
from archivolt.operators import archive, scored
from archivolt.plans.data import TASKS, tasks

# SQL of both engines: what the k-th item of a task says, and where.
SAYS = (
    "'关于印发档案管理办法的通知'", "concat('渝人社发〔2015〕', id, ' 号。')", "'重庆市人力资源和社会保障局'", "'关于做好  年度预算工作的'", "'甲方：某某建设集团有限公司 地址'", "'第一条 适用范围'", "concat('日期：2016年', 1 + id % 12, '月5日')", "'- 3 -'",
    "'机密'", "concat('会议纪要 12345678 ', batch_id)", "'市档案局（公章）印发'", "'某县人民政府关于报送材料的请示'", "lang", "'附件目录中心'", "'2017/3/09'", "'　工程 实施方案 ： '", "concat('说明', repeat('长', CAST(30 + id % 60 AS INT)))", "'(一)总则'",
    "'县财政局关于拨付资金的决定 2019年13月40日'", "''",
)
TEXT = "CASE (id * 3 + k * 7) % 20 " + " ".join(f"WHEN {n} THEN {e}" for n, e in enumerate(SAYS)) + " END"
ITEM = (
    "id", "CAST(CASE WHEN k % 4 = 3 THEN 1 + id % 2 ELSE 0 END AS INT) AS page_index", "3 AS page_total", "(id * 7 % 10 + k) * (20 + id % 4 * 20) / 1600.0{d} AS y_ratio", "CAST(id % 3 * 50 AS DOUBLE) AS x1", "CAST((id * 7 % 10 + k) * (20 + id % 4 * 20) AS DOUBLE) AS y1",
    "CAST(id % 3 * 50 + 300 AS DOUBLE) AS x2", "CAST((id * 7 % 10 + k) * (20 + id % 4 * 20) + 10 + k % 3 * 20 AS DOUBLE) AS y2", "CAST(10 + k % 3 * 20 AS DOUBLE) AS height", TEXT + " AS text",
    "CASE k % 5 WHEN 0 THEN 'doc_title' WHEN 1 THEN 'seal' WHEN 2 THEN 'text' ELSE 'line' END AS kind", "CASE WHEN k % 5 < 3 THEN 'region' ELSE 'line' END AS source", "CAST(k AS INT) AS seq",
)
NAME = "CASE id % 3 WHEN 0 THEN concat('WS·2024·D10-0311-', id, '.jpg') WHEN 1 THEN concat('a/KJ-JJ-2017-02-001-', id, '.tif') ELSE concat(batch_id, '.txt') END"
HEAD = "CASE id % 4 WHEN 0 THEN concat('--- 第 1 页 ---', chr(10), '市档案局文件', chr(10), '渝档发[2020] 7 号') WHEN 1 THEN concat('短', chr(10), '关于调整收费的通知。', chr(10), '某某协会', chr(10), '秘密 2021.4.3') WHEN 2 THEN chr(10) ELSE '第2页' END"
FULL = f"concat({HEAD}, chr(10), coalesce(full_text, ''))"
EMPTY = "id % 6 = 5"  # tasks without items


def _items(s, d):
    rows = tasks(s, d).select("id", "batch_id", "lang", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    return rows.selectExpr(*(e.format(d="D") for e in ITEM)).withColumn("text", scored.clean_line(F.col("text"))).filter("text <> ''")


def _texts(s, d):
    return tasks(s, d).selectExpr("id", f"{NAME} AS filename", f"{FULL} AS full_text", "CAST(id % 4 AS INT) AS page_count")


def kept_items(s, d):
    """Each item three times: as it is, a line of the same text with other blanks, and six points lower (half a step)."""
    i = _items(s, d)
    line = i.withColumn("text", F.concat(F.left("text", F.lit(1)), F.lit(" "), F.substring("text", F.lit(2), F.length("text")))).withColumn("source", F.lit("line")).withColumn("seq", F.col("seq") + 100)
    lower = i.withColumn("y1", F.col("y1") + 6.0).withColumn("seq", F.col("seq") + 200)
    kept = scored.distinct_items(i.unionByName(line).unionByName(lower))
    return kept.groupBy("id").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"), F.sum("y1").alias("y"))


def titles(s, d):
    return archive.titles(_items(s, d))


def parties(s, d):
    return archive.responsible(_items(s, d))


def eight(s, d):
    return archive.eight_fields(_items(s, d).filter(f"NOT ({EMPTY})"), _texts(s, d))


_TRIM = r"^[ \t\r\n，。；;:：]+|[ \t\r\n，。；;:：]+$"
_CLEAN = lambda c: rf"regexp_replace(regexp_replace(translate(coalesce({c}, ''), '　' || chr(160), '  '), '\s+', ' ', 'g'), '{_TRIM}', '', 'g')"
_SEARCH = lambda c: f"translate({_CLEAN(c)}, '〔〕（）【】', '[]()[]')"
_NUMBER = lambda c: "translate(regexp_replace(coalesce(" + ", ".join(f"nullif(regexp_extract({_SEARCH(c)}, '{p}', 1), '')" for p in scored.DOC_NUMBERS) + r", ''), '\s+', '', 'g'), '[]()', '〔〕〔〕')"
_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_PART = lambda c, k: f"regexp_extract_all({_SEARCH(c)}, '{DATE}', {k})"
_DATES = lambda c: f"list_transform(list_filter(list_zip({_PART(c, 1)}, {_PART(c, 2)}, {_PART(c, 3)}), lambda x: x[1]::INT BETWEEN 1900 AND 2100 AND x[2]::INT BETWEEN 1 AND 12 AND x[3]::INT BETWEEN 1 AND 31), lambda x: x[1] || '-' || lpad(x[2], 2, '0') || '-' || lpad(x[3], 2, '0'))"
_BARE = lambda c: f"regexp_replace({c}, '^{archive.MARKS}|{archive.MARKS}$', '', 'g')"
_CUT = lambda c: _BARE(f"regexp_replace(regexp_replace({_CLEAN(c)}, '{archive.SEALED}', '', 'g'), '(?:{archive.ACTS}).*$', '')")
_ORG = lambda c: f"coalesce(nullif({_BARE(f'''regexp_extract({_CUT(c)}, '{archive.ANYWHERE}', 1)''')}, ''), {_CUT(c)})"
_I = f"(SELECT * REPLACE ({_CLEAN('text')} AS text) FROM (SELECT {', '.join(e.format(d='::DOUBLE') for e in ITEM)} FROM {TASKS}, (SELECT unnest(range(12)) AS k)) WHERE {_CLEAN('text')} <> '')"
_TITLES = lambda i: f"""  -- runs of title lines
  tl AS (SELECT *, CASE WHEN regexp_matches(text, '{archive.PARTY}') OR regexp_matches(text, '{archive.CLAUSE}') OR regexp_matches({_SEARCH('text')}, '{PAGE_NUMBER}') OR {_NUMBER('text')} <> '' OR (len({_DATES('text')}) > 0 AND length(text) <= 24) OR regexp_full_match(text, '{CLASSIFICATION}') THEN -1
    ELSE (kind IN ('doc_title', 'title', 'paragraph_title', 'content_title', 'abstract_title', 'reference_title'))::INT * 14 + (source = 'region')::INT * 3 + {_ANY('text', archive.TITLE_WORDS)}::INT * 10 + (y_ratio < 0.35)::INT * 4 + CASE WHEN length(text) BETWEEN 6 AND 40 THEN 5 WHEN length(text) <= 80 THEN 2 ELSE -4 END
      - (regexp_matches(text, '({'|'.join(archive.ORGANISATIONS)})$') AND NOT contains(text, '关于'))::INT * 5 - (length(regexp_replace(text, '[^0-9]', '', 'g')) >= 8)::INT * 4 END AS score
    FROM {i} WHERE page_index = 0 AND y_ratio <= 0.55),
  tg AS (SELECT *, sum(apart) OVER (PARTITION BY id ORDER BY y1, x1, seq) AS run FROM (SELECT *, coalesce(y1 - lag(y2) OVER w > greatest(18.0, lag(height) OVER w * 1.8), false)::INT AS apart FROM tl WHERE score > 0 WINDOW w AS (PARTITION BY id ORDER BY y1, x1, seq))),
  tr AS (SELECT id, run, left(regexp_replace(string_agg(text, '' ORDER BY y1, x1, seq), '\\s+', '', 'g'), 120) AS title, sum(score) AS score FROM tg WHERE run < 6 GROUP BY id, run),
  tt AS (SELECT id, arg_min(title, (-(score + {_ANY('title', archive.TITLE_WORDS)}::INT * 6 + (length(title) BETWEEN 8 AND 80)::INT * 4 + regexp_matches(title, '(?:{'|'.join(archive.TITLE_ENDS)})$')::INT * 2), run)) AS title FROM tr GROUP BY id)"""  # noqa: E731
_PARTIES = lambda i: f"""
  pn AS (SELECT *, list_filter(list_transform(list_concat([regexp_extract(text, '{archive.PARTY_NAME}', 1)], regexp_extract_all(text, '{archive.ACTING}', 1), regexp_extract_all(text, '{archive.ENDING}', 1), regexp_extract_all(text, '{archive.ANYWHERE}', 1)), lambda x: {_ORG('x')}), lambda x: length(x) BETWEEN 4 AND 40) AS names FROM {i}),
  pe AS (SELECT * EXCLUDE (names), unnest(names) AS name, generate_subscripts(names, 1) AS nth FROM pn),
  pp AS (SELECT id, arg_min(name, (-((page_index = 0 AND y_ratio < 0.35)::INT * 8 + (page_index = page_total - 1 AND y_ratio > 0.55)::INT * 12 + (kind = 'seal')::INT * 5 + {_ANY('text', archive.SEALS)}::INT * 4 + regexp_matches(text, '{archive.ACTING}')::INT * 6 + regexp_matches(text, '{archive.ENDING}')::INT * 4
    + (length(name) <= 24)::INT * 3 - (length(name) > 32)::INT * 2 - ({_NUMBER('text')} <> '')::INT * 2 - {_ANY('name', archive.NO_PARTY)}::INT * 4), page_index, y1, x1, seq, nth)) AS responsible FROM pe GROUP BY id)"""  # noqa: E731
EIGHT = f"""
WITH t AS (SELECT id, {NAME} AS filename, {FULL} AS full_text, id % 4 AS page_count FROM {TASKS}),
  l AS (SELECT *, list_filter(list_transform(string_split(full_text, chr(10)), lambda x: {_CLEAN('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '{scored.PAGE_HEAD}')) AS ls FROM t),
  lt AS (SELECT id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS k, len(ls) AS n FROM l WHERE {EMPTY}),
  i AS (SELECT id, page_index, page_total, y_ratio, x1, y1, y2, height, text, kind, source, seq FROM {_I} WHERE NOT ({EMPTY}) UNION ALL SELECT id, 0, 1, k::DOUBLE / n, 0.0, k, k + 1, 1.0, text, 'text', 'text', k FROM lt),
  {_TITLES('i')}, {_PARTIES('i')},
  s AS (SELECT *, nullif({_NUMBER('text')}, '') AS number, {_DATES('text')}[1] AS date, nullif(regexp_extract(text, '{CLASSIFICATION}', 0), '') AS level, length(text) AS n FROM i),
  f AS (SELECT id, arg_min(number, (-((page_index = 0)::INT * 8 + (n <= 40)::INT * 2 + (kind = 'doc_title')::INT + CASE WHEN y_ratio < 0.35 THEN 10 WHEN y_ratio < 0.5 THEN 4 ELSE -4 END), page_index, y1, x1, seq)) FILTER (number IS NOT NULL) AS doc_no,
    arg_min(date, (-((page_index = page_total - 1)::INT * 4 + (n <= 24)::INT * 2 + {_ANY('text', scored.ISSUED)}::INT * 4 - {_ANY('text', scored.PERIOD)}::INT * 4 + CASE WHEN y_ratio > 0.6 THEN 10 WHEN page_index = 0 AND y_ratio < 0.35 THEN 4 ELSE 0 END), -page_index, -y1, x1, seq)) FILTER (date IS NOT NULL) AS date,
    arg_min(level, (-((page_index = 0)::INT * 4 + (y_ratio < 0.2 OR y_ratio > 0.75)::INT * 6 + (n <= 12)::INT * 4), page_index, y1, x1, seq)) FILTER (level IS NOT NULL) AS classification FROM s GROUP BY id),
  r AS (SELECT l.id, filename, page_count, ls, coalesce(doc_no, list_filter(list_transform(ls[:12], lambda x: {_NUMBER('x')}), lambda x: x <> '')[1], '') AS doc_no, coalesce(date, flatten(list_transform(ls, lambda x: {_DATES('x')}))[1], '') AS date,
    coalesce(classification, nullif(regexp_extract(left({_SEARCH('full_text')}, 600), '{CLASSIFICATION}', 0), ''), '') AS classification FROM l LEFT JOIN f ON f.id = l.id)
SELECT r.id, coalesce({', '.join(f"nullif(regexp_extract(regexp_replace(regexp_extract(filename, '[^/]*$', 0), '\\.[^.]*$', ''), '{p}', 0), '')" for p in ARCHIVE_NUMBERS)}, '') AS archive_no, doc_no, coalesce(responsible, regexp_extract(doc_no, '{archive.NUMBER_HEAD}', 1)) AS responsible,
  coalesce(title, left(coalesce(list_filter(ls[:10], lambda x: length(x) >= 6 AND NOT regexp_matches({_SEARCH('x')}, '{PAGE_NUMBER}') AND {_NUMBER('x')} = '' AND {_ANY('x', archive.TITLE_WORDS)})[1], list_reduce(list_prepend('', ls[:8]), lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END)), 120)) AS title,
  date, CASE WHEN page_count > 0 THEN page_count::VARCHAR ELSE '' END AS pages, classification, '' AS remarks
FROM r LEFT JOIN tt ON tt.id = r.id LEFT JOIN pp ON pp.id = r.id
"""

QUERIES = {
    "C-21_distinct_items": (kept_items, f"""WITH t AS (SELECT * FROM {_I} UNION ALL SELECT * REPLACE (left(text, 1) || ' ' || substr(text, 2) AS text, 'line' AS source, seq + 100 AS seq) FROM {_I} UNION ALL SELECT * REPLACE (y1 + 6 AS y1, seq + 200 AS seq) FROM {_I}),
      k AS (SELECT *, row_number() OVER (PARTITION BY id, page_index, regexp_replace(text, '\\s+', '', 'g'), round_even(y1 / 12, 0), round_even(x1 / 12, 0) ORDER BY y1, x1, source <> 'region', seq) AS r FROM t) SELECT id, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs, sum(y1) AS y FROM k WHERE r = 1 GROUP BY id"""),
    "C-25_T-08_titles": (titles, f"WITH {_TITLES(_I)} SELECT id, title FROM tt"),
    "C-26_responsible": (parties, f"WITH {_PARTIES(_I)} SELECT id, responsible FROM pp"),
    "C-20_eight_fields": (eight, EIGHT),
}
