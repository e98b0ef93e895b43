"""Queries of regions that say the same twice, of seals and of table scores, beside their SQL. Each task is a page of ten made-up regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import seals as x
from archivolt.functions.blocks import ratio_sql
from archivolt.operators import layout_regions as r
from archivolt.plans import grids
from archivolt.plans.data import TASKS, tasks

# SQL of both engines.
REGION = (
    "CASE (id + k) % 5 WHEN 2 THEN 'text' WHEN 3 THEN 'number' WHEN 4 THEN CASE WHEN k > 5 THEN 'paragraph' ELSE 'figure' END ELSE 'table' END AS type", "CAST(k % 3 * (id % 4) * 10 AS DOUBLE) AS x1", "CAST(k % 2 * 3 AS DOUBLE) AS y1", "CAST(k % 3 * (id % 4) * 10 + 100 AS DOUBLE) AS x2", "CAST(k % 2 * 3 + 50 + k AS DOUBLE) AS y2",
    "CASE WHEN k = 7 THEN ' ' ELSE concat(lang, ' ', batch_id, CASE WHEN k % 4 = 1 THEN ' total' ELSE '' END) END AS content", "CASE WHEN (id + k * 3) % 7 = 0 THEN concat('<TR><td>', lang, ' ', batch_id, ' total ', k, '</td><td>x</td></TR>') WHEN (id + k) % 7 = 5 THEN 'no <b>table' END AS html",
)
CELLS = (("lang", "concat(batch_id, ' total amount of the year')", "concat('', k)"), ("'annual sum'", "''", "concat(id, '')"))
HAS_CELLS = "(id * 5 + k) % 4"  # 0: none, 1: blank ones, else as above
SEAL = ("CASE (id + k * 2) % 8 WHEN 0 THEN concat(batch_id, '有限公司', chr(10), '合同专用章') WHEN 1 THEN concat('1234567', id) WHEN 2 THEN '' WHEN 3 THEN concat(' 某某委员会 ', chr(10), ' ') WHEN 4 THEN repeat('长', CAST(20 + id % 25 AS INT)) WHEN 5 THEN concat('印，', lang, '。', repeat('文', 46)) WHEN 6 THEN concat('a', chr(10), 'b', chr(13), chr(10), 'c', chr(10), 'd', CASE WHEN id % 2 = 0 THEN concat(chr(10), 'e') ELSE '' END) ELSE concat(lang, '!') END")
SEALS = ("k >= 3 AS detected", SEAL + " AS content", "CAST(k % 3 * 40 + id % 3 * 15 * CAST(k / 3 AS INT) AS DOUBLE) AS x1", "0.0{d} AS y1", "CAST(k % 3 * 40 + id % 3 * 15 * CAST(k / 3 AS INT) + 50 AS DOUBLE) AS x2", "30.0{d} AS y2")


def _regions(s, d):
    rows = tasks(s, d).select("id", "batch_id", "lang", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    full = F.array(*(F.array(*map(F.expr, row)) for row in CELLS))
    cells = F.expr(f"CASE {HAS_CELLS} WHEN 1 THEN array(array(' ', '')) END")
    cells = F.when(F.expr(HAS_CELLS) > 1, full).otherwise(cells)
    return rows.select(F.col("id").alias("page_id"), F.col("k").alias("region_id"), *map(F.expr, REGION), cells.alias("cells"))


def _told(s, d):
    return _regions(s, d).withColumn("told", x.table_told(*map(F.col, ("cells", "html", "content"))))


def tables(s, d):
    return _told(s, d).select("page_id", "region_id", "told.said", F.round("told.score", 6).alias("score"))


def kept(s, d):
    return r.kept_regions(_told(s, d).select("*", "told.said", "told.score"))


def _seals(s, d):
    rows = tasks(s, d).select("id", "batch_id", "lang", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
    return rows.select(F.col("id").alias("page_id"), F.col("k").alias("region_id"), *(F.expr(e.format(d="D")) for e in SEALS))


def seal_scores(s, d):
    return _seals(s, d).select("page_id", "region_id", x.seal_text(F.col("content")).alias("text"), F.round(x.seal_score(F.col("content")), 6).alias("score"))


def seals(s, d):
    return r.merged_seals(_seals(s, d))


_BARE = lambda c: rf"regexp_replace(coalesce({c}, ''), '\s+', '', 'g')"
_SOME = lambda c: rf"len(list_filter(flatten({c}), lambda v: trim(v) <> '')) > 0"
_LIST = "[" + ", ".join("[" + ", ".join(row) + "]" for row in CELLS) + "]"
_R = f"""t0 AS (SELECT id AS page_id, k AS region_id, {', '.join(REGION)}, CASE {HAS_CELLS} WHEN 0 THEN NULL WHEN 1 THEN [[' ', '']] ELSE {_LIST} END AS cells FROM {TASKS}, (SELECT unnest(range(10)) AS k)),
  t1 AS (SELECT *, regexp_matches(lower(coalesce(html, '')), '<table') OR (regexp_matches(lower(coalesce(html, '')), '<tr') AND regexp_matches(lower(coalesce(html, '')), '<t[dh]')) AS marked FROM t0),
  t2 AS (SELECT *, CASE WHEN {_SOME('cells')} THEN cells WHEN marked AND {_SOME(grids._FOLD('html'))} THEN {grids._FOLD('html')} END AS found FROM t1),
  t3 AS (SELECT *, CASE WHEN found IS NOT NULL THEN {_BARE(grids._TEXT('found'))} ELSE {_BARE('content')} END AS said FROM t2),
  t AS (SELECT *, CASE WHEN found IS NOT NULL THEN least(len(list_filter(flatten(found), lambda v: trim(v) <> '')), 60) * 0.12::DOUBLE + least(len(found), 20) * 0.08::DOUBLE + least(list_max(list_transform(found, lambda c: len(c))), 12) * 0.14::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN marked THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END + least(length(said), 180) / 90.0::DOUBLE AS score FROM t3)"""
_AREA = lambda a: f"(greatest(0.0, {a}.x2 - {a}.x1) * greatest(0.0, {a}.y2 - {a}.y1))"
_SHARED = f"greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least({_AREA('a')}, {_AREA('b')})"
KEPT = f"""
WITH RECURSIVE {_R},
o AS (SELECT a.page_id, a.region_id * 100 + b.region_id AS ab, a.page_id * 10000 + a.region_id * 100 + b.region_id AS p, a.type, {_SHARED} AS o, a.said AS sa, b.said AS sb, {_BARE('a.content')} AS bare FROM t a JOIN t b ON a.page_id = b.page_id AND a.region_id > b.region_id AND b.type = 'table'),
q AS (SELECT p, sa AS a, sb AS b FROM o WHERE type = 'table' AND o >= 0.58 AND o < 0.92 AND sa <> '' AND sb <> '' AND NOT contains(sa, sb) AND NOT contains(sb, sa)), {ratio_sql('q')},
l AS (SELECT o.*, CASE WHEN sa = '' OR sb = '' THEN 0.0 WHEN sa = sb THEN 1.0 WHEN contains(sa, sb) OR contains(sb, sa) THEN 0.92 ELSE ratio END AS like_ FROM o LEFT JOIN ratios ON ratios.p = o.p),
m AS (SELECT page_id, list(ab) FILTER (CASE WHEN type = 'table' THEN o >= 0.92 OR (o >= 0.72 AND (sa = '' OR sb = '' OR like_ >= 0.88)) OR (o >= 0.58 AND sa <> '' AND sb <> '' AND like_ >= 0.96) ELSE type IN ('text', 'paragraph', 'number') AND bare <> '' AND o >= 0.88 AND (sb = '' OR contains(sb, bare) OR contains(bare, sb)) END) AS hits FROM l GROUP BY page_id),
g AS (SELECT t.page_id, coalesce(any_value(hits), []) AS hits, list({{'k': region_id, 'type': type, 'score': score}} ORDER BY region_id) AS rs FROM t LEFT JOIN m ON m.page_id = t.page_id GROUP BY t.page_id),
f AS (SELECT page_id, list_reduce(list_prepend({{'k': -1, 'type': '', 'score': 0.0::DOUBLE}}, rs), lambda s, x: CASE WHEN x.k < 0 THEN s
    WHEN x.type <> 'table' THEN CASE WHEN len(list_filter(s.tables, lambda y: list_contains(hits, x.k * 100 + y.k))) > 0 THEN s ELSE {{'kept': s.kept || [x.k], 'tables': s.tables}} END
    WHEN len(list_filter(s.tables, lambda y: list_contains(hits, x.k * 100 + y.k))) = 0 THEN {{'kept': s.kept || [x.k], 'tables': s.tables || [{{'k': x.k, 'score': x.score, 'slot': len(s.kept) + 1}}]}}
    WHEN x.score > list_filter(s.tables, lambda y: list_contains(hits, x.k * 100 + y.k))[1].score THEN {{'kept': list_transform(s.kept, lambda v, i: CASE WHEN i = list_filter(s.tables, lambda y: list_contains(hits, x.k * 100 + y.k))[1].slot THEN x.k ELSE v END),
      'tables': list_transform(s.tables, lambda z: CASE WHEN z.slot = list_filter(s.tables, lambda y: list_contains(hits, x.k * 100 + y.k))[1].slot THEN {{'k': x.k, 'score': x.score, 'slot': z.slot}} ELSE z END)}} ELSE s END,
  {{'kept': [0::BIGINT][:0], 'tables': [{{'k': 0::BIGINT, 'score': 0.0::DOUBLE, 'slot': 0::BIGINT}}][:0]}}).kept AS kept FROM g)
SELECT page_id, CAST(unnest(kept) AS INT) AS region_id, CAST(generate_subscripts(kept, 1) - 1 AS INT) AS place FROM f
"""
_TEXT_LINES = grids._LINES
_JOINED = lambda c: f"list_transform([{_TEXT_LINES(c)}], lambda ls: CASE WHEN len(ls) > 4 OR (length(array_to_string(ls, chr(10))) > 48 AND regexp_matches(array_to_string(ls, chr(10)), '{x.SENTENCE}')) THEN '' ELSE array_to_string(ls, chr(10)) END)[1]"
_SCORE = lambda c: f"""list_transform([{c}], lambda w: CASE WHEN w = '' THEN -1.0::DOUBLE ELSE least(length({_BARE('w')}), 24) / 12.0::DOUBLE + CASE WHEN len(string_split(w, chr(10))) <= 3 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN regexp_matches(w, '{x.SEAL_WORDS}') THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches({_BARE('w')}, '{x.SEAL_DIGITS}') THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END
  - CASE WHEN len(list_filter(string_split(w, chr(10)), lambda v: length({_BARE('v')}) > 18)) > 0 THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN length({_BARE('w')}) > 36 THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN regexp_matches(w, '{x.AGAINST}') THEN 0.65::DOUBLE ELSE 0.0::DOUBLE END END)[1]"""  # noqa: E731
_S = f"s AS (SELECT id AS page_id, k AS region_id, {', '.join(e.format(d='') for e in SEALS)} FROM {TASKS}, (SELECT unnest(range(7)) AS k))".replace("k / 3", "k // 3")
MERGED = f"""
WITH {_S}, o AS (SELECT a.page_id, list(a.region_id * 100 + b.region_id) AS hits FROM s a JOIN s b ON a.page_id = b.page_id AND a.region_id > b.region_id AND a.detected WHERE {_SHARED} >= 0.55 GROUP BY a.page_id),
f AS (SELECT s.page_id, list_reduce(list_prepend(-1::BIGINT, list(region_id ORDER BY region_id)), lambda q, v: CASE WHEN v < 0 THEN q WHEN len(list_filter(q.there, lambda y: list_contains(coalesce(any_value(hits), []), v * 100 + y))) > 0 THEN {{'there': q.there, 'target': q.target || [list_filter(q.there, lambda y: list_contains(coalesce(any_value(hits), []), v * 100 + y))[1]]}}
  ELSE {{'there': q.there || [v], 'target': q.target || [v]}} END, {{'there': [0::BIGINT][:0], 'target': [0::BIGINT][:0]}}).target AS target FROM s LEFT JOIN o ON o.page_id = s.page_id GROUP BY s.page_id),
m AS (SELECT f.page_id, target[region_id + 1] AS region_id, list(content ORDER BY region_id) AS cs FROM f JOIN s ON s.page_id = f.page_id GROUP BY ALL)
SELECT page_id, CAST(region_id AS INT) AS region_id, list_reduce(cs, lambda own, c: list_transform([{{'a': {_JOINED('own')}, 'b': {_JOINED('c')}}}], lambda z: coalesce(nullif(CASE WHEN z.a = '' THEN z.b WHEN z.b <> '' AND {_SCORE('z.b')} > {_SCORE('z.a')} + 0.2::DOUBLE THEN z.b ELSE z.a END, ''), own))[1]) AS content FROM m
"""

QUERIES = {
    "C-53_table_scores": (tables, f"WITH {_R} SELECT page_id, CAST(region_id AS INT) AS region_id, said, round(score, 6) AS score FROM t"),
    "J-13c_kept_regions": (kept, KEPT),
    "C-52_seal_scores": (seal_scores, f"WITH {_S} SELECT page_id, CAST(region_id AS INT) AS region_id, {_JOINED('content')} AS text, round({_SCORE(_JOINED('content'))}, 6) AS score FROM s"),
    "J-13d_merged_seals": (seals, MERGED),
}
