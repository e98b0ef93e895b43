"""Queries of other readers' results, beside their SQL: JSON and Markdown made up of task ids, languages and batches; whole texts as Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import readers as r
from archivolt.functions import shapes
from archivolt.plans.data import TASKS, tasks
from archivolt.plans.grids import _COERCED, _TEXT
from archivolt.plans.shapes import _DUCK, _case

DOCUMENTS = (
    '{"pages": [{"page_num": ?, "layouts": [{"layout_id": "a", "type": "table", "text": "gone"}, {"layout_id": "b", "type": "Title", "text": " ! ", "position": [1, 2, 3, ?]}, {"layout_id": "c", "type": "image", "text": "x"}], "tables": [{"layout_id": "a", "cells": [{"text": "old"}], "matrix": [[0]]}, {"layout_id": "a", "cells": [{"text": "!"}, {"text": "@"}, {"text": null}], "matrix": [[0, 0], [1, 2]]}], "images": [{"layout_id": "c"}]}]}',
    '{"pages": [{"layouts": [{"layout_id": 7, "type": "table"}, "none"], "tables": [{"layout_id": "7", "cells": [{"text": "s"}, {"text": "s"}, {"text": "s"}], "matrix": [[0, 1, 2], [9, -1, null]]}]}, {"layouts": [{"text": "@", "span_boxes": [{"text": "p", "location": [?, 1, 5, 5]}, {"text": ""}]}]}]}',
    '{"pages": []}', '{"pages": ', '{"pages": [{}, {"layouts": [{"type": "seal", "text": "!"}, {"type": "table", "text": "@"}]}]}',
)
OFFICE = (
    '{"results": [{"words": [{"word": "!", "words_location": {"left": ?, "top": 2, "width": 3, "height": 4}}, {"words": "@", "poly_location": [{"x": 9, "y": 1}, {"x": 12, "y": ?}]}], "line_probability": {"average": 0.5}}]}',
    '{"results": [{"words": " "}, {"words": {"word": "@"}, "location": {"left": 5, "top": 5, "right": ?, "bottom": 8}, "probability": 0.25}]}', '{"results": [{"words": " ! "}, {"word": "w?"}]}', "[]",
)
JSON, RESULT = _case(DOCUMENTS, "id"), _case(OFFICE, "id")
MARKDOWN = "concat('# ', batch_id, chr(10), '- **', lang, '**', chr(13), chr(10), ' ', chr(10), CASE WHEN id % 3 > 0 THEN concat('| a | ', lang, ' |', chr(10), '|---|:-:|', chr(10), '| ', CAST(id AS STRING), ' | |', chr(10), chr(10)) ELSE '' END, coalesce(full_text, ''))"


def documents(s, d):
    rows = r.foreign_documents(tasks(s, d).select("id", F.expr(JSON).alias("j")), "j")
    cells = lambda t: F.array_join(F.transform(t, lambda x: F.array_join(x, ",")), ";")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    region = lambda x: F.concat_ws(":", x["type"], x["content"], F.coalesce(cells(x["table_data"]), F.lit("-")), F.array_join(F.transform(x["region_lines"], lambda y: y["text"]), "+"))
    regions = F.flatten(F.transform("pages", lambda p: p["regions"]))
    places = F.aggregate(regions, F.lit(0.0), lambda a, x: a + total(x["bbox"]) + F.aggregate(x["region_lines"], F.lit(0.0), lambda b, y: b + total(y["bbox"])))
    return rows.select("id", F.col("page_count").cast("long").alias("page_count"), F.array_join(F.transform("pages", lambda p: p["page_num"].cast("string")), ",").alias("numbers"), "full_text", F.array_join(F.transform(regions, region), "/").alias("regions"), places.alias("places"))


def lines(s, d):
    rows = tasks(s, d).select("id", F.try_parse_json(F.expr(RESULT)).alias("v")).select("id", F.explode(r.office_lines(shapes.entries(F.col("v")))).alias("l"))
    at = lambda k: F.get("l.bbox", F.lit(k)).alias(f"b{k}")
    return rows.select("id", "l.line_num", "l.text", "l.confidence", *map(at, range(4)))


def pages(s, d):
    rows = tasks(s, d).select("id", r.markdown_page(F.expr(MARKDOWN)).alias("p"))
    said = F.array_join(F.transform("p.regions", lambda x: F.concat_ws(":", x["type"], x["content"], x["html"])), "§")
    return rows.select("id", F.size("p.regions").cast("long").alias("regions"), F.size("p.lines").cast("long").alias("lines"), F.md5(said.cast("binary")).alias("said"), F.md5(F.array_join("p.lines", "\n").cast("binary")).alias("texts"))


_KIND = "coalesce(nullif(l->>'$.type', ''), 'text')"
_TABLE = "list_filter(coalesce(CAST(p->'$.tables' AS JSON[]), []), lambda t: (t->>'$.layout_id') = (l->>'$.layout_id'))[-1]"
_CLEAN = r"regexp_replace(regexp_replace({}, '!\[[^\]]*\]\([^)]+\)', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g')"
_PLAIN = lambda c: rf"trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({_CLEAN.format(c)}, '^\s{{0,3}}#{{1,6}}\s*', ''), '^\s*[-*+]\s+', ''), '^\s*\d+[.)]\s+', ''), '**', ''), '__', ''), '`', ''), '\s+', ' ', 'g'))"
DOCUMENTS_SQL = f"""
WITH t AS (SELECT id, CASE WHEN json_valid(j) THEN CAST(j AS JSON) END AS j FROM (SELECT id, {_DUCK(JSON)} AS j FROM {TASKS})),
p AS (SELECT id, i, j->'$.pages'->i AS p FROM (SELECT id, j, unnest(range(CAST(json_array_length(j->'$.pages') AS BIGINT))) AS i FROM t)),
l AS (SELECT id, i, k, p, p->'$.layouts'->k AS l FROM (SELECT id, i, p, unnest(range(CAST(json_array_length(p->'$.layouts') AS BIGINT))) AS k FROM p)),
r AS (SELECT id, i, k, {_KIND} AS kind, CASE lower({_KIND}) WHEN 'title' THEN 'paragraph_title' WHEN 'table' THEN 'table' WHEN 'image' THEN 'image' WHEN 'seal' THEN 'seal' ELSE 'text' END AS type, {_TABLE} AS tb, trim(coalesce(l->>'$.text', '')) AS text, CASE WHEN json_array_length(l->'$.position') = 4 AND CAST(l->'$.position'->>3 AS DOUBLE) > 0 THEN CAST(l->'$.position' AS DOUBLE[]) END AS pos,
  list_filter(coalesce(CAST(l->'$.span_boxes' AS JSON[]), []), lambda s: trim(s->>'$.text') <> '') AS spans FROM l WHERE json_type(l) = 'OBJECT'),
c AS (SELECT *, CASE WHEN kind = 'table' AND tb IS NOT NULL THEN list_transform(CAST(tb->'$.matrix' AS JSON[]), lambda m, y: list_transform(CAST(m AS JSON[]), lambda n, x: CASE WHEN try_cast(n->>'$' AS INT) BETWEEN 0 AND json_array_length(tb->'$.cells') - 1 AND x = list_position(list_transform(CAST(m AS JSON[]), lambda q: q->>'$'), n->>'$') THEN coalesce(tb->'$.cells'->(try_cast(n->>'$' AS INT))->>'$.text', '') ELSE '' END)) END AS raw FROM r),
d AS (SELECT *, list_transform(list_filter(raw, lambda y: len(list_filter(y, lambda z: z <> '')) > 0), lambda y: CASE WHEN len(list_filter(y, lambda z: z <> '')) >= 3 AND len(list_distinct(list_filter(y, lambda z: z <> ''))) = 1 THEN list_transform(y, lambda z, q: CASE WHEN q = 1 THEN y[1] ELSE '' END) ELSE y END) AS cells, CASE WHEN (kind = 'table' AND tb IS NOT NULL) OR kind = 'image' THEN '' ELSE text END AS content FROM c),
e AS (SELECT id, i, string_agg(concat_ws(':', type, content, CASE WHEN raw IS NULL THEN '-' ELSE array_to_string(list_transform(cells, lambda y: array_to_string(y, ',')), ';') END, array_to_string(list_transform(spans, lambda s: s->>'$.text'), '+')), '/' ORDER BY k) AS said, string_agg(CASE WHEN type = 'table' THEN '[表格]' ELSE nullif(content, '') END, chr(10) ORDER BY k) AS text,
  sum(coalesce(2 * pos[1] + 2 * pos[2] + pos[3] + pos[4], 0.0) + coalesce(list_sum(list_transform(spans, lambda s: 2 * CAST(s->'$.location'->>0 AS DOUBLE) + 2 * CAST(s->'$.location'->>1 AS DOUBLE) + CAST(s->'$.location'->>2 AS DOUBLE) + CAST(s->'$.location'->>3 AS DOUBLE))), 0.0)) AS places FROM d GROUP BY id, i),
g AS (SELECT p.id, count(*) AS n, string_agg(coalesce(CAST(p->>'$.page_num' AS INT), 0) + 1, ',' ORDER BY p.i) AS numbers, string_agg('--- 第 ' || (p.i + 1) || ' 页 ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY p.i) AS many, string_agg(coalesce(text, ''), '' ORDER BY p.i) AS one, string_agg(said, '/' ORDER BY p.i) AS said, sum(coalesce(places, 0.0)) AS places FROM p LEFT JOIN e ON e.id = p.id AND e.i = p.i GROUP BY p.id)
SELECT t.id, coalesce(n, 1) AS page_count, coalesce(numbers, '1') AS numbers, CASE WHEN n > 1 THEN many ELSE coalesce(one, '') END AS full_text, coalesce(said, '') AS regions, coalesce(places, 0.0) AS places FROM t LEFT JOIN g ON g.id = t.id
"""
PAGES_SQL = rf"""
WITH b AS (SELECT id, list_filter(regexp_split_to_array(regexp_replace(m, '\r\n?', chr(10), 'g'), '\n(?:[ \t\x0B\f\r]*\n)+'), lambda x: {_COERCED('x')} <> '') AS bs FROM (SELECT id, {_DUCK(MARKDOWN)} AS m FROM {TASKS})),
u AS (SELECT id, unnest(bs) AS x, generate_subscripts(bs, 1) AS k FROM b), v AS (SELECT *, contains(x, '|---|') AS is_table, list_filter(list_transform(string_split(x, chr(10)), lambda y: {_PLAIN('y')}), lambda y: y <> '') AS ls,
  list_transform(list_filter(string_split(x, chr(10)), lambda y: contains(y, '|') AND NOT contains(y, '---')), lambda y: list_transform(string_split(trim(y), '|')[2:-2], lambda z: trim(z))) AS cells FROM u),
w AS (SELECT *, CASE WHEN is_table THEN {_TEXT('cells')} ELSE array_to_string(ls, chr(10)) END AS content FROM v WHERE is_table OR len(ls) > 0),
z AS (SELECT *, CASE WHEN is_table THEN list_filter(list_transform(string_split(content, chr(10)), lambda y: {_PLAIN('y')}), lambda y: y <> '') ELSE ls END AS out, CASE WHEN is_table THEN '<table>' || array_to_string(list_transform(cells, lambda c, i: '<tr>' || array_to_string(list_transform(c, lambda y: CASE WHEN i = 1 THEN '<th>' || y || '</th>' ELSE '<td>' || y || '</td>' END), '') || '</tr>'), '') || '</table>' END AS html FROM w)
SELECT id, count(*) AS regions, CAST(sum(len(out)) AS BIGINT) AS lines, md5(string_agg(concat_ws(':', CASE WHEN is_table THEN 'table' ELSE 'text' END, content, html), '§' ORDER BY k)) AS said, md5(string_agg(nullif(array_to_string(out, chr(10)), ''), chr(10) ORDER BY k)) AS texts FROM z GROUP BY id
"""
LINES_SQL = f"""
SELECT id, CAST(CASE WHEN id % 4 = 1 THEN 2 ELSE k END AS INT) AS line_num, CASE WHEN id % 4 = 0 THEN lang || batch_id WHEN id % 4 = 1 THEN batch_id WHEN k = 1 THEN lang ELSE 'w' || id END AS text, CASE id % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN id % 4 = 0 THEN least(9.0::DOUBLE, id) WHEN id % 4 = 1 AND id > 5 THEN 5.0::DOUBLE END AS b0, CASE WHEN id % 4 = 0 THEN least(1.0::DOUBLE, id, 2) WHEN id % 4 = 1 AND id > 5 THEN 5.0::DOUBLE END AS b1, CASE WHEN id % 4 = 0 THEN greatest(12.0::DOUBLE, id + 3) WHEN id % 4 = 1 AND id > 5 THEN CAST(id AS DOUBLE) END AS b2, CASE WHEN id % 4 = 0 THEN greatest(6.0::DOUBLE, id) WHEN id % 4 = 1 AND id > 5 THEN 8.0::DOUBLE END AS b3
FROM {TASKS}, (SELECT unnest([1, 2]) AS k) WHERE CASE id % 4 WHEN 2 THEN true WHEN 3 THEN false ELSE k = 1 END
"""

QUERIES = {"S-16_foreign_documents": (documents, DOCUMENTS_SQL), "S-15_markdown_pages": (pages, PAGES_SQL), "S-17_office_lines": (lines, LINES_SQL)}
