"""Queries of reader results of unknown shape, beside their SQL. JSON is made up of task ids, languages and batches; some of it is malformed."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import shapes as x
from archivolt.plans.data import TASKS, tasks

# SQL of both engines: ? is the task's id, ! its language, @ its batch.
DOCUMENTS = (
    '[{"page_num": 2.5, "regions": [{"type": " doc_title ", "bbox": [1, 2, 30, "40"], "content": " ! "}, {"content": "@ x", "bbox": [[1, 2], [30, 4], [5]], "region_lines": [{"text": "@"}, "none", {"text": " x", "confidence": "bad"}]}]}]',
    '[{"regions": [{"content": "!", "bbox": [], "layout_bbox": [?, 1, 2, 3, 4], "region_lines": [{"text": "other"}]}]}, {"page_num": "7", "lines": [{"text": "?", "bbox": [1, 1, 2, 2]}, {"line_num": 9, "text": null}]}]',
    '{"regions": [{"type": "table", "table_data": [["a", "!"], "?", [null, " "]]}, {"type": "", "content": 0}]}',
    '[{"regions": [{"bbox": [1, 2, 3]}]}]',
    '[{}, {"lines": [{"bbox": [?, 2, "x", 4]}]}]',
    '[{"page_num": null}]',
    '[{"regions": ["@"]}]',
    '{"page_num": ? ',
    '[]',
    '[{"regions": [], "lines": []}, 5]',
    '[{"regions": [{"type": "seal", "layout_bbox": [[?, 5]], "content": true}]}]',
    '[{"regions": [{"type": "table", "html": "<tr><td>!</td><td>@</td></tr>"}, {"type": "table", "table_data": {"a": 1}}]}]',
)
PLACES = (
    '{"x": ?, "y": "2", "w": 3, "h": 4.5}', '{"left": 1, "top": 2, "right": ?, "bottom": 9}', '{"left": 1}', "[1, 2, ?, 4]", "[1, 2, 0, 4]", "[5, 6, 7, 6, 7, 8, 5, ?, 1]",
    "[[[10, 20], [110, ?], [110, 60]]]", '[{"x": 5, "y": ?}, {"x": 2, "y": 7}]', '[[["bad"]]]', '"text"', "null", "[]", '[["1", "?"], [3, null]]',
)


def _case(texts, of):
    said = lambda t: "replace(replace(replace('" + t + "', '?', CAST(id AS STRING)), '!', lang), '@', batch_id)"
    return f"CASE {of} % {len(texts)} " + " ".join(f"WHEN {k} THEN {said(t)}" for k, t in enumerate(texts)) + " END"


JSON, PLACE = _case(DOCUMENTS, "id"), _case(PLACES, "id")


def pages(s, d):
    rows = x.normalised_pages(tasks(s, d).select("id", F.expr(JSON).alias("j")), "j")
    region = lambda r: F.concat_ws(":", r["type"], r["content"], F.size(r["region_lines"]).cast("string"), r["bbox_type"])
    said = F.array_join(F.transform("pages", lambda p: F.concat_ws("|", p["page_num"].cast("string"), F.array_join(F.transform(p["regions"], region), "/"), F.array_join(F.transform(p["lines"], lambda y: F.concat_ws(":", y["line_num"].cast("string"), y["text"])), "/"))), "§")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, y: t + y)
    places = total(F.flatten(F.transform("pages", lambda p: F.flatten(F.transform(p["regions"], lambda r: r["layout_bbox"])))))
    return rows.select("id", "error", F.size("pages").cast("long").alias("n"), said.alias("said"), places.alias("places"))


def places(s, d):
    v = F.parse_json(F.expr(PLACE))
    rows = tasks(s, d).select("id", x.location(v).alias("r"), x.points(v).alias("p"))
    at = lambda k: F.get("r", F.lit(k)).alias(f"r{k}")
    return rows.select("id", *(at(k) for k in range(4)), F.size("p").cast("long").alias("n_points"))


_DUCK = lambda e: e.replace("AS STRING", "AS VARCHAR")
_EMPTY = lambda c: f"({c} IS NULL OR CAST({c} AS VARCHAR) IN ('null', '[]', '{{}}', '\"\"', '0', 'false'))"
_BOX = lambda c: f"""CASE WHEN {_EMPTY(c)} THEN [] WHEN json_type({c}) = 'ARRAY' AND json_type({c}->0) = 'ARRAY' THEN flatten(list_transform(list_filter(CAST({c} AS JSON[]), lambda p: json_array_length(p) >= 2), lambda p: [try_cast(p->>0 AS DOUBLE), try_cast(p->>1 AS DOUBLE)]))
  WHEN json_type({c}) = 'ARRAY' AND json_array_length({c}) >= 4 THEN list_transform([0, 1, 2, 3], lambda q: try_cast({c}->>q AS DOUBLE)) END"""  # noqa: E731
_SOUND = lambda b: f"({b} IS NOT NULL AND len(list_filter({b}, lambda q: q IS NULL)) = 0)"
_WHOLE = lambda c, k: f"CASE WHEN {c} IS NULL THEN {k} WHEN json_type({c}) = 'VARCHAR' THEN CASE WHEN regexp_full_match({c}->>'$', '[0-9]+') THEN CAST({c}->>'$' AS INT) END WHEN json_type({c}) <> 'NULL' THEN CAST(trunc(CAST({c} AS DOUBLE)) AS INT) END"
_SAYS = lambda c: f"CASE WHEN {_EMPTY(c)} THEN '' ELSE trim({c}->>'$') END"
_PLAIN = r"regexp_replace({}, '\s+', '', 'g')"
PAGES_SQL = f"""
WITH v AS (SELECT id, CASE WHEN json_valid(j) THEN CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON) ELSE CAST('[' || j || ']' AS JSON) END END AS a FROM (SELECT id, {_DUCK(JSON)} AS j FROM {TASKS})),
p AS (SELECT id, i, a->i AS p FROM (SELECT id, a, unnest(range(CAST(json_array_length(a) AS BIGINT))) AS i FROM v)),
r AS (SELECT id, i, k, r, {_BOX("(r->'$.bbox')")} AS own, {_BOX("(CASE WHEN json_exists(r, '$.layout_bbox') THEN r->'$.layout_bbox' ELSE r->'$.bbox' END)")} AS around, coalesce(nullif({_SAYS("(r->'$.type')")}, ''), 'text') AS kind, {_SAYS("(r->'$.content')")} AS content,
  list_filter(coalesce(CAST(r->'$.region_lines' AS JSON[]), []), lambda y: json_type(y) = 'OBJECT') AS ls, r->'$.table_data' AS td, r->>'$.html' AS html FROM (SELECT id, i, k, p->'$.regions'->k AS r FROM (SELECT id, i, p, unnest(range(CAST(json_array_length(p->'$.regions') AS BIGINT))) AS k FROM p))),
c AS (SELECT *, CASE WHEN kind = 'table' THEN CASE WHEN td IS NULL AND html IS NOT NULL THEN [list_transform(regexp_extract_all(html, '<td>([^<]*)', 1), lambda y: trim(y))] WHEN td IS NULL THEN [['']]
  WHEN json_type(td) = 'ARRAY' THEN list_transform(CAST(td AS JSON[]), lambda y: CASE WHEN json_type(y) = 'ARRAY' THEN list_transform(CAST(y AS JSON[]), lambda z: coalesce(trim(z->>'$'), '')) ELSE [trim(y->>'$')] END) END END AS cells FROM r),
q AS (SELECT *, json_type(r) = 'OBJECT' AND {_SOUND('own')} AND {_SOUND('around')} AND (kind <> 'table' OR cells IS NOT NULL) AS ok, array_to_string(list_transform(ls, lambda y: trim(coalesce(y->>'$.text', ''))), '') AS said,
  CASE WHEN kind = 'table' THEN array_to_string(list_transform(list_filter(cells, lambda y: len(list_filter(y, lambda z: z <> '')) > 0), lambda y: array_to_string(y, chr(9))), chr(10)) ELSE content END AS shown FROM c),
l AS (SELECT id, i, k, {_WHOLE("(y->'$.line_num')", 'k + 1')} AS num, coalesce(trim(y->>'$.text'), '') AS text, json_type(y) = 'OBJECT' AND {_SOUND(_BOX("(y->'$.bbox')"))} AS ok FROM (SELECT id, i, k, p->'$.lines'->k AS y FROM (SELECT id, i, p, unnest(range(CAST(json_array_length(p->'$.lines') AS BIGINT))) AS k FROM p))),
g AS (SELECT id, i, bool_and(ok) AS ok, sum(list_sum(CASE WHEN len(around) > 0 THEN around ELSE own END)) AS places, string_agg(concat_ws(':', kind, shown, CASE WHEN kind <> 'table' AND content <> '' AND {_PLAIN.format('said')} <> '' AND {_PLAIN.format('said')} <> {_PLAIN.format('content')} THEN 0 ELSE len(ls) END, CASE WHEN json_type(r->'$.bbox'->0) = 'ARRAY' THEN 'poly' ELSE 'rect' END), '/' ORDER BY k) AS said FROM q GROUP BY id, i),
m AS (SELECT id, i, bool_and(ok AND num IS NOT NULL) AS ok, string_agg(num || ':' || text, '/' ORDER BY k) AS said FROM l GROUP BY id, i),
e AS (SELECT p.id, p.i, {_WHOLE("(p->'$.page_num')", 'p.i + 1')} AS num, coalesce(g.ok, true) AND coalesce(m.ok, true) AND json_type(p) = 'OBJECT' AS ok, g.places, coalesce(g.said, '') AS gs, coalesce(m.said, '') AS ms FROM p LEFT JOIN g ON g.id = p.id AND g.i = p.i LEFT JOIN m ON m.id = p.id AND m.i = p.i),
f AS (SELECT id, min(i) FILTER (NOT ok OR num IS NULL) AS bad, count(*) AS n, string_agg(num || '|' || gs || '|' || ms, '§' ORDER BY i) AS said, coalesce(sum(places), 0.0) AS places FROM e GROUP BY id)
SELECT v.id, CASE WHEN a IS NULL THEN 'json' WHEN bad IS NOT NULL THEN 'page ' || (bad + 1) END AS error, CASE WHEN a IS NOT NULL AND bad IS NULL THEN coalesce(n, 0) END AS n, CASE WHEN a IS NOT NULL AND bad IS NULL THEN coalesce(said, '') END AS said, CASE WHEN a IS NOT NULL AND bad IS NULL THEN coalesce(places, 0.0) END AS places FROM v LEFT JOIN f ON f.id = v.id
"""
_NUM = lambda c: f"coalesce(try_cast({c}->>'$' AS DOUBLE), 0.0)"
_PAIRS = """CASE json_type(v) WHEN 'ARRAY' THEN CASE WHEN json_type(v->0) IN ('ARRAY', 'OBJECT') THEN CASE WHEN json_type(v->0->0) = 'ARRAY' THEN CASE WHEN json_array_length(v->0->0) >= 2 THEN CAST(v->0 AS JSON[]) ELSE [] END ELSE CAST(v AS JSON[]) END WHEN json_array_length(v) >= 2 THEN [v] ELSE [] END ELSE CASE WHEN json_exists(v, '$.x') AND json_exists(v, '$.y') THEN [v] ELSE [] END END"""
_OF = lambda name: _NUM(f"(y->'$.{name}')")
_XY = f"list_transform(ps, lambda y: CASE WHEN json_type(y) = 'OBJECT' THEN [{_OF('x')}, {_OF('y')}] ELSE [{_NUM('(y->0)')}, {_NUM('(y->1)')}] END)"
PLACES_SQL = f"""
WITH t AS (SELECT id, v, {_PAIRS} AS ps, CASE json_type(v) WHEN 'ARRAY' THEN list_transform(CAST(v AS JSON[]), lambda y: {_NUM('y')}) END AS n FROM (SELECT id, CAST({_DUCK(PLACE)} AS JSON) AS v FROM {TASKS})),
o AS (SELECT *, {_XY} AS xy, CASE WHEN json_exists(v, '$.x') THEN {_NUM("(v->'$.x')")} ELSE {_NUM("(v->'$.left')")} END AS x, CASE WHEN json_exists(v, '$.y') THEN {_NUM("(v->'$.y')")} ELSE {_NUM("(v->'$.top')")} END AS y, {_NUM("(v->'$.w')")} AS w, {_NUM("(v->'$.h')")} AS h, coalesce(try_cast(v->>'$.right' AS DOUBLE), 0.0) AS r, coalesce(try_cast(v->>'$.bottom' AS DOUBLE), 0.0) AS b FROM t),
k AS (SELECT *, CASE WHEN json_type(v) = 'OBJECT' THEN CASE WHEN w > 0 AND h > 0 THEN [x, y, x + w, y + h] WHEN r > x AND b > y THEN [x, y, r, b] END
  WHEN json_type(v) = 'ARRAY' THEN CASE WHEN json_type(v->0) IN ('ARRAY', 'OBJECT') THEN CASE WHEN len(xy) > 0 THEN [list_min(list_transform(xy, lambda q: q[1])), list_min(list_transform(xy, lambda q: q[2])), list_max(list_transform(xy, lambda q: q[1])), list_max(list_transform(xy, lambda q: q[2]))] END
    WHEN len(n) >= 8 THEN [least(n[1], n[3], n[5], n[7]), least(n[2], n[4], n[6], n[8]), greatest(n[1], n[3], n[5], n[7]), greatest(n[2], n[4], n[6], n[8])] WHEN len(n) >= 4 AND n[3] > 0 AND n[4] > 0 THEN [n[1], n[2], n[1] + n[3], n[2] + n[4]] END END AS b4 FROM o)
SELECT id, b4[1] AS r0, b4[2] AS r1, b4[3] AS r2, b4[4] AS r3, len(xy) AS n_points FROM k
"""

QUERIES = {"C-30_pages": (pages, PAGES_SQL), "C-51_places": (places, PLACES_SQL)}
