"""Queries of tables in HTML and plain text, beside their SQL. Pages become tables: their lists and paragraphs are rows and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import grids as g
from archivolt.plans.data import TASKS, read, tasks

# SQL of both engines. The tags of pages that are left open stay so.
SWAPS = (("<ul>", "<table><tr>"), ("</ul>", "</tr></table>"), ("<li>", "<TD class=\"a>b\">"), ("</li>", "</td>"), ("<p>", "<tr><th>"), ("</p>", "</th></tr>"), ("<footer>", "<tr/><td/><tr><td>&#20013;&#x41;&bogus;&lt;"), ("</footer>", "</td>tail</tr>"))
HTML = "html"
for _a, _b in SWAPS:
    HTML = f"replace({HTML}, '{_a}', '{_b}')"
PLAIN = "CASE id % 6 WHEN 0 THEN concat(' a  b   ', lang, chr(10), chr(10), batch_id, chr(9), id) WHEN 1 THEN concat('x', chr(9), chr(9), chr(13), chr(10), 'y  z') WHEN 2 THEN concat('one', chr(10), 'two  three') WHEN 3 THEN concat('| a | b |', chr(10), '|--|:-:|', chr(10), '|', id, '| |') WHEN 4 THEN full_text ELSE concat('<tr><td>', lang, '<td>', batch_id, '</td></tr>') END"


def html(s, d):
    rows = read(s, d, "pages").select("page_id", g.html_rows(F.expr(HTML)).alias("r"))
    return rows.select("page_id", F.size("r").cast("long").alias("n"), F.array_max(F.transform("r", F.size)).cast("long").alias("wide"), F.md5(g.table_text(F.col("r")).cast("binary")).alias("text"))


def any_table(s, d):
    rows = tasks(s, d).select("id", g.table_rows(F.expr(PLAIN)).alias("r"))
    return rows.select("id", F.array_join(F.transform("r", lambda x: F.array_join(x, "¦")), "§").alias("cells"))


def markdown(s, d):
    return tasks(s, d).select("id", g.markdown_html(F.expr(PLAIN)).alias("html"))


_ROWS = "ARRAY[]::VARCHAR[][]"
_COERCED = lambda c: rf"regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')"
_TOKENS = g.TOKENS.replace("'", "''")
_NAMES = ", ".join("'" + k + "': '" + v.replace("'", "''") + "'" for k, v in g.NAMED.items())
_SAID = rf"""CASE WHEN regexp_matches(t, '(?is)^<(?:script|style)\b.*</') THEN regexp_extract(t, '(?is)^<[^>]*>(.*)</[^<]*$', 1) WHEN regexp_matches(t, '^<(?:!--|/?[A-Za-z])') THEN ''
  WHEN starts_with(t, '&#x') THEN chr(('0x' || t[4:-2])::INT) WHEN starts_with(t, '&#') THEN chr(t[3:-2]::INT) WHEN starts_with(t, '&') THEN coalesce(MAP {{{_NAMES}}}[t[2:-2]], t) ELSE t END"""
_FOLD = lambda html: f"""list_reduce(list_prepend({{'name': '', 'single': false, 'text': ''}}, list_transform(regexp_extract_all({html}, '{_TOKENS}'), lambda t: {{'name': lower(regexp_extract(t, '^<(/?[A-Za-z][^\\s/>]*)', 1)), 'single': ends_with(t, '/>'), 'text': {_SAID}}})),
  lambda s, x: CASE WHEN x.name = 'tr' THEN {{'rows': s.rows, 'cells': CASE WHEN x.single THEN NULL ELSE [] END, 'cell': s.cell}} WHEN x.name IN ('td', 'th') THEN {{'rows': s.rows, 'cells': CASE WHEN x.single THEN coalesce(s.cells, []) || [''] ELSE coalesce(s.cells, []) END, 'cell': CASE WHEN NOT x.single THEN '' END}}
    WHEN x.name = 'br' AND s.cell IS NOT NULL THEN {{'rows': s.rows, 'cells': s.cells, 'cell': s.cell || chr(10)}} WHEN x.name IN ('/td', '/th') AND s.cells IS NOT NULL AND s.cell IS NOT NULL THEN {{'rows': s.rows, 'cells': s.cells || [{_COERCED('s.cell')}], 'cell': NULL}}
    WHEN x.name = '/tr' THEN {{'rows': CASE WHEN len(s.cells) > 0 THEN s.rows || [s.cells] ELSE s.rows END, 'cells': NULL, 'cell': s.cell}} WHEN x.text <> '' AND s.cell IS NOT NULL THEN {{'rows': s.rows, 'cells': s.cells, 'cell': s.cell || x.text}} ELSE s END,
  {{'rows': [['']][:0], 'cells': NULL::VARCHAR[], 'cell': NULL::VARCHAR}}).rows"""  # noqa: E731
_TEXT = lambda r: f"array_to_string(list_transform(list_filter({r}, lambda c: len(list_filter(c, lambda v: {_COERCED('v')} <> '')) > 0), lambda c: array_to_string(list_transform(c, lambda v: {_COERCED('v')}), chr(9))), chr(10))"
_LINES = lambda c: rf"list_filter(list_transform(regexp_split_to_array({c}, '\r\n|[\n\r]'), lambda x: {_COERCED('x')}), lambda x: x <> '')"

QUERIES = {
    "C-32_html_tables": (html, f"SELECT page_id, CAST(len(r) AS BIGINT) AS n, CAST(list_max(list_transform(r, lambda c: len(c))) AS BIGINT) AS wide, md5({_TEXT('r')}) AS text FROM (SELECT page_id, CASE WHEN len(r) > 0 THEN r ELSE [['']] END AS r FROM (SELECT page_id, {_FOLD(HTML)} AS r FROM pages))"),
    "C-33_any_tables": (any_table, rf"""WITH t AS (SELECT id, id % 6 AS m, p, {_LINES('p')} AS l FROM (SELECT id, {PLAIN} AS p FROM {TASKS})),
      c AS (SELECT *, CASE WHEN regexp_matches(lower(p), '<table') OR (regexp_matches(lower(p), '<tr') AND regexp_matches(lower(p), '<t[dh]')) THEN {_FOLD('p')}
        WHEN len(list_filter(l, lambda x: regexp_matches(x, '\|.*\|'))) >= 2 AND regexp_replace(list_filter(l, lambda x: regexp_matches(x, '\|.*\|'))[2], '[|:\- ]', '', 'g') = '' THEN list_transform(list_filter(list_filter(l, lambda x: contains(x, '|')), lambda x, i: i <> 2), lambda x: list_transform(string_split(regexp_replace(x, '^\||\|$', '', 'g'), '|'), lambda y: {_COERCED('y')}))
        WHEN len(l) >= 2 THEN list_transform(l, lambda x: CASE WHEN contains(x, chr(9)) THEN list_transform(string_split(x, chr(9)), lambda y: {_COERCED('y')}) ELSE list_filter(regexp_split_to_array(x, '\s\s+'), lambda y: y <> '') END) END AS r FROM t),
      w AS (SELECT *, m IN (3, 5) AS marked, list_max(list_transform(r, lambda x: len(x))) AS wide FROM c)
      SELECT id, CASE WHEN len(list_filter(flatten(r), lambda x: x <> '')) > 0 AND (marked OR list_min(list_transform(r, lambda x: len(x))) >= 2) THEN array_to_string(list_transform(r, lambda x: array_to_string(x, '¦') || CASE WHEN marked THEN '' ELSE repeat('¦', wide - len(x)) END), '§') END AS cells FROM w"""),
    "C-33_markdown_html": (markdown, rf"""SELECT id, CASE WHEN len(h) > 0 THEN '<table>' || array_to_string(h, '') || '</table>' ELSE '' END AS html FROM (SELECT id, list_filter(list_transform(l, lambda x, i: CASE WHEN regexp_matches(x, '^[|\s\-:]+$') THEN NULL ELSE '<tr>' || array_to_string(list_transform(list_filter(list_transform(string_split(x, '|'), lambda y: {_COERCED('y')}), lambda y, k: NOT (y = '' AND k IN (1, len(string_split(x, '|'))))),
      lambda y: CASE WHEN i > coalesce(list_position(d, true), 1000000) THEN '<td>' || y || '</td>' ELSE '<th>' || y || '</th>' END), '') || '</tr>' END), lambda x: x IS NOT NULL) AS h
      FROM (SELECT *, list_transform(l, lambda x: regexp_matches(x, '^[|\s\-:]+$')) AS d FROM (SELECT id, list_filter({_LINES('p')}, lambda x: contains(x, '|')) AS l FROM (SELECT id, {PLAIN} AS p FROM {TASKS}))))"""),
}
