"""Queries of document boundaries and of task events. Pages begin with made-up heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import text as x
from archivolt.functions.blocks import ratio_sql
from archivolt.functions.text import document_family, title_hint
from archivolt.operators import boundary
from archivolt.operators.graph import _written as written
from archivolt.plans.data import PAGES, numbered, read, tasks
from archivolt.streaming import tasks as events

EVENT = "CASE event_type WHEN 'purchase' THEN 'completion' WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'pause' ELSE 'progress' END"


# SQL of both engines: what a page begins and ends with.
HEAD = "CASE id % 9 WHEN 0 THEN concat('采购合同', chr(10), '甲方：某某建设有限公司') WHEN 1 THEN concat('第二条 付款方式', chr(10), '甲方：某某建设有限公司，乙方') WHEN 2 THEN '附件 <b>报价表</b>' WHEN 3 THEN '会议纪要 关于工程' WHEN 4 THEN concat('会议强调 出席 请假', chr(10), '会议要求') WHEN 5 THEN '' WHEN 6 THEN '预算书 项目名称：城市档案馆改造工程' WHEN 7 THEN '预算书 续' ELSE lang END"
PAGE = f"concat({HEAD}, chr(10), coalesce(full_text, ''), CASE WHEN id % 9 = 1 THEN concat(chr(10), '签字盖章后生效') ELSE '' END)"
EXTRA = ("CASE WHEN id % 4 > 0 THEN concat('2024', id % 2) END AS date_norm", "CASE WHEN id % 5 = 0 THEN 'r' ELSE '' END AS responsible_norm", "CASE WHEN id % 6 < 2 THEN concat('n', CAST(floor(id / 12) AS INT)) ELSE '' END AS doc_no_norm", "CASE WHEN id % 6 < 4 THEN 'n' ELSE '' END AS doc_no_prefix", "CASE WHEN id % 7 > 1 THEN id % 7 / 6.0{d} END AS visual")


def _prepared(s, d):
    """The pages of a batch are one sequence; families are told by titles and texts. Texts are read before pages are numbered, in all tasks, and don't meet by batch."""
    p = tasks(s, d).selectExpr("batch_id", "batch_id AS prefix", "id", f"{PAGE} AS full_text", *(e.format(d="D") for e in EXTRA))
    p = p.withColumn("title_hint", title_hint(F.col("full_text")))
    p = boundary.prepared(p.withColumn("family", document_family(F.col("title_hint"), F.col("full_text"))))
    return numbered(p.withColumn("signature", F.left("signature", F.lit(boundary.COMPARED))).drop("full_text"))


def scores(s, d):
    """Scores to two digits: the last ones depend on the order of sums where they are halves."""
    return boundary.scored(_prepared(s, d)).withColumn("score", F.floor(F.col("score") * 100 + 0.26).cast("int"))


def document_groups(s, d):
    p = written(_prepared(s, d))  # read by scores and by segments
    decisions = written(boundary.decided(boundary.scored(p)))
    return boundary.groups(boundary.segmented(p, decisions), decisions)


def _events(s, d):
    e = read(s, d, "events")
    twice = e.unionByName(e.filter("event_id % 5 = 0"))
    return twice.selectExpr("user_id AS task_id", "event_id", "ts", f"{EVENT} AS kind", "value AS percent")


def deduplicated(s, d):
    return events.once(_events(s, d)).select("event_id", "task_id", "kind")


def states(s, d):
    return events.task_states(events.once(_events(s, d)))


_TRIM = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_NORM = lambda c: f"lower(regexp_replace({_TRIM(c)}, '{x.SEPARATORS}', '', 'g'))"
_FLAT = lambda c: rf"regexp_replace({c}, '\s+', ' ', 'g')"
_ANY = lambda c, words, test="contains": "(" + " OR ".join(f"{test}({c}, '{w}')" for w in words) + ")"
_FAMILY = lambda c: "CASE " + " ".join(f"WHEN {' + '.join(f'contains({c}, {k!r})::INT' for k in ks)} >= {n} THEN {f!r}" for f, ks, n in x.FAMILIES) + " ELSE '' END"
_NAMES = lambda p: f"list_transform(regexp_extract_all(regexp_replace({_TRIM('whole')}, '<[^>]+>', ' ', 'g'), '{p}', 1), lambda z: left(lower(regexp_replace(z, '{x.SEPARATORS}', '', 'g')), 48))"
_GRAM = lambda n: f"list_distinct(list_transform(range(1, len(cs) - {n - 2}), lambda z: {' || '.join(f'cs[z + {k}]' if k else 'cs[z]' for k in range(n))}))"
_JACCARD = lambda a, b: f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN round(len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))), 4) ELSE 0.0::DOUBLE END"
_TEST = lambda c: f"CASE WHEN coalesce(l_{c}, '') <> '' AND coalesce({c}, '') <> '' THEN (l_{c} = {c})::INT END"
_KEPT = ("id", "page_no", "grams", "ents", "attachment", "continuation", "closed", "title_norm", "family", "doc_no_norm", "doc_no_prefix", "responsible_norm", "date_norm")
SCORES_SQL = f"""
WITH RECURSIVE a AS (SELECT batch_id, page_no, id, {PAGE} AS ft, {', '.join(e.format(d='::DOUBLE') for e in EXTRA)} FROM {PAGES}),
b AS (SELECT *, regexp_replace({_TRIM('ft')}, '<[^>]+>', ' ', 'g') AS plain, left(coalesce(list_filter(list_transform(regexp_split_to_array(regexp_replace({_TRIM('ft')}, '<[^>]+>', ' ', 'g'), '[\\r\\n]+'), lambda z: trim({_FLAT('z')})), lambda z: z <> '')[1], ''), 80) AS title FROM a),
c AS (SELECT *, title || ' ' || plain AS whole, coalesce(nullif({_FAMILY(_TRIM('title'))}, ''), {_FAMILY(f"left({_TRIM('ft')}, 2000)")}) AS family, {_NORM('title')} AS title_norm FROM b),
d AS (SELECT *, {_ANY(f"trim(left({_FLAT('whole')}, 40))", boundary.ATTACHES, 'starts_with')} AS attachment, trim(left({_FLAT("CASE WHEN plain <> '' THEN " + _TRIM('plain') + " ELSE title END")}, 80)) AS head, {_ANY(f"trim(right({_FLAT(_TRIM('plain'))}, 240))", boundary.CLOSES)} AS closed,
  list_sort(list_distinct(list_filter(list_concat({_NAMES(boundary.ENTITIES[0])}, {_NAMES(boundary.ENTITIES[1])}), lambda z: length(z) >= 4))) AS ents, string_split(lower(regexp_replace(left({_NORM('plain')}, 3000), '[^\\p{{L}}\\p{{N}}]', '', 'g')), '') AS cs FROM c),
e AS (SELECT *, regexp_matches(head, '{boundary.CONTINUES}') OR {_ANY('head', boundary.CONTINUES_WORDS)} AS continuation, CASE WHEN len(cs) <= 2 THEN [array_to_string(cs, '')] WHEN len(cs) < 24 THEN {_GRAM(2)} ELSE {_GRAM(3)} END AS grams FROM d),
f AS (SELECT batch_id, visual, {', '.join(_KEPT)}, {', '.join(f'lag({c}) OVER w AS l_{c}' for c in _KEPT)} FROM e WINDOW w AS (PARTITION BY batch_id ORDER BY page_no, id)),
pr AS (SELECT DISTINCT l_title_norm || '|' || title_norm AS p, l_title_norm AS a, title_norm AS b FROM f WHERE l_title_norm <> '' AND title_norm <> ''), {ratio_sql('pr')},
g AS (SELECT *, greatest(1, page_no - l_page_no) AS gap, coalesce(visual, 0.5::DOUBLE) AS v, {_JACCARD('l_grams', 'grams')} AS t, coalesce(round(ratio, 4), 0.0::DOUBLE) AS h, {_JACCARD('l_ents', 'ents')} AS e,
  list_filter([coalesce({_TEST('doc_no_norm')}, {_TEST('doc_no_prefix')}), {_TEST('responsible_norm')}, {_TEST('date_norm')}], lambda z: z IS NOT NULL) AS tests, family <> '' AND family = l_family AS same FROM f LEFT JOIN ratios ON ratios.p = l_title_norm || '|' || title_norm WHERE l_id IS NOT NULL),
h AS (SELECT *, CASE WHEN len(tests) > 0 THEN round(list_sum(tests) / len(tests), 4) ELSE 0.0::DOUBLE END AS f, same AND family IN ('budget', 'contract', 'drawing', 'minutes') AS cont, gap = 1 AS near, attachment AND l_closed AS ends FROM g),
s AS (SELECT *, v * 0.30::DOUBLE + t * 0.18::DOUBLE + h * 0.12::DOUBLE + e * 0.16::DOUBLE + f * 0.12::DOUBLE + CASE WHEN same THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN cont THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN e >= 0.25 THEN 0.10::DOUBLE ELSE 0 END
  + CASE WHEN near AND v >= 0.92 AND NOT attachment THEN CASE WHEN t <= 0.05 AND h <= 0.05 AND e <= 0.05 AND f <= 0.05 THEN 0.46::DOUBLE ELSE 0.10::DOUBLE END ELSE 0 END + CASE WHEN l_continuation OR continuation THEN 0.16::DOUBLE ELSE 0 END
  + CASE WHEN h >= 0.62 THEN 0.06::DOUBLE WHEN cont AND near AND h >= 0.15 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN cont AND near AND NOT attachment THEN 0.18::DOUBLE ELSE 0 END - CASE WHEN NOT near THEN least(0.24::DOUBLE, (gap - 1) * 0.12::DOUBLE) ELSE 0 END
  - CASE WHEN l_family <> '' AND family <> '' AND l_family <> family THEN 0.22::DOUBLE ELSE 0 END - CASE WHEN ends THEN 0.32::DOUBLE ELSE 0 END - CASE WHEN attachment AND NOT same THEN 0.18::DOUBLE ELSE 0 END - CASE WHEN v <= 0.18 AND e <= 0.05 AND t <= 0.05 AND NOT (cont AND near) THEN 0.12::DOUBLE ELSE 0 END AS raw FROM h),
decided AS (SELECT batch_id, batch_id AS prefix, l_id AS left_id, id AS right_id, l_page_no AS left_page, page_no AS right_page, l_family AS left_family, family AS right_family, round(greatest(0.02::DOUBLE, least(0.98::DOUBLE, raw)), 4) AS score, ends FROM s)
SELECT * EXCLUDE (score, ends), CAST(floor(score * 100 + 0.26::DOUBLE) AS INT) AS score, score <= 0.34 OR ends AS strong_split, score >= 0.72 AS merge, score >= 0.46 AND score < 0.72 AS ambiguous FROM decided
"""

QUERIES = {
    "G-03_boundary_score": (scores, SCORES_SQL),
    "G-02_G-05_document_groups": (document_groups, None),
    "R-01_events_once": (deduplicated, f"SELECT event_id, user_id AS task_id, {EVENT} AS kind FROM events"),
    "R-02_R-03_task_state": (states, f"WITH e AS (SELECT *, {EVENT} AS kind FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY kind IN ('completion', 'failure') DESC, ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT user_id AS task_id, CASE kind WHEN 'completion' THEN 'done' WHEN 'failure' THEN 'failed' WHEN 'pause' THEN 'human_review' ELSE 'processing' END AS status, CASE WHEN kind = 'completion' THEN 100.0::DOUBLE ELSE round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, value)), 2) END AS percent, n AS events FROM k WHERE k = 1"),
}
