"""Queries of the aggregations, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.operators import rollups as r
from archivolt.operators.columns import FIELDS, parent_folder
from archivolt.plans.data import PAGES, TASKS, pages, read, status, tasks

# Archive fields of two readers, as SQL of both engines.
RULE = {"archive_no": "concat(batch_id, '-', id)", "doc_no": "CASE WHEN id % 3 = 0 THEN '' ELSE concat('D', id % 7) END", "responsible": "lang", "title": "concat('t', id % 11)", "date": "CASE WHEN id % 2 = 0 THEN '2024-01-02' ELSE '' END", "pages": "'1'", "classification": "''", "remarks": "CASE WHEN id % 6 = 0 THEN 'r' ELSE '' END"}
LLM = {"archive_no": "CASE WHEN id % 4 = 0 THEN '' ELSE concat(batch_id, '-', id) END", "doc_no": "concat('D ', id % 7)", "responsible": "CASE WHEN id % 5 = 0 THEN 'fr' ELSE lang END", "title": "concat('t', id % 13)", "date": "'2024-01-02'", "pages": "concat('', id % 3)", "classification": "''", "remarks": "''"}
DOC = "concat(batch_id, ':', CAST(floor((page_no - 1) / 3) AS INT))"
_LONG = "(" + " UNION ALL ".join(f"SELECT id, {DOC} AS doc, page_no, '{f}' AS field, {RULE[f]} AS rule, {LLM[f]} AS llm FROM {PAGES}" for f in FIELDS) + ")"
DISTANCE = "CASE WHEN id * 7 % 23 < 4 THEN id * 7 % 23 ELSE id * 7 % 23 // 9 * 9 + 9 END"
_C = lambda c: f"replace({c}, ' ', '')"
_MERGED = f"(SELECT *, CASE WHEN field = 'pages' THEN CASE WHEN page_no % 4 <> 0 THEN CAST(page_no % 4 AS VARCHAR) ELSE rule END WHEN {_C('rule')} = {_C('llm')} THEN rule WHEN rule = '' THEN llm WHEN llm = '' THEN rule ELSE '' END AS recommended FROM {_LONG})"
_CONFLICT = f"(SELECT *, CASE WHEN field = 'pages' THEN llm <> recommended ELSE {_C('rule')} <> {_C('llm')} AND rule <> '' AND llm <> '' END AS conflict FROM {_MERGED})"


def _fields(s, d):
    p = pages(s, d).selectExpr("id", f"{DOC} AS doc", "page_no", *(f"{e} AS rule_{f}" for f, e in RULE.items()), *(f"{e} AS llm_{f}" for f, e in LLM.items()))
    return r.long_fields(p, ["id", "doc", "page_no"])


def _merged(s, d):
    return r.merged_fields(_fields(s, d).withColumn("n", F.col("page_no") % 4), "n")


def _votes(s, d):
    return _fields(s, d).select("doc", F.col("page_no").alias("page"), "field", F.col("llm").alias("value"), (F.col("id") % 10 / 10.0).alias("confidence"))


def statuses(s, d):
    t = tasks(s, d).withColumn("s", F.expr(status()))
    return t.select("id", r.normal_status(F.col("s")).alias("status"), r.effective_status(F.col("s"), F.when(F.col("id") % 3 == 0, "x"), F.when(F.col("id") % 2 == 0, " Required ")).alias("effective"))


def counts(s, d):
    t = tasks(s, d).withColumn("s", r.normal_status(F.expr(status())))
    return r.status_counts(t, "s")


def folders(s, d):
    t = tasks(s, d).withColumn("s", r.normal_status(F.expr(status()))).filter(F.col("s").isin("done", "failed"))
    t = t.select("id", parent_folder(F.col("file_path")).alias("folder"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id % 90 AS INT))").alias("at"))
    return r.latest(t, "folder", "at", "id")


def submitted(s, d):
    t = tasks(s, d).withColumn("sub", F.expr("CASE WHEN id % 4 = 0 THEN concat('single:', id) ELSE concat('batch:', batch_id) END")).withColumn("nm", F.expr("CASE WHEN id % 3 = 0 THEN ' ' ELSE concat('n', id) END"))
    return r.submissions(t, "sub", "nm", "id")


def qa_metrics(s, d):
    c = read(s, d, "conversations").filter("role = 'assistant'")
    weak, rated, good = F.col("turn") % 3 == 0, F.col("conv_id") % 2 == 0, (F.col("conv_id") % 2 == 0) & (F.col("turn") % 4 == 1)
    return c.agg(F.count("*").alias("total"), r.rate(F.count_if(weak), F.count("*")).alias("insufficient_rate"), F.count_if(rated).alias("feedback"), r.rate(F.count_if(good), F.count_if(rated)).alias("helpful_rate"))


def qa_trend(s, d):
    e = read(s, d, "events").select(F.to_date("ts").alias("day"), (F.col("event_type") == "view").alias("good"))
    return r.calendar_rates(e, "day", "good", "2024-01-12")


def _samples(s, d):
    return read(s, d, "orders").selectExpr("o_orderkey % 4 AS page_gap", "CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'budget' ELSE 'contract' END AS left_family", "CASE o_custkey % 2 WHEN 0 THEN 'budget' ELSE 'contract' END AS right_family", "CASE WHEN o_orderstatus = 'F' THEN 'same' WHEN o_orderstatus = 'O' THEN 'Different ' ELSE 'unsure' END AS label")


def priors(s, d):
    return r.with_bias(r.priors(_samples(s, d)))


def recommended(s, d):
    return _merged(s, d).select("id", "field", "recommended", "conflict")


def agreed(s, d):
    return r.agreement(_fields(s, d), "id")


def filled(s, d):
    return r.fill_rates(_merged(s, d), ("rule", "llm", "recommended"))


def dominant(s, d):
    t = pages(s, d).selectExpr("batch_id", "CASE WHEN id % 6 = 0 THEN NULL ELSE lang END AS doc")
    return r.dominant(t, "batch_id", "doc").select("batch_id", "dominant_doc", "correct", "total", F.round(F.col("correct") / F.col("total"), 6).alias("accuracy"))


def accuracy(s, d):
    truth = _fields(s, d).filter("id % 2 = 0").select("id", "field", F.concat(F.upper("llm"), F.lit(".")).alias("truth"))
    return r.field_accuracy(_fields(s, d), truth, "id", ("rule", "llm"))


def votes(s, d):
    return r.page_votes(_votes(s, d), "doc")


def disagree(s, d):
    return r.conflicts(_votes(s, d), "doc")


def quality(s, d):
    p = pages(s, d).selectExpr(f"{DOC} AS doc", "id % 12 / 10.0D AS confidence", "id % 3 AS retries")
    return r.page_quality(p, "doc")


def usage(s, d):
    p = tasks(s, d).select("batch_id", F.create_map(F.lit("prompt"), F.col("n_chars"), F.lit("answer"), F.col("id")).alias("u"))
    return r.merged_usage(p, "batch_id", "u")


def thresholds(s, d):
    return r.thresholds(pages(s, d).selectExpr("batch_id", f"{DISTANCE.replace('//', 'div')} AS dist"), "batch_id", "dist")


def day_submissions(s, d):
    return r.submissions_of_day(read(s, d, "events"), "user_id", "ts", "event_type").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "submissions")


def histogram(s, d):
    return r.latency_histogram(read(s, d, "events"), "event_type", "value")


def limits(s, d):
    return r.over_limit(read(s, d, "events"), "event_type", "ts", 2, 3600)


_S = f"(SELECT *, {status()} AS s FROM {TASKS})"
_N = "CASE WHEN trim(lower(s)) = 'completed' THEN 'done' WHEN s = 'queued' THEN 'pending' WHEN s = 'RUNNING' THEN 'processing' ELSE lower(s) END"
_V = f"(SELECT doc, page_no AS page, field, llm AS value, {_C('llm')} AS k, id % 10 / 10.0::DOUBLE AS c FROM {_LONG} WHERE llm <> '')"
_LE = ", ".join(f"count(*) FILTER (value <= {b}) AS le_{str(b).replace('.', '_')}" for b in r.LATENCY)
_BIAS = lambda n, m: f"CASE WHEN same + different < {n} THEN 0.0::DOUBLE ELSE round((same / (same + different) - 0.5) * 2 * {m}::DOUBLE, 4) END"

QUERIES = {
    "P-08_P-09_status": (statuses, f"SELECT id, {_N} AS status, CASE WHEN s = 'RUNNING' AND (id % 3 = 0 OR id % 2 = 0) THEN 'human_review' ELSE {_N} END AS effective FROM {_S}"),
    "A-05_status_counts": (counts, f"SELECT count(*) AS total, count(*) FILTER (n = 'done') AS done_count, count(*) FILTER (n = 'failed') AS failed_count, count(*) FILTER (n = 'pending') AS pending_count, count(*) FILTER (n NOT IN ('done', 'failed', 'pending')) AS processing_count FROM (SELECT {_N} AS n FROM {_S})"),
    "A-02_A-03_F-04_folders": (folders, f"WITH t AS (SELECT id, '/in/' || batch_id AS folder, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (id % 90) AS t0 FROM {TASKS} WHERE id % 5 IN (0, 3)) SELECT folder, count(*) AS count, max(t0) AS last_time, min(id) FILTER (t0 = m) AS latest_task_id FROM (SELECT *, max(t0) OVER (PARTITION BY folder) AS m FROM t) GROUP BY folder"),
    "A-04_submissions": (submitted, f"SELECT CASE WHEN id % 4 = 0 THEN 'single:' || id ELSE 'batch:' || batch_id END AS sub, count(*) AS count, arg_min('n' || id, id) FILTER (id % 3 <> 0) AS name, max(id) AS latest_task_id FROM {TASKS} GROUP BY sub"),
    "A-06_qa_metrics": (qa_metrics, "SELECT count(*) AS total, round(count(*) FILTER (turn % 3 = 0) / count(*), 6) AS insufficient_rate, count(*) FILTER (conv_id % 2 = 0) AS feedback, round(count(*) FILTER (conv_id % 2 = 0 AND turn % 4 = 1) / count(*) FILTER (conv_id % 2 = 0), 6) AS helpful_rate FROM conversations WHERE role = 'assistant'"),
    "A-07_qa_trend": (qa_trend, "WITH c AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-06', TIMESTAMP '2024-01-12', INTERVAL 1 DAY)) AS DATE) AS d), e AS (SELECT CAST(ts AS DATE) AS d, event_type FROM events), n AS (SELECT c.d, count(event_type) AS f, count(*) FILTER (event_type = 'view') AS h FROM c LEFT JOIN e ON e.d = c.d GROUP BY c.d) SELECT strftime(d, '%Y-%m-%d') AS date, f AS feedback_count, h AS helpful_count, CASE WHEN f > 0 THEN round(h / f, 6) ELSE 0.0::DOUBLE END AS helpful_rate FROM n"),
    "A-08_A-09_F-17_priors": (priors, f"WITH s AS (SELECT greatest(1, o_orderkey % 4) AS page_gap, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'budget' ELSE 'contract' END AS l, CASE o_custkey % 2 WHEN 0 THEN 'budget' ELSE 'contract' END AS r, o_orderstatus AS o FROM orders WHERE o_orderstatus IN ('F', 'O')), k AS (SELECT 'gap' AS kind, '' AS left_family, '' AS right_family, page_gap, o FROM s UNION ALL SELECT CASE WHEN l = r THEN 'family' ELSE 'transition' END, l, r, page_gap, o FROM s WHERE l <> ''), n AS (SELECT kind, left_family, right_family, page_gap, count(*) FILTER (o = 'F') AS same, count(*) FILTER (o = 'O') AS different FROM k GROUP BY ALL) SELECT *, CASE kind WHEN 'family' THEN {_BIAS(2, 0.16)} WHEN 'transition' THEN {_BIAS(2, 0.14)} ELSE {_BIAS(4, 0.06)} END AS bias FROM n"),
    "G-10_J-12_merged_fields": (recommended, f"SELECT id, field, recommended, conflict FROM {_CONFLICT}"),
    "A-32_agreement": (agreed, f"SELECT id, count(*) FILTER (e) AS matched, round(count(*) FILTER (e) / count(*), 4) AS ratio, coalesce(string_agg(field, ',' ORDER BY field) FILTER (NOT e), '') AS mismatched FROM (SELECT *, {_C('rule')} = {_C('llm')} AS e FROM {_LONG}) GROUP BY id"),
    "A-10_A-11_fill_rate": (filled, "SELECT " + ", ".join(f"round(count(*) FILTER ({t} <> '') / count(*), 6) AS {t}_fill" for t in ("rule", "llm", "recommended")) + f", count(*) FILTER (conflict) AS conflict_fields, round(count(*) FILTER (conflict) / count(*), 6) AS conflict_rate FROM {_CONFLICT}"),
    "A-13_J-10_dominant": (dominant, f"WITH n AS (SELECT batch_id, lang, count(*) AS c FROM {PAGES} WHERE id % 6 <> 0 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY c DESC, lang) AS k, CAST(sum(c) OVER (PARTITION BY batch_id) AS BIGINT) AS total FROM n) SELECT batch_id, lang AS dominant_doc, c AS correct, total, round(c / total, 6) AS accuracy FROM k WHERE k = 1"),
    "A-14_field_accuracy": (accuracy, f"WITH v AS (SELECT field, unnest(['rule', 'llm']) AS target, unnest([rule, llm]) AS v, llm FROM {_LONG} WHERE id % 2 = 0), e AS (SELECT field, target, lower(regexp_replace(v, '[\\s\\-]+', '', 'g')) = lower(regexp_replace(llm, '[\\s\\-]+', '', 'g')) AS ok FROM v) SELECT target, field, count(*) FILTER (ok) AS correct, count(*) AS total, round(count(*) FILTER (ok) / count(*), 6) AS accuracy FROM e GROUP BY GROUPING SETS ((target, field), (target))"),
    "A-16_page_vote": (votes, f"WITH n AS (SELECT doc, field, k, CASE WHEN field = 'title' THEN arg_min(value, (-length(value), page)) ELSE arg_min(value, page) END AS value, count(*) AS n, round(sum(c), 9) AS score, max(c) AS top, min(page) AS page FROM {_V} GROUP BY doc, field, k) SELECT doc, field, value, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY doc, field ORDER BY n DESC, score DESC, top DESC, length(value) DESC, page) AS r FROM n) WHERE r = 1"),
    "A-17_page_conflicts": (disagree, f"SELECT doc, field, count(DISTINCT nullif({_C('llm')}, '')) AS n_values, CASE WHEN count(DISTINCT nullif({_C('llm')}, '')) > 1 THEN 'conflict' WHEN count(DISTINCT nullif({_C('llm')}, '')) = 1 THEN 'aligned' ELSE 'missing' END AS state FROM {_LONG} WHERE field IN ('archive_no', 'doc_no', 'responsible', 'date', 'classification') GROUP BY doc, field"),
    "A-18_A-28_page_quality": (quality, f"SELECT {DOC} AS doc, count(*) AS page_count, round(avg(least(1.0::DOUBLE, id % 12 / 10.0::DOUBLE)), 4) AS average, min(least(1.0::DOUBLE, id % 12 / 10.0::DOUBLE)) AS lowest, max(least(1.0::DOUBLE, id % 12 / 10.0::DOUBLE)) AS highest, count(*) FILTER (id % 3 > 0) AS with_retry, max(id % 3) AS max_retry FROM {PAGES} GROUP BY doc"),
    "A-20_usage": (usage, f"SELECT batch_id, 'prompt' AS name, CAST(sum(n_chars) AS BIGINT) AS value FROM {TASKS} GROUP BY batch_id UNION ALL SELECT batch_id, 'answer', CAST(sum(id) AS BIGINT) FROM {TASKS} GROUP BY batch_id"),
    "A-24_threshold": (thresholds, f"WITH v AS (SELECT batch_id, {DISTANCE} AS dist FROM {PAGES}), g AS (SELECT *, lead(dist) OVER (PARTITION BY batch_id ORDER BY dist) - dist AS gap FROM v), f AS (SELECT batch_id, count(*) AS n, min(dist) AS one, max(gap) AS gap, arg_min(dist, (-coalesce(gap, -1), dist)) AS t0, median(dist) AS med, stddev_pop(dist) AS sp FROM g GROUP BY batch_id) SELECT batch_id, CAST(greatest(8, least(18, CASE WHEN n = 1 THEN one + 2 WHEN gap >= 3 THEN round_even(t0 + gap / 2, 0) ELSE round_even(med + greatest(2, sp * 1.25::DOUBLE), 0) END)) AS BIGINT) AS threshold FROM f"),
    "A-26_day_submissions": (day_submissions, "SELECT user_id, strftime(ts + INTERVAL 8 HOURS, '%Y-%m-%d') AS day, count(DISTINCT event_type) AS submissions FROM events GROUP BY ALL"),
    "K-10_R-09_latency": (histogram, f"SELECT event_type, {_LE}, count(*) AS total, round(sum(value), 2) AS seconds FROM events GROUP BY event_type"),
    "R-05_rate_limit": (limits, "SELECT event_type, epoch_us(ts) // 3600000000 AS window_no, count(*) AS requests, greatest(0, count(*) - 2) AS refused FROM events GROUP BY ALL"),
}
