"""Queries of scored fields, subscriptions and validity, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions.fields import CLASSIFICATION
from archivolt.operators import columns, retrieval, rollups, scored, sequences, tables
from archivolt.plans.data import TASKS, read, tasks
from archivolt.streaming import subscriptions as u

# SQL of both engines: the text, page and place of the k-th item of a task.
SAID = "CASE (id + k * 5) % 9 WHEN 0 THEN concat(' 渝人社发〔2015〕', id, ' 号。') WHEN 1 THEN concat('日期：2016年', 1 + id % 12, '月5日') WHEN 2 THEN '会议 2017/3/09' WHEN 3 THEN '机密' WHEN 4 THEN '内部 资料 一二三四五六七八九' WHEN 5 THEN concat('市府函(2018)', k, '号') WHEN 6 THEN '2019.13.4' WHEN 7 THEN batch_id ELSE '公开' END"
ITEM = (SAID + " AS text", "CAST(k % 3 AS INT) AS page_index", "3 AS page_total", "(id * 7 + k * 31) % 100 / 100.0{d} AS y_ratio", "CAST((id * 7 + k * 31) % 100 * 10 AS DOUBLE) AS y1", "CAST(k * 10 AS DOUBLE) AS x1", "CASE WHEN k = 2 THEN 'doc_title' ELSE 'text' END AS kind", "CAST(k AS INT) AS seq")


def _items(s, d):
    rows = tasks(s, d).select("id", "batch_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
    return rows.selectExpr("id", *(e.format(d="D") for e in ITEM))


def numbers(s, d):
    return _items(s, d).select("id", F.col("x1").alias("k"), scored.doc_number(F.col("text")).alias("doc_no"))


def fields(s, d):
    return scored.with_fall_backs(scored.scored_fields(_items(s, d)), tasks(s, d).select("id", "full_text"))


def _subscriptions(s, d):
    return read(s, d, "customer").selectExpr("c_custkey AS subscriber", "CASE WHEN c_custkey % 3 = 0 THEN array(c_custkey, c_custkey + 1) END AS task_ids", "CASE WHEN c_custkey % 3 = 1 THEN concat('src', c_custkey % 20) ELSE '' END AS batch_id").filter("c_custkey % 3 < 2 OR c_custkey < 6")


def notified(s, d):
    return u.notified(tasks(s, d).selectExpr("id AS task_id", "batch_id"), _subscriptions(s, d))


def valid(s, d):
    return u.valid_at(read(s, d, "events"), "ts", F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00")), u.TTL["task"]).select("event_id")


def acknowledged(s, d):
    return u.acknowledged(tasks(s, d).select("id"), read(s, d, "labels").selectExpr("doc_id AS id"), "id")


def providers(s, d):
    rows = tasks(s, d).select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("provider")).withColumn("answer", F.expr("CASE WHEN (id + provider) % 3 = 1 THEN concat('a', provider) END"))
    return u.first_provider(rows, "id", "provider", "answer")


def resumed(s, d):
    states = tasks(s, d).selectExpr("id AS task_id", "CASE WHEN id % 2 = 0 THEN 'human_review' ELSE 'done' END AS status")
    return u.resumed(states, read(s, d, "labels").selectExpr("doc_id AS task_id"))


def redrafts(s, d):
    t = tasks(s, d).selectExpr("'b' AS batch_id", "id", "concat('k', CAST(floor(id / 10) AS INT)) AS doc_key")
    edits = t.filter("id % 20 = 14").selectExpr("batch_id", "id", "concat('n', id) AS new_key")
    return sequences.redrafted(t, edits, "batch_id", "id", "doc_key").select("id", "doc_key")


def result_updates(s, d):
    page = "named_struct('regions', array(named_struct('content', lang)), 'lines', array(named_struct('text', 'l')))"
    t = tasks(s, d).selectExpr("id", "CASE WHEN id % 5 = 4 THEN 'processing' ELSE 'done' END AS status", f"array({page}) AS pages", "batch_id AS full_text", "1 AS page_count")
    new = tasks(s, d).filter("id % 5 < 2").selectExpr("id", f"CASE WHEN id % 5 = 0 THEN array({page}, {page}) END AS new_pages", "'other' AS new_text")
    return tables.updated_results(t, new).select("id", "full_text", F.col("page_count").cast("long").alias("page_count"))


def answers(s, d):
    i = F.col("id")
    said = retrieval.answered(F.when(i % 7 > 0, i % 30 / 100.0), F.when(i % 3 > 0, F.concat(F.lit(" a"), i)), F.expr("CASE id % 4 WHEN 0 THEN 'Supported' WHEN 1 THEN ' partial' WHEN 2 THEN 'odd' END"), i % 13 / 10.0, F.array(F.lit("2"), (i % 5).cast("string")), F.lit(3))
    return tasks(s, d).select("id", *(c.alias(n) for n, c in said.items())).withColumn("citations", F.array_join("citations", ","))


def entries(s, d):
    t = tasks(s, d).select("batch_id", "id", F.create_map(F.lit("tokens"), F.col("n_chars").cast("string"), F.lit("model"), F.col("lang")).alias("u"))
    return rollups.merged_entries(t, "batch_id", "u", "id")


def snippets(s, d):
    return tasks(s, d).select("id", columns.first_snippet("src1", F.expr("CASE WHEN id % 2 = 0 THEN concat('at ', batch_id, ' of it') END"), F.col("file_path")).alias("snippet"))


_I = f"(SELECT id, {', '.join(e.format(d='::DOUBLE') for e in ITEM)} FROM {TASKS}, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k))"
_CLEAN = lambda c: rf"regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), '^[ ，。；;:：]+|[ ，。；;:：]+$', '', 'g')"
_SEARCH = lambda c: f"translate({_CLEAN(c)}, '〔〕（）【】', '[]()[]')"
_NUMBER = lambda c: "translate(regexp_replace(coalesce(" + ", ".join(f"nullif(regexp_extract({_SEARCH(c)}, '{p}', 1), '')" for p in scored.DOC_NUMBERS) + r", ''), '\s+', '', 'g'), '[]()', '〔〕〔〕')"
_DATE = lambda c: rf"CASE WHEN regexp_extract({c}, '(\d{{4}})\s*(?:年|[./-])\s*(\d{{1,2}})\s*(?:月|[./-])\s*(\d{{1,2}})\s*日?', 2) NOT IN ('', '13') THEN regexp_replace(regexp_extract({c}, '(\d{{4}})\s*(?:年|[./-])\s*(\d{{1,2}})\s*(?:月|[./-])\s*(\d{{1,2}})', 1), '$', '-') || lpad(regexp_extract({c}, '\d{{4}}\s*(?:年|[./-])\s*(\d{{1,2}})', 1), 2, '0') || '-' || lpad(regexp_extract({c}, '\d{{4}}\s*(?:年|[./-])\s*\d{{1,2}}\s*(?:月|[./-])\s*(\d{{1,2}})', 1), 2, '0') END"
_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
FIELDS_SQL = f"""
WITH i AS (SELECT *, nullif({_NUMBER('text')}, '') AS number, {_DATE(_SEARCH('text'))} AS date, nullif(regexp_extract({_CLEAN('text')}, '{CLASSIFICATION}', 0), '') AS level, length(text) AS n FROM {_I}),
s AS (SELECT *, (page_index = 0)::INT * 8 + (n <= 40)::INT * 2 + (kind = 'doc_title')::INT + CASE WHEN y_ratio < 0.35 THEN 10 WHEN y_ratio < 0.5 THEN 4 ELSE -4 END AS sn, (page_index = 0)::INT * 4 + (y_ratio < 0.2 OR y_ratio > 0.75)::INT * 6 + (n <= 12)::INT * 4 AS sl,
  (page_index = 2)::INT * 4 + (n <= 24)::INT * 2 + {_ANY('text', scored.ISSUED)}::INT * 4 - {_ANY('text', scored.PERIOD)}::INT * 4 + CASE WHEN y_ratio > 0.6 THEN 10 WHEN page_index = 0 AND y_ratio < 0.35 THEN 4 ELSE 0 END AS sd FROM i),
f AS (SELECT id, arg_min(number, (-sn, page_index, y1, x1)) FILTER (number IS NOT NULL) AS doc_no, arg_min(date, (-sd, -page_index, -y1, x1)) FILTER (date IS NOT NULL) AS date, arg_min(level, (-sl, page_index, y1, x1)) FILTER (level IS NOT NULL) AS classification FROM s GROUP BY id)
SELECT id, coalesce(doc_no, '') AS doc_no, coalesce(date, '') AS date, coalesce(classification, '') AS classification FROM f
"""

QUERIES = {
    "C-22_doc_numbers": (numbers, f"SELECT id, x1 AS k, {_NUMBER('text')} AS doc_no FROM {_I}"),
    "C-20_C-27_C-28_C-29_scored_fields": (fields, FIELDS_SQL),
    "J-22_K-09_notified": (notified, "WITH s AS (SELECT c_custkey AS c, c_custkey % 3 AS m FROM customer WHERE c_custkey % 3 < 2 OR c_custkey < 6) SELECT c AS subscriber, doc_id AS task_id, source AS batch_id FROM s JOIN documents ON CASE m WHEN 0 THEN doc_id IN (c, c + 1) WHEN 1 THEN source = 'src' || (c % 20) ELSE TRUE END"),
    "R-07_R-08_K-11_valid": (valid, "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-09 23:00:00'"),
    "R-10_acknowledged": (acknowledged, "SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'acknowledged' ELSE 'requeued' END AS state FROM documents"),
    "R-11_providers": (providers, "SELECT doc_id AS id, CAST(CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS INT) AS provider, 'a' || CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS answer FROM documents"),
    "W-11_redrafts": (redrafts, "SELECT doc_id AS id, CASE WHEN doc_id // 10 % 2 = 1 AND doc_id % 10 >= 4 AND (SELECT count(*) FROM documents d WHERE d.doc_id = documents.doc_id // 10 * 10 + 4) > 0 THEN 'n' || (doc_id // 10 * 10 + 4) ELSE 'k' || (doc_id // 10) END AS doc_key FROM documents"),
    "D-06_result_updates": (result_updates, f"SELECT id, CASE id % 5 WHEN 0 THEN '--- Page 1 ---' || chr(10) || lang || chr(10) || chr(10) || '--- Page 2 ---' || chr(10) || lang WHEN 1 THEN 'other' ELSE batch_id END AS full_text, CASE WHEN id % 5 = 0 THEN 2::BIGINT ELSE 1 END AS page_count FROM {TASKS}"),
    "G-19_answers": (answers, f"WITH t AS (SELECT id, id % 30 / 100.0::DOUBLE >= 0.12 AND id % 4 < 2 AS ok, id % 7 > 0 AS told FROM {TASKS}) SELECT id, CASE WHEN told THEN CASE WHEN ok AND id % 3 > 0 THEN 'a' || id ELSE '{retrieval.UNSURE}' END END AS answer, CASE WHEN told THEN CASE WHEN NOT ok THEN 'insufficient' WHEN id % 4 = 0 THEN 'supported' ELSE 'partial' END END AS support_level, CASE WHEN told THEN CASE WHEN id % 30 / 100.0::DOUBLE < 0.12 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, id % 13 / 10.0::DOUBLE) END END AS confidence, CASE WHEN told THEN CASE WHEN NOT ok THEN '' WHEN id % 5 IN (1, 3) THEN '2,' || (id % 5) ELSE '2' END END AS citations FROM t"),
    "A-20_usage_entries": (entries, f"SELECT batch_id, 'tokens' AS name, CAST(sum(n_chars) AS DOUBLE) AS number, NULL::VARCHAR AS text FROM {TASKS} GROUP BY batch_id UNION ALL SELECT batch_id, 'model', NULL, arg_min(lang, id) FROM {TASKS} GROUP BY batch_id"),
    "P-04_first_snippet": (snippets, f"SELECT id, CASE WHEN starts_with(batch_id, 'src1') THEN CASE WHEN id % 2 = 0 THEN 'at ' || batch_id || ' of it' ELSE file_path END END AS snippet FROM {TASKS}"),
    "R-04_resumed": (resumed, "SELECT doc_id AS task_id, CASE WHEN doc_id % 2 = 1 THEN 'done' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'processing' ELSE 'human_review' END AS status FROM documents"),
}
