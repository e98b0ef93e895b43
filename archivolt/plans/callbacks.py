"""Queries of worker callbacks, beside their SQL: events of users as lines of JSON, some repeated, some malformed."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.plans.data import read
from archivolt.streaming import callbacks as c

# SQL of both engines.
KIND = "CASE event_type WHEN 'purchase' THEN 'completion' WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'pause' ELSE 'event' END"
WRONG = "CASE WHEN event_id % 23 = 0 THEN 'json' WHEN event_id % 23 = 1 THEN 'traceId' WHEN event_id % 23 = 2 THEN 'time' WHEN event_id % 23 = 3 THEN 'kind' WHEN event_id % 23 = 4 AND event_type = 'signup' THEN 'workflowThreadId' END"
TYPE = "CASE WHEN event_id % 5 = 0 THEN 'WORKER_ACCEPTED' WHEN event_id % 5 = 1 THEN 'HUMAN_REVIEW_REQUIRED' ELSE 'PAGE_DONE' END"
SILENCE, DELAY = "3600 seconds", "86400 seconds"


def _lines(s, d):
    e = read(s, d, "events").select("*", F.expr(KIND).alias("kind"), F.expr(WRONG).alias("wrong"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"))
    kind, at = F.when(F.col("wrong") == "kind", "odd").otherwise(F.col("kind")), F.when(F.col("wrong") == "time", "soon").otherwise(F.col("at"))
    pages = F.when(F.col("event_id") % 3 > 0, F.struct((F.col("event_id") % 7).cast("int").alias("currentPage"), F.lit(7).alias("totalPages"), F.col("value").alias("percent")))
    body = F.struct(
        kind.alias("kind"), F.lit("1").alias("schemaVersion"), F.concat(F.lit("e"), "event_id").alias("eventId"), F.when(F.col("wrong") == "traceId", " ").otherwise(F.concat(F.lit("t"), "event_id")).alias("traceId"), F.col("user_id").alias("taskId"),
        F.expr(TYPE).alias("eventType"), *(F.when(F.col("kind") == k, at).alias(name) for k, name in c.TIMES.items()), pages.alias("progress"), F.struct((F.col("event_id") % 9).cast("int").alias("total_pages")).alias("summary"),
        F.when(F.col("wrong") == "workflowThreadId", "").otherwise("w").alias("workflowThreadId"),
    )
    text = F.to_json(body)
    rows = e.select(F.when(F.col("wrong") == "json", F.left(text, F.length(text) - 1)).otherwise(text).alias("value"), "event_id")
    return rows.unionByName(rows.filter("event_id % 4 = 0")).select("value")


def board(s, d):
    rows = c.task_board(c.parsed(_lines(s, d)), SILENCE, DELAY)
    return rows.select("task_id", "status", "trace_id", "processed", "total", "percent", "events")


def malformed(s, d):
    return c.malformed(c.parsed(_lines(s, d))).groupBy("fault").agg(F.count("*").alias("n"))


_E = f"e AS (SELECT *, {KIND} AS kind, {WRONG} AS wrong, 'e' || event_id AS eid FROM events)"
QUERIES = {
    "S-09_callbacks": (board, f"""WITH {_E}, g AS (SELECT user_id, ts, eid, 't' || event_id AS trace, CASE kind WHEN 'completion' THEN 'done' WHEN 'failure' THEN 'failed' WHEN 'pause' THEN 'human_review' ELSE CASE {TYPE} WHEN 'WORKER_ACCEPTED' THEN 'worker_accepted' WHEN 'HUMAN_REVIEW_REQUIRED' THEN 'human_review' ELSE 'running' END END AS status,
      kind = 'completion' OR event_id % 3 > 0 AS told, CASE WHEN kind = 'completion' THEN event_id % 9 ELSE event_id % 7 END AS processed, CASE WHEN kind = 'completion' THEN event_id % 9 ELSE 7 END AS total, CASE WHEN kind = 'completion' THEN 100.0::DOUBLE ELSE value END AS percent FROM e WHERE wrong IS NULL),
      t AS (SELECT user_id AS task_id, arg_max(status, (ts, eid)) AS status, max(ts) AS last, arg_min(trace, (ts, eid)) AS trace_id, CAST(arg_max(processed, (ts, eid)) FILTER (told) AS INT) AS processed, CAST(arg_max(total, (ts, eid)) FILTER (told) AS INT) AS total, arg_max(percent, (ts, eid)) FILTER (told) AS percent, count(*) AS events FROM g GROUP BY user_id)
      SELECT task_id, CASE WHEN status NOT IN ('done', 'failed') AND last + INTERVAL {SILENCE} <= (SELECT max(last) FROM t) - INTERVAL {DELAY} THEN 'stalled' ELSE status END AS status, trace_id, processed, total, percent, events FROM t"""),
    "S-09_malformed": (malformed, f"WITH {_E} SELECT wrong AS fault, CAST(sum(CASE WHEN event_id % 4 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM e WHERE wrong IS NOT NULL GROUP BY wrong"),
}
