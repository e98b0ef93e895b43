"""Callbacks of workers: lines of JSON to checked events, malformed ones to a side output, each event once, the state of every task.

All but the side output is the same in batch and stream. A stream keeps the ids of events, and tasks, for a bounded time only.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from archivolt.functions.text import coerced
from archivolt.streaming.tasks import TERMINAL, once

#: The shape of a callback; payloads stay texts of JSON. kind: event, completion, failure or pause.
SCHEMA = "kind string, schemaVersion string, eventId string, traceId string, taskId long, batchId string, eventType string, occurredAt string, completedAt string, failedAt string, pausedAt string, progress struct<currentPage: int, totalPages: int, percent: double>, summary struct<total_pages: int, processed_pages: int>, workflowThreadId string, reviewStatus string, reviewReason string, error string, broken string"
TIMES = {"event": "occurredAt", "completion": "completedAt", "failure": "failedAt", "pause": "pausedAt"}
# What must not be blank, of all and of some kinds, and what an event's type makes of its task.
REQUIRED, OF_KIND = ("schemaVersion", "eventId", "traceId", "taskId"), {"event": "eventType", "pause": "workflowThreadId"}
STATUS, OTHER = {"WORKER_ACCEPTED": "worker_accepted", "HUMAN_REVIEW_REQUIRED": "human_review"}, "running"
OF_KINDS, PENDING = {"completion": "done", "failure": "failed", "pause": "human_review"}, "pending_human_review"


def lines(spark: SparkSession, folder: str, stream: bool = True, files: int = 64) -> DataFrame:
    """S-09: the lines (value) of all files of a folder; a stream takes `files` new ones at a time."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(folder) if stream else spark.read.text(folder)


def parsed(rows: DataFrame) -> DataFrame:
    """Lines (value) as events, with `fault`: json, the first field that is missing, or null for an event that is whole.

    An event needs a time that can be read; its columns are event_id, task_id, batch_id, kind, status, ts, trace_id, the
    pages and percent it tells (null without progress), and review fields of a pause.
    """
    r = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    own = rows.withColumn("__r", r).select("value", "__r.*")
    blank = lambda c: coerced(F.col(c)) == ""
    time = F.coalesce(*(F.when(F.col("kind") == k, F.try_to_timestamp(c)) for k, c in TIMES.items()))
    fault = F.when(F.col("broken").isNotNull() | F.col("kind").isNull() & F.col("eventId").isNull() & F.col("taskId").isNull(), "json").when(~F.coalesce(F.col("kind").isin(*TIMES), F.lit(False)), "kind")
    for c in REQUIRED:
        fault = fault.when(blank(c), c)
    for k, c in OF_KIND.items():
        fault = fault.when((F.col("kind") == k) & blank(c), c)
    status = F.coalesce(*(F.when(F.col("eventType") == k, v) for k, v in STATUS.items()), F.lit(OTHER))
    status = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in OF_KINDS.items()), status)
    done, pages = F.col("kind") == "completion", F.col("summary.total_pages")
    told = lambda field, at_end: F.when(done, at_end).otherwise(F.col(f"progress.{field}"))
    return own.withColumn("ts", time).select(
        "value", fault.when(F.col("ts").isNull(), "time").alias("fault"), F.col("eventId").alias("event_id"), F.col("taskId").alias("task_id"), F.col("batchId").alias("batch_id"), "kind", status.alias("status"), "ts", F.col("traceId").alias("trace_id"),
        told("currentPage", F.coalesce(pages, F.lit(0))).alias("processed"), told("totalPages", F.coalesce(pages, F.lit(0))).alias("total"), told("percent", F.lit(100.0)).alias("percent"),
        F.when(F.col("kind") == "pause", F.coalesce(F.nullif(coerced(F.col("reviewStatus")), F.lit("")), F.lit(PENDING))).alias("review_status"),
    )


def events(found: DataFrame) -> DataFrame:
    """The whole events, without what only the side output needs."""
    return found.filter("fault IS NULL").drop("value", "fault")


def malformed(found: DataFrame) -> DataFrame:
    return found.filter("fault IS NOT NULL").select("value", "fault")


def split_to(found: DataFrame, good: str, bad: str, checkpoint: str):
    """A stream of parsed lines written to two folders of Parquet, whole events and malformed lines; each batch is read once.

    A batch that is repeated after a loss overwrites its own two folders, so nothing is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            events(batch).write.mode("overwrite").parquet(f"{good}/batch={number}")
            malformed(batch).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        finally:
            batch.unpersist()

    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _latest() -> dict[str, Column]:
    """What a task's events come to, whatever their order of arrival: the last status, the last progress, the first trace."""
    at = F.struct("ts", "event_id")
    told = F.when(F.col("percent").isNotNull() | F.col("processed").isNotNull(), at)
    last = lambda c, by: F.max_by(c, by)
    return {"status": last("status", at), "last_ts": F.max("ts"), "trace_id": F.min_by("trace_id", at), "processed": last("processed", told), "total": last("total", told), "percent": last("percent", told), "events": F.count("*")}


def task_board(found: DataFrame, silence: str, delay: str) -> DataFrame:
    """(task_id, status, last_ts, trace_id, processed, total, percent, events) of each task, each event counted once; a batch only.

    A task that isn't over is 'stalled' when `silence` has passed since its last event and before the latest of all, less `delay`.
    """
    rows = once(events(found)).groupBy("task_id").agg(*(c.alias(n) for n, c in _latest().items()))
    latest = rows.agg((F.max("last_ts") - F.expr(f"INTERVAL {delay}")).alias("__now"))  # one row
    stalled = ~F.col("status").isin(*TERMINAL) & (F.col("last_ts") + F.expr(f"INTERVAL {silence}") <= F.col("__now"))
    return rows.crossJoin(F.broadcast(latest)).withColumn("status", F.when(stalled, "stalled").otherwise(F.col("status"))).drop("__now")


STATE = "status string, at timestamp, id string, trace string, t_at timestamp, t_id string, processed int, total int, percent double, p_at timestamp, p_id string, events long"
BOARD = "task_id long, status string, last_ts timestamp, trace_id string, processed int, total int, percent double, events long"


def task_stream(found: DataFrame, silence: str, delay: str) -> DataFrame:
    """The rows of task_board() as a stream of updates: each batch gives the tasks that changed or fell silent.

    Ids of events are kept for `delay`, tasks until they are over. A silent task is told by a timer of event time.
    """
    wait = int(pd.Timedelta(silence).total_seconds() * 1000)
    own = found.filter("fault IS NULL").drop("value", "fault").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])

    def row(key: tuple, s: list, status: str) -> pd.DataFrame:
        return pd.DataFrame([[key[0], status, s[1], s[3], s[6], s[7], s[8], s[11]]], columns=["task_id", "status", "last_ts", "trace_id", "processed", "total", "percent", "events"]).astype({"processed": "Int32", "total": "Int32", "percent": "float64"})

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = list(state.get) if state.exists else [None] * 11 + [0]
        if state.hasTimedOut:
            yield row(key, s, "stalled")
            state.update(tuple(s))  # without a timer: told once, until the next event
            return
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                at = (r.ts.to_pydatetime(), r.event_id)
                if s[1] is None or at > (s[1], s[2]):
                    s[0:3] = [r.status, *at]
                if s[4] is None or at < (s[4], s[5]):
                    s[3:6] = [r.trace_id, *at]
                known = [None if pd.isna(v) else v for v in (r.processed, r.total, r.percent)]
                if (known[0] is not None or known[2] is not None) and (s[9] is None or at > (s[9], s[10])):
                    s[6:11] = [*(None if v is None else int(v) for v in known[:2]), known[2], *at]
                s[11] += 1
        state.update(tuple(s))
        if s[0] not in TERMINAL:
            due = int(s[1].replace(tzinfo=datetime.timezone.utc).timestamp() * 1000) + wait
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield row(key, s, s[0])

    return own.groupBy("task_id").applyInPandasWithState(step, BOARD, STATE, "update", GroupStateTimeout.EventTimeTimeout)
