"""The same callbacks as batch and as stream give one answer; malformed lines go aside."""

import json
import random

from archivolt.streaming import callbacks as c

SILENCE, DELAY = "60 seconds", "10 minutes"


def callback(task, n, second, kind="event", **more):
    name = {"event": "occurredAt", "completion": "completedAt", "failure": "failedAt", "pause": "pausedAt"}[kind]
    out = {"kind": kind, "schemaVersion": "1", "eventId": f"e{task}-{n}", "traceId": f"t{task}-{n}", "taskId": task, name: f"2024-01-01T{second // 3600:02}:{second // 60 % 60:02}:{second % 60:02}Z"}
    if kind == "event":
        out["eventType"] = "PAGE_DONE"
    if kind == "pause":
        out["workflowThreadId"] = "w"
    return out | more


GOOD = [
    callback(1, 0, 0, eventType="WORKER_ACCEPTED"), callback(1, 1, 10, progress={"currentPage": 1, "totalPages": 4, "percent": 25.0}), callback(1, 2, 20), callback(1, 3, 900, "completion", summary={"total_pages": 4}),
    callback(2, 0, 5, progress={"currentPage": 1, "totalPages": 2, "percent": 50.0}), callback(2, 1, 30, "failure", error='{"x": 1}'),
    callback(3, 0, 7, eventType="HUMAN_REVIEW_REQUIRED"), callback(3, 1, 9, "pause", reviewStatus=" "),
    callback(4, 0, 3500), callback(5, 0, 3590, progress={"percent": 1.5}), callback(6, 0, 3595, "completion"),
]
BAD = [("{", "json"), ("", "json"), ("[1]", "json"), (json.dumps({"kind": "event", "taskId": "x"}), "json"), (json.dumps(callback(9, 0, 1) | {"kind": "other"}), "kind"), (json.dumps(callback(9, 1, 1) | {"traceId": " "}), "traceId"), (json.dumps(callback(9, 2, 1) | {"eventType": None}), "eventType"),
       (json.dumps(callback(9, 3, 1, "pause") | {"workflowThreadId": ""}), "workflowThreadId"), (json.dumps(callback(9, 4, 1) | {"occurredAt": "soon"}), "time"), (json.dumps({k: v for k, v in callback(9, 5, 1).items() if k != "taskId"}), "taskId")]


def written(spark, tmp_path, values, name="in"):
    folder = str(tmp_path / name)
    early, late = [v for v in values if "T00:5" not in v], [v for v in values if "T00:5" in v]
    for part in (early[::2], early[1::2], late):
        spark.createDataFrame([(v,) for v in part], "value string").coalesce(1).write.mode("append").text(folder)
    return folder


def board(rows):
    return {r.task_id: (r.status, r.trace_id, r.processed, r.total, r.percent, r.events, str(r.last_ts)) for r in rows}


def test_batch_and_stream(spark, tmp_path):
    values = [json.dumps(x) for x in [*GOOD, *GOOD[:5]]]
    random.Random(2).shuffle(values)
    folder = written(spark, tmp_path, values)
    batch = board(c.task_board(c.parsed(c.lines(spark, folder, False)), SILENCE, DELAY).collect())
    assert {k: v[0] for k, v in batch.items()} == {1: "done", 2: "failed", 3: "stalled", 4: "running", 5: "running", 6: "done"}
    assert batch[1][1:6] == ("t1-0", 4, 4, 100.0, 4) and batch[2][1:6] == ("t2-0", 1, 2, 50.0, 2) and batch[5][2:5] == (None, None, 1.5) and batch[4][2:5] == (None, None, None)
    # one file at a time; only the last one has events of a later hour, so that none is late for the watermark
    stream = c.task_stream(c.parsed(c.lines(spark, folder, files=1)), SILENCE, DELAY)
    seen = []
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(150)
    assert query.exception() is None
    last = {}
    for r in seen:
        last[r.task_id] = r
    got = board(last.values())
    assert got == batch


def test_side_output(spark, tmp_path):
    values = [json.dumps(x) for x in GOOD] + [v for v, _ in BAD]
    folder = written(spark, tmp_path, values, "mixed")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    query = c.split_to(c.parsed(c.lines(spark, folder, files=1)), good, bad, str(tmp_path / "at"))
    query.awaitTermination(150)
    assert sorted(r.event_id for r in spark.read.parquet(good).collect()) == sorted(x["eventId"] for x in GOOD)
    assert sorted((r.value, r.fault) for r in spark.read.parquet(bad).collect()) == sorted(BAD)
    assert spark.read.parquet(good).filter("kind = 'pause'").first().review_status == c.PENDING
