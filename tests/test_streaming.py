"""Streams give what the batch forms give."""

import datetime

from archivolt.streaming import tasks


def run(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def source(spark, tmp_path, rows, schema):
    folder = str(tmp_path / "in")
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), spark.read.parquet(folder)


T0 = datetime.datetime(2024, 1, 1)


def test_states(spark, tmp_path):
    rows = [(k % 3, k, T0 + datetime.timedelta(seconds=k), "completion" if k == 6 else "failure" if k == 7 else "progress", float(k)) for k in range(12)]
    stream, batch = source(spark, tmp_path, rows + rows[:4], "task_id long, event_id long, ts timestamp, kind string, percent double")
    last = {}
    for r in run(tasks.task_states(stream), "states", "complete").collect():
        last[r.task_id] = (r.status, r.percent)
    assert last == {r.task_id: (r.status, r.percent) for r in tasks.task_states(batch).collect()} == {0: ("done", 100.0), 1: ("failed", 7.0), 2: ("processing", 11.0)}
    assert run(tasks.once(stream), "once", "append").count() == 12 == tasks.once(batch).count()
    counts = run(tasks.request_counts(stream, "task_id", 2), "requests", "complete")
    assert {(r.task_id, r.requests, r.refused) for r in counts.collect()} == {(r.task_id, r.requests, r.refused) for r in tasks.request_counts(batch, "task_id", 2).collect()}


def test_breaker(spark, tmp_path):
    oks = [1, 0, 0, 0, 1, 1, 0]
    at = [0, 1, 2, 3, 10, 70, 71]
    rows = [("p", T0 + datetime.timedelta(seconds=s), bool(k)) for s, k in zip(at, oks)]
    folder = str(tmp_path / "calls")
    schema = "provider string, ts timestamp, ok boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    out = tasks.breaker(spark.readStream.schema(schema).parquet(folder), "provider", failures=3)
    got = run(out, "breaker", "update").collect()[-1]
    # three failures open it, the call at 10 s is refused, the one at 70 s closes it, then one failure
    assert (got.state, got.failures, got.refused) == ("closed", 1, 1)
