"""Task events as a stream: each event once, the state of every task, fixed windows, and a breaker per provider."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What an event makes of its task; any other event means that it is being processed.
STATES = {"completion": "done", "failure": "failed", "pause": "human_review"}
TERMINAL = ("done", "failed")


def once(events: DataFrame, key: str = "event_id", time: str = "ts", within: str = "1 day") -> DataFrame:
    """R-01: repeated events are dropped; in a stream the keys seen are kept for `within`."""
    if events.isStreaming:
        return events.withWatermark(time, within).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def state_of(kind: Column) -> Column:
    out = None
    for name, state in STATES.items():
        out = F.when(kind == name, state) if out is None else out.when(kind == name, state)
    return out.otherwise("processing")


def task_states(events: DataFrame) -> DataFrame:
    """R-02, R-03: the state and progress of each task by event time; a late event doesn't reopen a finished task (B-17).

    events: task_id, event_id, ts, kind, percent. An aggregation of constant size per task, in batch or stream.
    """
    state = state_of(F.col("kind"))
    order = F.struct(state.isin(*TERMINAL).alias("over"), "ts", "event_id")
    percent = F.when(state == "done", 100.0).otherwise(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), "percent")), 2))
    return events.groupBy("task_id").agg(F.max_by(state, order).alias("status"), F.max_by(percent, order).alias("percent"), F.count("*").alias("events"))


def request_counts(events: DataFrame, client: str, limit: int, seconds: int = 60) -> DataFrame:
    """R-05: requests in fixed windows of event time; windows close two lengths later."""
    rows = events.withWatermark("ts", f"{2 * seconds} seconds") if events.isStreaming else events
    return rows.groupBy(F.window("ts", f"{seconds} seconds"), client).agg(F.count("*").alias("requests")).select(client, F.col("window.start").alias("start"), "requests", F.greatest(F.lit(0), F.col("requests") - limit).alias("refused"))


def breaker(calls: DataFrame, provider: str, failures: int = 5, recovery: float = 60.0) -> DataFrame:
    """R-06: state of a circuit breaker after the calls of each batch, per provider; a stream only.

    calls: provider, ts, ok. Closed until `failures` in a row; open for `recovery` seconds of event time, then one
    call decides. Calls that come while it is open count as refused.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mode, run, since, refused = state.get if state.exists else ("closed", 0, 0.0, 0)
        for pdf in frames:
            for at, ok in pdf.sort_values("ts")[["ts", "ok"]].itertuples(index=False):
                now = at.timestamp()
                if mode == "open" and now - since >= recovery:
                    mode = "half_open"
                if mode == "open":
                    refused += 1
                elif ok:
                    mode, run = "closed", 0
                else:
                    run, since = run + 1, now
                    mode = "open" if mode == "half_open" or run >= failures else mode
        state.update((mode, run, since, refused))
        yield pd.DataFrame({provider: [key[0]], "state": [mode], "failures": [run], "refused": [refused]})

    kept = "state string, failures long, since double, refused long"
    out = f"{provider} {calls.schema[provider].dataType.simpleString()}, state string, failures long, refused long"
    return calls.groupBy(provider).applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)
