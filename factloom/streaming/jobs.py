"""Job state and event windows over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Order of states; states from the fourth on end a job and never change.
STATES = ("queued", "downloading", "scanning", "done", "failed", "skipped", "canceled")
TERMINAL = STATES[3:]
_LEVEL = {s: min(i, 3) for i, s in enumerate(STATES)}


def next_state(state: str | None, status: str | None) -> str | None:
    """The state after an event: never back, never on from an end; unknown states change nothing."""
    if status not in _LEVEL:
        return state
    if state is None:
        return status
    if state in TERMINAL or _LEVEL[status] < _LEVEL[state]:
        return state
    return status


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status, n_events) after every change, from a stream of (job_id, seq, status).

    Events of a batch are taken by their number; repeated and late ones change
    nothing once a job has moved on. The state of a job is one short row.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else (None, 0)
        before = status
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for word in rows["status"]:
            status, n = next_state(status, word), n + 1
        if status is not None:
            state.update((status, n))
        if status != before:
            yield pd.DataFrame({"job_id": [key[0]], "status": [status], "n_events": [n]})

    return events.select("job_id", "seq", "status").where("job_id is not null").groupBy("job_id").applyInPandasWithState(
        run, "job_id string, status string, n_events bigint", "status string, n bigint", "update", GroupStateTimeout.NoTimeout
    )


def latest_states(events: DataFrame) -> DataFrame:
    """The same from a table: the state of each job after all its events."""
    known = events.where(F.col("status").isin(*STATES) & F.col("job_id").isNotNull())
    level = F.least(F.array_position(F.array(*map(F.lit, STATES)), F.col("status")), F.lit(4))
    ended = F.min_by("status", F.when(level == 4, F.struct("seq", "status")))
    open_ = F.max_by("status", F.struct(level.alias("l"), "seq"))
    return known.groupBy("job_id").agg(
        F.coalesce(F.when(F.max(level) == 4, ended), open_).alias("status"), F.count(F.lit(1)).alias("n_events")
    )


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by event-time window; events later than ``late`` after the newest are dropped when streaming."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        "w.start", "w.end", *keys, "n"
    )


def upsert(target: str, key: str, order: str):
    """A ``foreachBatch`` function that keeps the latest row of each key in a table of folders, one for each batch.

    A batch that is delivered again overwrites its own folder, so a restart changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{target}/batch={number:012d}")

    return run


def read_upserted(spark, target: str, key: str, order: str) -> DataFrame:
    """The latest row of each key of what ``upsert`` wrote."""
    rows = spark.read.option("basePath", target).parquet(f"{target}/batch=*")
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, "batch")).alias("r")).select("r.*")


def event_lines(jobs: DataFrame, kind: str = "job") -> DataFrame:
    """(value): each row of ``jobs`` as an event in JSON: its type, and the job."""
    return jobs.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*jobs.columns).alias("job"))).alias("value"))


def write_events(jobs: DataFrame, target: str, checkpoint: str, kind: str = "job"):
    """Start a stream of ``event_lines`` into text files, a folder for each batch.

    Nothing is dropped for slow readers, and a batch that is delivered again
    overwrites its own folder: every event stands there once. The query is
    returned; it takes what is there and ends.
    """

    def run(batch: DataFrame, number: int) -> None:
        event_lines(batch, kind).write.mode("overwrite").text(f"{target}/batch={number:012d}")

    return jobs.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()
