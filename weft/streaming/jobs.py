"""Job events as streams: late and repeated events, state per run, silent nodes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id bigint, job_id bigint, run_id bigint, node_id bigint, status string, at timestamp"


def events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """JSON event files as they come; folders may hold any number of them."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).json(path)


def once(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once; repeats that come later than ``late`` after it are not held in state any more."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def per_window(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, status, n): events per time window and status, emitted when the watermark has passed the window."""
    status = F.lower(F.trim("status"))
    return stream.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), status.alias("status")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def job_states(stream: DataFrame) -> DataFrame:
    """(run_id, status, n_jobs): the status of each run whenever one of its jobs changes.

    State is one entry per job of a run that is not over; the last event by time decides, whatever order they come in.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs, stamps, names = state.get if state.exists else ([], [], [])
        known = dict(zip(jobs, zip(stamps, names, strict=True), strict=True))
        for frame in frames:
            for job, at, status in zip(frame.job_id, frame["at"], frame.status, strict=True):
                stamp = int(pd.Timestamp(at).value)
                if int(job) not in known or known[int(job)][0] <= stamp:
                    known[int(job)] = (stamp, str(status).strip().lower())
        state.update((list(known), [x[0] for x in known.values()], [x[1] for x in known.values()]))
        have = {x[1] for x in known.values()}
        status = next((s for s in ("running", "queued", "failed", "cancelled") if s in have), "succeeded" if have == {"succeeded"} else "created")
        yield pd.DataFrame({"run_id": [key[0]], "status": [status], "n_jobs": [len(known)]})

    kept = stream.where("run_id is not null and job_id is not null")
    return kept.groupBy("run_id").applyInPandasWithState(update, "run_id bigint, status string, n_jobs bigint", "jobs array<bigint>, stamps array<bigint>, names array<string>", "update", GroupStateTimeout.NoTimeout)


def silent_nodes(beats: DataFrame, silence_ms: int, late: str = "1 minute") -> DataFrame:
    """(node_id, last, status): alive at each heartbeat; offline once the watermark is ``silence_ms`` past the last one."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"node_id": [key[0]], "last": [pd.Timestamp(last, unit="ms")], "status": ["offline"]})
            return
        last = max([state.get[0] if state.exists else 0, *(int(pd.Timestamp(x).value // 1_000_000) for f in frames for x in f["at"])])
        state.update((last,))
        state.setTimeoutTimestamp(max(last + silence_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"node_id": [key[0]], "last": [pd.Timestamp(last, unit="ms")], "status": ["alive"]})

    kept = beats.where("node_id is not null").withWatermark("at", late)
    return kept.groupBy("node_id").applyInPandasWithState(update, "node_id bigint, last timestamp, status string", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
