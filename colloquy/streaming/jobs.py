"""Structured Streaming twins of the job-state operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("transcribing", "scanning", "awaiting_answers", "writing", "done", "error")


def deduplicated_parts(parts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """STR05: uploads come at least once; a part (upload_id, index) counts once within the watermark."""
    return parts.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["upload_id", "index"])


def latest_status(events: DataFrame, idle: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """STR02: the last state of each job, for update mode. events: job_id string, ts timestamp, state string.

    A job of which nothing is heard for the idle time, by the watermark, is forgotten, so that state doesn't grow for ever;
    a late event that is older than the last one changes nothing.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, at = state.get if state.exists else (None, -(2**62))
        rows = pd.concat(list(batches)).sort_values("ms", kind="stable")
        ms = int(rows["ms"].iloc[-1])
        if ms >= at:
            last, at = rows["state"].iloc[-1], ms
        state.update((last, at))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), at) + wait)
        yield pd.DataFrame({"job_id": [key[0]], "state": [last], "ms": [at]})

    # Milliseconds come from the JVM: pandas shows times in the session's zone, the watermark is in none.
    timed = events.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    found = timed.groupBy("job_id").applyInPandasWithState(step, "job_id string, state string, ms long", "state string, ms long", "update", "EventTimeTimeout")
    return found.select("job_id", "state", F.timestamp_millis("ms").alias("updated_at"))


#: STR04: seconds between looks at a list of jobs, a job and its model.
POLL = {"progress": 2.5, "list": 5.0, "status": 15.0}


def polled(stream: DataFrame, what: str):
    """STR04: a writer that looks for news at the interval of a view."""
    return stream.writeStream.trigger(processingTime=f"{POLL[what]} seconds")


def sessions(events: DataFrame, idle: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """STR03: spells of activity that end after an idle time; a spell comes out once the watermark passes it."""
    s = events.withWatermark("ts", delay).groupBy("job_id", F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("events"))
    return s.select("job_id", F.col("w.start").alias("began"), F.col("w.end").alias("idle_from"), "events")


def watch(spark, folder: str, schema: str) -> DataFrame:
    """STR06: bundles dropped into a folder as a stream; versions.hand_off puts them into a table, each batch once."""
    return spark.readStream.schema(schema).json(folder)
