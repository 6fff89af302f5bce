"""STR01, STR03: state with timers, by transformWithState.

Both need the RocksDB state store: spark.sql.streaming.stateStore.providerClass = PROVIDER. Classes are made inside functions,
so that executors get them with the plan. Milliseconds come from the JVM, as the watermark knows no time zone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def state_changes(events: DataFrame, most: int = 40, delay: str = "10 minutes", idle: str = "7 days") -> DataFrame:
    """STR01, TOP12: the changes of each job's state (job_id, at, state, changes, history), in the order of their times.

    events: job_id string, ts timestamp, state string; append mode. Events wait until the watermark has passed them, so those that come
    late, in whatever batch, still take their place (later ones than the watermark are dropped); of events of one time the
    name decides. A repeat of the state adds nothing. changes counts all, history is the last ones. A job of which
    nothing is heard for the idle time is forgotten.
    """
    wait = _ms(idle)

    class Changes(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "ms long, state string")
            self.known = handle.getValueState("known", "changes long, heard long, history array<string>")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            for part in rows:
                for ms, state in zip(part["ms"], part["state"], strict=True):
                    self.waiting.appendValue((int(ms), state))
                    self.handle.registerTimer(int(ms))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = expiredTimerInfo.getExpiryTimeInMs()
            waiting = sorted(self.waiting.get(), key=lambda w: (w[0], w[1] or ""))
            changes, heard, history = self.known.get() if self.known.exists() else (0, 0, [])
            history, out = list(history), []
            due = [w for w in waiting if w[0] <= now]
            for ms, state in due:
                if ms >= heard + wait:
                    changes, history = 0, []
                heard = ms
                if not history or history[-1] != state:
                    changes, history = changes + 1, [*history, state][-most:]
                    out.append((key[0], ms, state, changes, list(history)))
            if due:
                left = waiting[len(due) :]
                self.waiting.put(left) if left else self.waiting.clear()
                self.known.update((changes, heard, history))
                self.handle.registerTimer(heard + wait)
            elif now >= heard + wait:
                self.known.clear()
            if out:
                yield pd.DataFrame(out, columns=["job_id", "ms", "state", "changes", "history"])

        def close(self) -> None:
            pass

    timed = events.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    found = timed.groupBy("job_id").transformWithStateInPandas(Changes(), "job_id string, ms long, state string, changes long, history array<string>", "Append", "EventTime")
    return found.select("job_id", F.timestamp_millis("ms").alias("at"), "state", "changes", "history")


def idle_ejects(activity: DataFrame, idle: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """STR03: models that nothing has used for the idle time (model, at, action, jobs): `eject`, or `held` while jobs are active.

    activity: model string, job_id string, ts timestamp, active boolean; append mode. Activity puts the timer off; a timer that finds newer activity
    says nothing; one that finds active jobs holds, and the activity that ends them starts a new one. A job is
    active by its latest event, so late ones change nothing that is newer.
    """
    wait = _ms(idle)

    class Idle(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.latest = handle.getValueState("latest", "ms long")
            self.jobs = handle.getMapState("jobs", "job string", "ms long, active boolean")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            latest = self.latest.get()[0] if self.latest.exists() else -(2**62)
            for part in rows:
                for job, ms, active in zip(part["job_id"], part["ms"], part["active"], strict=True):
                    job, ms = (job or "",), int(ms)
                    if not self.jobs.containsKey(job) or self.jobs.getValue(job)[0] <= ms:
                        self.jobs.updateValue(job, (ms, bool(active)))
                    latest = max(latest, ms)
            self.latest.update((latest,))
            self.handle.registerTimer(latest + wait)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = expiredTimerInfo.getExpiryTimeInMs()
            if not self.latest.exists() or self.latest.get()[0] + wait > now:
                return
            active = sorted(job[0] for job, (_, on) in self.jobs.iterator() if on)
            if not active:  # nothing is known of the model until it is used again
                self.jobs.clear()
                self.latest.clear()
            yield pd.DataFrame({"model": [key[0]], "ms": [now], "action": ["held" if active else "eject"], "jobs": [active]})

        def close(self) -> None:
            pass

    timed = activity.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    found = timed.groupBy("model").transformWithStateInPandas(Idle(), "model string, ms long, action string, jobs array<string>", "Append", "EventTime")
    return found.select("model", F.timestamp_millis("ms").alias("at"), "action", "jobs")
