"""Runs as streams with state and timers: leases and statuses of runs, and what has changed about them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# What each event makes of a status; statuses in which a worker holds the run, and where the run goes back to
# when its worker is silent; statuses that end a run.
MOVES = {
    ("queued", "claim"): "compiling", ("compiling", "plan"): "planning", ("compiling", "ask"): "awaiting_approval", ("planning", "ask"): "awaiting_approval",
    ("compiling", "ready"): "queued_run", ("planning", "ready"): "queued_run", ("awaiting_approval", "approve"): "queued_run",
    ("queued_run", "claim"): "running", ("running", "complete"): "completed", ("compiling", "fail"): "failed", ("planning", "fail"): "failed", ("running", "fail"): "failed",
}
BACK = {"compiling": "queued", "planning": "queued", "running": "queued_run"}
ENDED = ("completed", "failed", "cancelled")
#: Seconds of silence that end a lease, attempts of a run, seconds between signs of life, how late an event may be.
LEASE, ATTEMPTS, ALIVE, LATE = 30, 2, 15, "0 seconds"

STATES = "run string, at timestamp, status string, attempt int, cause string"
TOPICS = "run string, at timestamp, topics string"


class Run:
    """A run's status, the attempts that were claimed, and when its worker was last heard of (milliseconds, 0 without a worker)."""

    def __init__(self, status: str = "queued", attempt: int = 0, heard: int = 0):
        self.status, self.attempt, self.heard = status, attempt, heard

    def expire(self, now: int, lease: int, attempts: int) -> Iterator[tuple[int, str, int, str]]:
        """What becomes of a lease that ended before `now`: back to its queue, or failed after the last attempt."""
        if self.status in BACK and now > self.heard + lease:
            at = self.heard + lease
            self.status = BACK[self.status] if self.attempt < attempts else "failed"
            self.heard = 0
            yield at, self.status, self.attempt, "lease ended"

    def take(self, at: int, event: str, lease: int, attempts: int) -> Iterator[tuple[int, str, int, str]]:
        """An event, after what has happened before it; events that a status doesn't know change nothing."""
        yield from self.expire(at, lease, attempts)
        if self.status in BACK:
            self.heard = max(self.heard, at)
        to = "cancelled" if event == "cancel" and self.status not in ENDED else MOVES.get((self.status, event))
        if to:
            self.attempt += event == "claim"
            self.status, self.heard = to, at if to in BACK else 0
            yield at, to, self.attempt, event


def _millis(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[ms]").astype("int64")


def _frame(run: str, rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame([(run, pd.Timestamp(r[0], unit="ms"), *r[1:]) for r in rows], columns=["run", "at", *columns])
    return out.astype({"attempt": "int32"}) if "attempt" in out else out


class _Leases(StatefulProcessor):
    def __init__(self, lease: int, attempts: int):
        self.lease, self.attempts = lease * 1_000, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string")
        self.held = handle.getValueState("lease", "attempt int, heard long")

    def _run(self) -> Run:
        return Run(self.status.get()[0], *self.held.get()) if self.status.exists() else Run()

    def _keep(self, run: Run) -> None:
        self.status.update((run.status,))
        self.held.update((run.attempt, run.heard))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if run.status in BACK:
            self.handle.registerTimer(run.heard + self.lease + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        events = events.assign(_at=_millis(events["ts"])).sort_values(["_at", "event_id"])
        run, out = self._run(), []
        for at, event in zip(events["_at"].tolist(), events["event"].tolist()):
            out += run.take(at, event, self.lease, self.attempts)
        self._keep(run)
        yield _frame(key[0], out, ["status", "attempt", "cause"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run = self._run()
        out = list(run.expire(expiredTimerInfo.getExpiryTimeInMs(), self.lease, self.attempts))
        self._keep(run)
        yield _frame(key[0], out, ["status", "attempt", "cause"])

    def close(self) -> None:
        pass


def run_states(events: DataFrame, lease: int = LEASE, attempts: int = ATTEMPTS, late: str = LATE) -> DataFrame:
    """Every change of status of each run of a stream (run, ts, event_id, event): run, at, status, attempt, cause.

    Runs start queued. A lease that ends, because nothing was heard for `lease` seconds, gives the run back to its queue, or
    fails it after so many claims; it does so when the watermark has passed, also where no event follows. Events of a
    run are taken in order of time within a batch, batches in order of arrival; null events change nothing. The stream
    goes on from its checkpoint with all statuses and timers. Needs the RocksDB state store.
    """
    rows = events.select("run", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event").filter("run is not null and ts is not null").withWatermark("ts", late)
    return rows.groupBy("run").transformWithStateInPandas(_Leases(lease, attempts), STATES, "append", "eventTime")


class _Changes(StatefulProcessor):
    def __init__(self, topics: tuple[str, ...], alive: int):
        self.topics, self.alive = topics, alive * 1_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "topic string", "value string")
        self.told = handle.getValueState("told", "at long")

    def _tell(self, at: int) -> None:
        self.told.update((at,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at + self.alive)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        found = found.assign(_at=_millis(found["ts"])).sort_values(["_at", "event_id"])
        out, first = [], not self.told.exists()
        # The state is asked once and told once, however many events come: each call of it is a message to another process.
        known = {} if first else {key[0]: value[0] for key, value in self.values.iterator()}
        new = {}
        seconds = (found["_at"] // 1_000 * 1_000).tolist()
        for second, part in groupby(zip(seconds, found["topic"].tolist(), found["value"].tolist()), key=lambda x: x[0]):
            last = {topic: value for _, topic, value in part}
            changed = [t for t, v in last.items() if t not in known or known[t] != v]
            for t in changed:
                known[t] = new[t] = last[t]
            if first or changed:
                out.append((second, ",".join(sorted(self.topics if first else changed))))
                first = False
        for t, v in new.items():
            self.values.updateValue((t,), (v,))
        if out:
            self._tell(out[-1][0])
        yield _frame(key[0], out, ["topics"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self._tell(at)
        yield _frame(key[0], [(at, "")], ["topics"])

    def close(self) -> None:
        pass


def changed_topics(snapshots: DataFrame, topics: tuple[str, ...], alive: int = ALIVE, late: str = LATE) -> DataFrame:
    """What has changed about each run of a stream (run, ts, event_id, topic, value), once a second: run, at, topics.

    A run's first message names all topics; later ones those whose last value of the second differs from the one before
    it, sorted, and nothing is sent where none does. After `alive` seconds without a message one without topics says that
    the stream is alive. Values are kept through restarts. Needs the RocksDB state store.
    """
    rows = snapshots.select("run", F.col("ts").cast("timestamp").alias("ts"), "event_id", "topic", "value").filter("run is not null and ts is not null and topic is not null").withWatermark("ts", late)
    return rows.groupBy("run").transformWithStateInPandas(_Changes(topics, alive), TOPICS, "append", "eventTime")


def with_state(spark) -> None:
    """Set the session's state store to the one that timers and several states need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
