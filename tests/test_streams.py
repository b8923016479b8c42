"""Leases, statuses and changes as streams: equal to ordered folds, also through restarts."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from ledgerframe.streaming import runs

START = dt.datetime(2026, 1, 1)
SCHEMA = "run string, ts timestamp, event_id long, event string, topic string, value string"


@pytest.fixture
def stream(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    runs.with_state(spark)

    class Stream:
        written = 0

        def feed(self, rows, make):
            """Write a file and run the stream over it, from the checkpoint on; all rows so far."""
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{self.written}")
            self.written += 1
            source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
            q = make(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
            return [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]

    yield Stream()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def plain_states(rows, now, lease=30, attempts=2):
    """One run after the other, one event after the other."""
    out = []
    for run in sorted({r[0] for r in rows}):
        status, attempt, heard = "queued", 0, None

        def silent(at):
            nonlocal status, heard
            if status in runs.BACK and at > heard + dt.timedelta(seconds=lease):
                status = runs.BACK[status] if attempt < attempts else "failed"
                out.append((run, heard + dt.timedelta(seconds=lease), status, attempt, "lease ended"))

        for _, ts, _, event, *_ in sorted((r for r in rows if r[0] == run), key=lambda r: (r[1], r[2])):
            silent(ts)
            if status in runs.BACK:
                heard = ts
            to = "cancelled" if event == "cancel" and status not in runs.ENDED else runs.MOVES.get((status, event))
            if to:
                attempt += event == "claim"
                status, heard = to, ts
                out.append((run, ts, to, attempt, event))
        silent(now)
    return sorted(out)


def test_runs_move_and_lose_their_leases(stream):
    rng, rows, now = random.Random(1), [], 0
    kinds = ["claim", "heartbeat", "plan", "ask", "ready", "approve", "complete", "fail", "cancel", "nonsense", None]
    make = lambda s: runs.run_states(s)
    for part in range(3):  # each part is a run of its own, from the checkpoint
        new = []
        for _ in range(120):
            now += rng.choice([0, 1, 2, 5, 20])
            event = rng.choices(kinds, [8, 6, 3, 2, 3, 3, 1, 0.5, 0.3, 1, 1])[0]
            new.append((f"r{rng.randrange(12)}", START + dt.timedelta(seconds=now), len(rows) + len(new), event, None, None))
        now += 100
        new.append(("clock", START + dt.timedelta(seconds=now), len(rows) + len(new), "heartbeat", None, None))
        rows += new
        got = stream.feed(new, make)
        assert sorted(got) == plain_states(rows, START + dt.timedelta(seconds=now)), part
    assert {"lease ended"} < {g[4] for g in got} and {"failed", "queued", "queued_run", "running"} <= {g[2] for g in got}


def plain_changes(rows, topics, end, alive=15):
    out = []
    for run in sorted({r[0] for r in rows}):
        values, told = {}, None
        seconds = defaultdict(dict)
        for _, ts, _, _, topic, value in sorted((r for r in rows if r[0] == run), key=lambda r: (r[1], r[2])):
            seconds[ts.replace(microsecond=0)][topic] = value
        for second in sorted(seconds):
            changed = sorted(t for t, v in seconds[second].items() if t not in values or values[t] != v)
            values.update(seconds[second])
            if told is None or changed:
                out.append((run, second, ",".join(sorted(topics) if told is None else changed)))
                told = second
    return sorted(out)


def test_only_changes_are_told(stream):
    rng, rows, now, topics = random.Random(2), [], 0, ("events", "metrics", "run")
    make = lambda s: runs.changed_topics(s, topics)
    for part in range(2):
        new = []
        for _ in range(80):
            now += rng.choice([0, 0.3, 1, 4])
            new.append((f"r{rng.randrange(4)}", START + dt.timedelta(seconds=now), len(rows) + len(new), None, rng.choice(topics), rng.choice(["1", "2", None])))
        rows += new
        now = int(now) + 2
        got = stream.feed(new, make)
        assert sorted(g for g in got if g[2]) == plain_changes(rows, topics, START), part
    quiet = [("other", START + dt.timedelta(seconds=now + 40), len(rows), None, "run", "x")]
    alive = {g for g in stream.feed(quiet, make) if not g[2]}
    last = {r: max(g[1] for g in got if g[0] == r and g[2]) for r in {g[0] for g in got}}
    assert {(r, at + dt.timedelta(seconds=15), "") for r, at in last.items()} <= alive | {g for g in got if not g[2]}


def test_changes_ask_the_state_once():
    import pandas as pd

    from ledgerframe.streaming import runs

    class Told:
        held, calls = None, 0
        exists = lambda self: self.held is not None
        def update(self, v): self.held = v  # noqa: E704

    class Values(dict):
        calls = 0
        def iterator(self):
            self.calls += 1
            return iter(list(self.items()))
        def updateValue(self, k, v):
            self.calls += 1
            self[k] = v

    class Handle:
        values, told = Values(), Told()
        getMapState = lambda self, *_: self.values
        getValueState = lambda self, *_: self.told
        listTimers = lambda self: iter(())
        registerTimer = lambda self, at: None

    handle, made = Handle(), runs._Changes(("a", "b"), 10)
    made.init(handle)
    events = lambda start, n: pd.DataFrame({"ts": pd.to_datetime([1_000 * (start + k) for k in range(n)], unit="ms"), "event_id": range(n), "topic": ["a", "b"] * (n // 2), "value": [str(k // 4) for k in range(n)]})
    first = pd.concat(list(made.handleInputRows(("r",), iter([events(0, 1_000)]), None)))
    assert first["topics"].tolist()[:4] == ["a,b", "b", "a", "b"] and len(first) == 500 and handle.values == {("a",): ("249",), ("b",): ("249",)}
    again = pd.concat(list(made.handleInputRows(("r",), iter([events(1_000, 4)]), None)))
    assert again["topics"].tolist() == ["a", "b"] and handle.values.calls <= 6
