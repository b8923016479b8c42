"""Windows, sessions, change batches, leases and circuit breakers over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F


def tumbling(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """Events and their value by window and type; on a stream, `late` bounds how long a window stays open."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Stretches of a user's events with no gap of that length."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def changes(events: DataFrame, late: str | None = None) -> DataFrame:
    """The types that changed in each second, sorted, comma-joined."""
    rows = events.withWatermark("ts", late) if late else events
    found = rows.groupBy(F.window("ts", "1 second").alias("w")).agg(F.collect_set("event_type").alias("topics"))  # few types
    return found.select(F.col("w.start").alias("start"), F.array_join(F.array_sort("topics"), ",").alias("topics"))


def once(events: DataFrame, late: str) -> DataFrame:
    """A stream's events, each id once within the time that late ones may take."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def stale(events: DataFrame, seconds: int) -> DataFrame:
    """Users' heartbeats that came later than their lease: the gap before each event, and whether it broke the lease."""
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(before.cast("timestamp"))
    return events.select("event_id", "user_id", gap.alias("gap_seconds"), F.coalesce(gap > seconds, F.lit(False)).alias("stale"))


def failure_runs(events: DataFrame, kind: str = "error", least: int = 5) -> DataFrame:
    """Unbroken runs of failures of a user, from the `least`-th on a breaker opens: user, first event, length, opened."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    island = F.count_if(F.col("event_type") != kind).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = events.withColumn("_island", island).filter(F.col("event_type") == kind)
    runs = rows.groupBy("user_id", "_island").agg(F.min(F.struct("ts", "event_id")).alias("first"), F.count("*").alias("length"))
    return runs.select("user_id", F.col("first.event_id").alias("first_event"), "length", (F.col("length") >= least).alias("opened"))


def breaker(events: DataFrame, limit: int = 5, open_seconds: int = 60) -> DataFrame:
    """A circuit breaker for each user of a stream: (user_id, event_id, state) after each event, in order of arrival.

    `limit` failures in a row open it; it stays open for `open_seconds` of event time, then lets one event try.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, opened = state.get if state.exists else (0, 0.0)
        for batch in batches:
            out = []
            for row in batch.sort_values(["ts", "event_id"]).itertuples():
                at = row.ts.timestamp()
                if failures >= limit and at < opened + open_seconds:
                    out.append((key[0], row.event_id, "open"))
                    continue
                if row.event_type == "error":
                    failures += 1
                    opened = at
                else:
                    failures = 0
                out.append((key[0], row.event_id, "open" if failures >= limit else "closed"))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "state"])
        state.update((failures, opened))

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, state string", "failures int, opened double", "append", "NoTimeout")
