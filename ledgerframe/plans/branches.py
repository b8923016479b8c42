"""Branches that may fail: sources read side by side, each failure an event, their rows as far as they go; more rounds of them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

from ledgerframe.operators import criteria as c
from ledgerframe.plans import compiler
from ledgerframe.session import materialise

#: Branches whose jobs run at the same time, characters of a message that an event keeps, extra rounds.
AT_ONCE, MESSAGE, ROUNDS = 4, 300, 2

EVENTS = "branch string, kind string, message string, rows long"

Branch = Callable[[], DataFrame]


class AllFailed(RuntimeError):
    """No branch could be read."""


class Outcome(NamedTuple):
    """What the branches gave: their rows (None if none gave any), and events: branch, kind (failed or rows), message, rows."""

    rows: DataFrame | None
    events: DataFrame
    failed: int


def broken(rows: DataFrame, error) -> DataFrame:
    """Rows with what is wrong with them in `error`, null where nothing is: `collect` leaves those out and counts them."""
    return rows.withColumn("error", error)


def _message(e: BaseException) -> str:
    return f"{type(e).__name__}: {e}".splitlines()[0][:MESSAGE]


def collect(spark: SparkSession, branches: dict[str, Branch]) -> Outcome:
    """Read each branch by itself and write what it gives, AT_ONCE at a time; columns that a branch lacks are null.

    A branch that can't be built or read is an event, and the others go on. Rows that carry an error (`error`, not null) are
    left out and counted by message in events; a branch with nothing but such rows has failed too. If every branch fails,
    AllFailed says why. No branches give no rows.
    """

    def read(item: tuple[str, Branch]) -> tuple[str, DataFrame | None, list[tuple]]:
        name, build = item
        try:
            rows = materialise(build(), "branch")
            if "error" not in rows.columns:
                return name, rows, []
            wrong = rows.filter("error is not null").groupBy(F.substring("error", 1, MESSAGE).alias("message")).agg(F.count("*").alias("n"))
            told = [(name, "rows", r["message"], r["n"]) for r in wrong.orderBy(F.desc("n"), "message").limit(100).collect()]
            good = rows.filter("error is null").drop("error")
            if told and good.isEmpty():
                return name, None, [*told, (name, "failed", "no row of it could be read", None)]
            return name, good, told
        except Exception as e:  # whatever a source throws, in a task or while it is planned
            return name, None, [(name, "failed", _message(e), None)]

    with ThreadPoolExecutor(AT_ONCE) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(read), branches.items()))
    told = [e for _, _, events in done for e in events]
    good = [rows for _, rows, _ in done if rows is not None]
    failed = len(done) - len(good)
    if done and failed == len(done):
        first = next(m for _, kind, m, _ in told if kind == "failed")
        raise AllFailed(first if failed == 1 else f"none of the {failed} branches could be read; first: {first}")
    return Outcome(compiler.collect(good) if good else None, spark.createDataFrame(told, EVENTS), failed)


def run(spark: SparkSession, contract: c.Contract, branches: dict[str, Branch]) -> tuple[DataFrame, DataFrame]:
    """`compiler.run` over branches that may fail: the run's rows and its events."""
    outcome = collect(spark, branches)
    return compiler.run(contract, [outcome.rows]), outcome.events


def run_in_rounds(spark: SparkSession, contract: c.Contract, first: dict[str, Branch], find: Callable[[int, DataFrame], dict[str, Branch]], most: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """`run`, then again with what `find(round, rows so far)` brings while there are fewer valid rows than the contract wants.

    There are `most` extra rounds at most; a round that finds no new branch, or can't look, is the last, and the rows so
    far count. Branches read once aren't read again: each round writes its own, and only the judging sees all of them.
    """
    outcome = collect(spark, first)
    known, parts, events = set(first), [outcome.rows], [outcome.events]
    rows = compiler.run(contract, parts)
    wanted = compiler.normalize(contract).most
    for number in range(2, most + 2):
        if rows.filter("status = 'valid' and duplicate_of is null").limit(wanted).count() >= wanted:
            break
        try:
            more = {name: b for name, b in find(number, rows).items() if name not in known}
            outcome = collect(spark, more) if more else None
        except Exception as e:
            events.append(spark.createDataFrame([(f"round {number}", "failed", _message(e), None)], EVENTS))
            break
        if outcome is None:
            break
        known |= set(more)
        events.append(outcome.events)
        parts.append(outcome.rows)
        rows = compiler.run(contract, parts)
    return rows, reduce(DataFrame.unionByName, events)


def search_rounds(search: Callable[[DataFrame, int, int], tuple[DataFrame, int]], planned: DataFrame, budget: int, most: int = 5) -> DataFrame:
    """Refs that rounds of searching find beside the planned ones (ref): ref, round, each once.

    `search(fresh refs of the round before, round, searches it may use)` returns refs (with repeats, known ones too) and how
    many searches it used. A round gets half of what is left of the budget, rounded up, and the last one all of it. Only
    the fresh refs of a round are written and searched on; it ends when a round finds none, the budget is used, or after
    `most` rounds.
    """
    seen, fresh, found = materialise(planned.select("ref").distinct(), "rounds-seen"), None, []
    fresh = seen
    for number in range(1, most + 1):
        share = budget if number == most else -(-budget // 2)
        if share <= 0:
            break
        refs, used = search(fresh, number, share)
        budget -= min(used, share)
        fresh = materialise(refs.select("ref").filter("ref is not null").distinct().join(seen, "ref", "left_anti"), "rounds-fresh")
        if fresh.isEmpty():
            break
        found.append(fresh.withColumn("round", F.lit(number)))
        seen = seen.union(fresh)
    return reduce(DataFrame.unionByName, found) if found else seen.limit(0).withColumn("round", F.lit(0))
