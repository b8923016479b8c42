"""State changes as new tables: upserts, retention, time to live, versions, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerframe.operators.reports import latest


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """`old` with the last new row of each key in place of the old one."""
    last = latest(new, key, [F.col(order).desc()])
    return old.join(last.select(*key), key, "left_anti").unionByName(last)


def fresh(rows: DataFrame, by: list[str], at: str, now: Column, ttl: str) -> DataFrame:
    """The newest row of each key, if it isn't older than the time to live."""
    return latest(rows, by, [F.col(at).desc(), F.col("id").desc()]).filter(F.col(at) >= now - F.expr(f"interval {ttl}"))


def retained(pages: DataFrame, cited: DataFrame, key: str, at: str, cutoff: Column) -> DataFrame:
    """Pages that are young or cited."""
    return pages.join(pages.filter(F.col(at) < cutoff).select(key).join(cited, key, "left_anti"), key, "left_anti")


def versions(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Add `version` from 1, `active` for the newest, and `parent`, the id of the version before."""
    w = W.partitionBy(by).orderBy(*order)
    return rows.withColumn("version", F.row_number().over(w)).withColumn("parent", F.lag("id").over(w)).withColumn("active", F.lead("id").over(w).isNull())


def previous_run(runs: DataFrame, by: str, order: list[str], done: Column) -> DataFrame:
    """Add `previous`: the newest finished run of the same request before each."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return runs.withColumn("previous", F.last(F.when(done, F.col("id")), ignorenulls=True).over(w))


def is_new(rows: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Add `is_new`: a kept row whose key the previous run hasn't kept."""
    known = previous.filter("kept").select(F.col(key).alias("_key")).distinct()
    joined = rows.join(known, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("is_new", F.col("kept") & F.col("_key").isNull()).drop("_key")


def band(probability: Column, yes: float, no: float) -> Column:
    """yes, no, or null where a probability decides neither."""
    return F.when(probability >= yes, "yes").when(probability <= no, "no")


def decide(requests: DataFrame, tiers: list[tuple[str, Column]], default: str = "unknown") -> DataFrame:
    """Add `label` and `tier`: the first tier that has an answer decides."""
    label = F.coalesce(*[answer for _, answer in tiers], F.lit(default))
    tier = F.coalesce(*[F.when(answer.isNotNull(), name) for name, answer in tiers], F.lit("DEFAULT"))
    return requests.withColumn("label", label).withColumn("tier", tier)


def judged(requests: DataFrame, by: str, order: list[str], failed: Column, size: int = 20) -> DataFrame:
    """Add `batch` and `judged`: requests go in batches by order, and the first batch with a failure ends judging."""
    rows = requests.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1) / size).cast("int"))
    first = rows.filter(failed).groupBy(by).agg(F.min("batch").alias("first_failed"))
    return rows.join(first, by, "left").withColumn("judged", F.coalesce(F.col("batch") < F.col("first_failed"), F.lit(True))).drop("first_failed")
