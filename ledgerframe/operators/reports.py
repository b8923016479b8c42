"""Quality, funnel, difference and spending reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Edges of the confidence histogram; the last one lies beyond 1.
EDGES = (0.0, 0.5, 0.75, 0.9, 1.0001)


def _kept() -> Column:
    return F.col("duplicate_of").isNull() & (F.col("status") != "invalid")


def quality_totals(records: DataFrame) -> DataFrame:
    """Unique rows by status, and duplicates: one row."""
    unique = F.col("duplicate_of").isNull()
    return records.agg(
        F.count_if(unique).alias("n_unique"), *[F.count_if(unique & (F.col("status") == s)).alias(f"n_{s}") for s in ("valid", "incomplete", "invalid")], F.count_if(~unique).alias("n_duplicates")
    )


def completeness(records: DataFrame, fields: list[str]) -> DataFrame:
    """For each field: kept rows with a value, kept rows, and their share; 0 without rows."""
    kept = records.filter(_kept())
    sums = kept.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) != "").alias(f) for f in fields])
    rows = sums.select("total", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields])).alias("x"))
    return rows.select("x.field", "x.filled", "total", F.when(F.col("total") > 0, F.round(F.col("x.filled") / F.col("total"), 6)).otherwise(0.0).alias("rate"))


def method_mix(evidence: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """Values for each way, ways without any too, and the verified share."""
    every = evidence.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    found = evidence.groupBy("method").agg(F.count("*").alias("n"), F.avg(F.col("verified").cast("double")).alias("v"))
    return F.broadcast(every).join(found, "method", "left").select("method", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("v", F.lit(0.0)), 6).alias("verified_rate"))


def histogram(records: DataFrame) -> DataFrame:
    """Kept rows by confidence, half-open ranges, empty ones too."""
    bucket = F.coalesce(*[F.when((F.col("confidence") >= a) & (F.col("confidence") < b), i) for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]))])
    sums = records.filter(_kept()).agg(*[F.count_if(bucket == i).alias(f"b{i}") for i in range(len(EDGES) - 1)])
    ranges = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(min(b, 1.0)).alias("high"), F.col(f"b{i}").alias("n")) for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]))])
    return sums.select(F.inline(ranges))


def reject_reasons(records: DataFrame, most: int = 10) -> DataFrame:
    """The commonest reasons of unique rows that aren't valid; ties go to the one seen first."""
    rows = records.filter("duplicate_of is null and status <> 'valid'").select("ord", F.explode("reasons").alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first").limit(most).select("reason", "n")


def by_source(records: DataFrame) -> DataFrame:
    """Kept, valid and duplicate rows of each source."""
    return records.groupBy("source").agg(F.count_if(_kept()).alias("kept"), F.count_if(F.col("duplicate_of").isNull() & (F.col("status") == "valid")).alias("valid"), F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates"))


def difference(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each key of two runs as added, removed, changed or unchanged, and the changed fields, comma-joined."""
    b, a = before.select(F.col(key), F.lit(True).alias("in_b"), *[F.col(f).alias(f"b_{f}") for f in fields]), after.select(F.col(key), F.lit(True).alias("in_a"), *[F.col(f).alias(f"a_{f}") for f in fields])
    both = b.join(a, key, "full_outer")
    changed = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), f) for f in fields])), ",")
    kind = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(changed != "", "changed").otherwise("unchanged")
    return both.select(key, kind.alias("kind"), F.when(kind == "changed", changed).otherwise("").alias("fields"))


def difference_counts(differences: DataFrame) -> DataFrame:
    """How many keys of `difference` were added, removed, changed and unchanged: one row."""
    return differences.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "changed", "unchanged")])


def difference_values(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each changed field of the keys that both runs have: key, field, before, after (as JSON; missing and null are one)."""
    pair = lambda f: F.struct(F.lit(f).alias("field"), F.to_json(F.struct(F.col(f"b_{f}").alias("v"))).alias("before"), F.to_json(F.struct(F.col(f"a_{f}").alias("v"))).alias("after"))
    b, a = before.select(key, *[F.col(f).alias(f"b_{f}") for f in fields]), after.select(key, *[F.col(f).alias(f"a_{f}") for f in fields])
    rows = b.join(a, key).select(key, F.explode(F.filter(F.array(*map(pair, fields)), lambda x: x["before"] != x["after"])).alias("x"))
    return rows.select(key, "x.field", *[F.get_json_object(f"x.{s}", "$.v").alias(s) for s in ("before", "after")])


def difference_lists(differences: DataFrame, key: str, order: str, most: int = 50) -> DataFrame:
    """The first `most` keys of each kind but the unchanged; the counts tell of all."""
    ranked = differences.filter("kind <> 'unchanged'").withColumn("place", F.row_number().over(W.partitionBy("kind").orderBy(order)))
    return ranked.filter(F.col("place") <= most).select("kind", key, "fields", "place")


def funnel(records: DataFrame, raw: DataFrame) -> DataFrame:
    """One row for each group: collected, qualified, complete, ready, and the step that lost most (the earlier on ties).

    `raw` (group, raw) counts what was read before anything was stored.
    """
    qualified, complete = ~F.col("failed_hard"), F.col("status") == "valid"
    sums = records.groupBy("group").agg(F.count("*").alias("stored"), F.count_if(qualified).alias("qualified"), F.count_if(qualified & complete).alias("complete"), F.count_if(qualified & complete & F.col("duplicate_of").isNull()).alias("ready"))
    rows = sums.join(raw, "group", "left").withColumn("collected", F.greatest(F.coalesce("raw", F.lit(0)), "stored"))
    losses = [("qualified", F.col("stored") - F.col("qualified")), ("complete", F.col("qualified") - F.col("complete")), ("ready", F.col("complete") - F.col("ready"))]
    worst = F.greatest(*[n for _, n in losses])
    step = F.coalesce(*[F.when((n == worst) & (n > 0), name) for name, n in losses])
    return rows.select("group", "collected", "qualified", "complete", "ready", step.alias("loss_step"), worst.alias("loss"))


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def decision_summary(decisions: DataFrame, tiers: tuple[str, ...]) -> DataFrame:
    """Decisions of each task by tier."""
    return decisions.groupBy("task").agg(F.count("*").alias("n"), *[F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in tiers])


def calibration(samples: DataFrame, yes: list[float], no: list[float], precision: float = 0.9, least: int = 5) -> DataFrame:
    """The thresholds that decide most samples (probability, truth) with precision on both sides: one row, or none.

    All pairs of thresholds are counted in one pass over the samples.
    """
    p, t = F.col("probability"), F.col("truth")
    sums = samples.agg(
        F.count("*").alias("total"),
        *[x for i, y in enumerate(yes) for x in (F.count_if(p >= y).alias(f"y{i}"), F.count_if((p >= y) & t).alias(f"yt{i}"))],
        *[x for j, n in enumerate(no) for x in (F.count_if(p <= n).alias(f"n{j}"), F.count_if((p <= n) & ~t).alias(f"nt{j}"))],
    )
    grid = F.array(*[F.struct(F.lit(y).alias("yes"), F.lit(n).alias("no"), F.col(f"y{i}").alias("y"), F.col(f"yt{i}").alias("yt"), F.col(f"n{j}").alias("n"), F.col(f"nt{j}").alias("nt")) for i, y in enumerate(yes) for j, n in enumerate(no)])
    rows = sums.select("total", F.inline(grid)).filter((F.col("y") + F.col("n") >= least) & (F.col("yt") >= precision * F.col("y")) & (F.col("nt") >= precision * F.col("n")) & (F.col("y") > 0) & (F.col("n") > 0))
    best = rows.withColumn("coverage", F.round((F.col("y") + F.col("n")) / F.col("total"), 6))
    return best.orderBy(F.desc("coverage"), "yes", F.desc("no")).limit(1).select("yes", "no", "coverage", F.col("y").alias("n_yes"), F.col("n").alias("n_no"))


def run_costs(runs: DataFrame, costs: list[DataFrame]) -> DataFrame:
    """What each run cost: the sums of several lists of costs (run, cost), summed each for itself before they meet; 0 without any."""
    found = runs.select("run")
    for i, rows in enumerate(costs):
        found = found.join(rows.groupBy("run").agg(F.sum("cost").alias(f"_{i}")), "run", "left")
    return found.select("run", F.round(sum((F.coalesce(f"_{i}", F.lit(0.0)) for i in range(len(costs))), F.lit(0.0)), 4).alias("cost"))


def rolling_spend(costs: DataFrame, hours: int = 24) -> DataFrame:
    """For each cost (id, ts, account, value): what its account spent in the hours up to it, itself included."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("account").orderBy("_t").rangeBetween(-hours * 3_600_000_000, 0)
    return costs.withColumn("_t", seconds).withColumn("spent", F.round(F.sum("value").over(w), 4)).drop("_t")


def within_budget(rows: DataFrame, by: list[str], order: list[str], cost: str, limit: float) -> DataFrame:
    """Add `allowed`: whether a row and those before it cost no more than the limit together."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("allowed", F.round(F.sum(cost).over(w), 6) <= limit)
