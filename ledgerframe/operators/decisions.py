"""Decisions in tiers: what a request is known by, answers that may be used again, bands, modes, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Thresholds of a task without calibration, and modes from cautious to bold.
BAND, MODES = (0.8, 0.2), ("off", "shadow", "active")
REUSABLE = ("DECIDER", "LLM")


def input_hash(parts: dict[str, Column]) -> Column:
    """SHA-256 of a request's parts as JSON with sorted keys, so that equal requests meet whatever the order of their parts."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def reused(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Requests (hash, labels) with the newest answer to the same input: `cached`, null without one.

    Only reusable answers of a model or a judge count, and only labels that the request allows.
    """
    known = decisions.filter(F.col("reusable") & F.col("decided_by").isin(*REUSABLE))
    newest = known.groupBy("hash").agg(F.max_by("label", F.struct("created_at", "id")).alias("_cached"))
    met = requests.join(newest, "hash", "left")
    return met.withColumn("cached", F.when(F.array_contains("labels", F.col("_cached")), F.col("_cached"))).drop("_cached")


def choice(probabilities: Column, labels: list[str], least: float = 0.75) -> Column:
    """The likeliest allowed option of a map of probabilities (the first by name on ties), if it is likely enough."""
    allowed = F.filter(F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("label"))), lambda e: e["label"].isin(*labels))
    best = F.array_min(allowed)
    return F.when(-best["p"] >= least, best["label"])


def leaning(probability: Column) -> Column:
    """What a model leans to where it doesn't decide: (label, confidence)."""
    return F.when(probability.isNotNull(), F.struct(F.when(probability >= 0.5, "yes").otherwise("no").alias("label"), (F.abs(probability - 0.5) * 2).alias("confidence")))


def whole_batches(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (batch, id, label) that decide, and whether they may be used again.

    An answer decides if its request (batch, id, labels) has that label, whatever the case. A batch is reusable if it answers each
    of its requests once and nothing else.
    """
    asked = requests.groupBy("batch").agg(F.count("*").alias("asked"))
    given = answers.groupBy("batch").agg(F.count("*").alias("given"))
    label = F.lower(F.trim("label"))
    valid = answers.join(requests, ["batch", "id"]).withColumn("label", F.get(F.filter("labels", lambda x: F.lower(x) == label), F.lit(0))).filter("label is not null")
    first = valid.groupBy("batch", "id").agg(F.first("label").alias("label"))
    good = first.groupBy("batch").agg(F.count("*").alias("good"))
    whole = asked.join(given, "batch").join(good, "batch").select("batch", ((F.col("asked") == F.col("given")) & (F.col("asked") == F.col("good"))).alias("reusable"))
    return first.join(whole, "batch").select("batch", "id", "label", "reusable")


def task_thresholds(requests: DataFrame, calibrated: DataFrame, mode: str = "active") -> DataFrame:
    """Requests (task) with `yes`, `no` and `mode` of their task's calibration (task, yes, no, mode); calibration only makes the mode more cautious."""
    rank = lambda c: F.coalesce(*[F.when(c == m, i) for i, m in enumerate(MODES)])
    saved = calibrated.select("task", F.col("yes").alias("_yes"), F.col("no").alias("_no"), rank(F.col("mode")).alias("_mode"))
    met = requests.join(saved, "task", "left")
    least = F.least(F.coalesce("_mode", F.lit(len(MODES) - 1)), F.lit(MODES.index(mode)))
    return met.withColumns({"yes": F.coalesce("_yes", F.lit(BAND[0])), "no": F.coalesce("_no", F.lit(BAND[1])), "mode": F.get(F.array(*map(F.lit, MODES)), least)}).drop("_yes", "_no", "_mode")


def failure_class(kind: Column, status: Column, blocked: Column) -> Column:
    """Failures of fetching by what can be done about them; null kind is unknown."""
    return (
        F.when(kind.isNull(), "UNKNOWN").when(kind.isin("robots_disallowed", "ssrf_blocked"), "BLOCKED").when(kind == "budget_exhausted", "BUDGET")
        .when((kind == "http_status") & F.coalesce(blocked, F.lit(False)), "BLOCKED").when((kind == "http_status") & (status == 429), "RATE_LIMITED").otherwise("HTTP_ERROR")
    )


def replay_class(items: Column, text_length: Column, refused: Column) -> Column:
    """Failures of a recipe: no items on a page of almost no text is a page that wasn't rendered."""
    return F.when((items == 0) & (text_length < 500), "EMPTY_RENDER").otherwise(refused)


def repair(failure: Column, attempt: Column, via: Column) -> Column:
    """What to do about a failure where no judgement is needed, else null."""
    return (
        F.when(attempt > 2, "STOP").when(failure.isin("BLOCKED", "BUDGET"), "STOP").when(failure.isin("HTTP_ERROR", "RATE_LIMITED"), F.when(attempt > 1, "STOP").otherwise("RETRY"))
        .when(failure == "EMPTY_RENDER", F.when(via == "http", "SWITCH_TO_BROWSER").otherwise("ESCALATE"))
    )


def agreement(decisions: DataFrame) -> DataFrame:
    """How often a model's leaning (shadow) is what the judge decided, by task: compared, agreed."""
    both = decisions.filter("shadow is not null and tier = 'LLM'")
    return both.groupBy("task").agg(F.count("*").alias("compared"), F.count_if(F.col("shadow") == F.col("label")).alias("agreed"))


def samples(decisions: DataFrame, most: int = 25) -> DataFrame:
    """Decisions to look at, those that no rule made first."""
    return decisions.orderBy(F.when(F.col("tier") == "RULE", 1).otherwise(0), "id").limit(most)


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """What each call (model, input, output tokens) cost by a price list (model, input, output: for a million tokens); unknown models cost 0."""
    per = prices.select("model", F.col("input").alias("_in"), F.col("output").alias("_out"))
    cost = F.coalesce((F.col("input") * F.col("_in") + F.col("output") * F.col("_out")) / 1e6, F.lit(0.0))
    return calls.join(F.broadcast(per), "model", "left").withColumn("cost", cost).drop("_in", "_out")  # a price list names a few models
