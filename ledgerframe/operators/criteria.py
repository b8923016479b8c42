"""Criteria with three-valued outcomes, scores, status and confidence."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# How far each way of obtaining a value is trusted, best way first.
PRIORS = {"API": 0.99, "JSON_LD": 0.95, "EMBEDDED_JSON": 0.93, "DOC_META": 0.90, "DOM": 0.88, "DERIVED": 0.85, "REGEX": 0.80, "LLM": 0.75, "SEARCH": 0.70}
METHODS = tuple(PRIORS)


@dataclass(frozen=True)
class Criterion:
    """One wish about a row. kind: keyword_any, keyword_none, equals, regex, tag, or decided (by a column elsewhere)."""

    id: str
    label: str
    kind: str
    fields: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    hard: bool = False
    weight: float = 1.0


@dataclass(frozen=True)
class Contract:
    """What a request asks for."""

    fields: tuple[str, ...]
    required: tuple[str, ...] = ()
    criteria: tuple[Criterion, ...] = ()
    keys: tuple[tuple[str, ...], ...] = ()
    urls: tuple[str, ...] = ()
    most: int = 200
    options: dict = field(default_factory=dict)


#: Characters that a pattern reads of a text; None for all of it. A contract that must read a prefix only sets the option pattern_chars.
PATTERN_CHARS = None


def keyword_pattern(words: tuple[str, ...]) -> str | None:
    """A pattern that finds any of the words at a word's start, whatever the case; None without words."""
    clean = [re.sub(r"([^\w\s])", r"\\\1", w.strip().lower()) for w in words if w.strip()]
    return rf"(?i)(?:^|[^a-z0-9])(?:{'|'.join(clean)})" if clean else None


def first_keyword(text: Column, words: tuple[str, ...]) -> Column:
    """The first of the words that a text has at a word's start, as the text writes it; null without one."""
    pattern = keyword_pattern(words)
    if pattern is None:
        return F.lit(None).cast("string")
    return F.nullif(F.regexp_replace(F.regexp_extract(text, pattern, 0), "(?i)^[^a-z0-9]", ""), F.lit(""))


def safe_pattern(pattern: str) -> bool:
    """Short, at most one unbounded repeat, no repeated group that repeats or alternates inside, and readable."""
    if len(pattern) > 200 or len(re.findall(r"(?<!\\)[*+]|\{\d+,\}", pattern)) > 1 or re.search(r"\([^)]*[*+|][^)]*\)[*+{]", pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def joined(fields: tuple[str, ...]) -> Column:
    """The fields' text, missing ones empty."""
    return F.concat_ws(" \n ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])


def outcome(c: Criterion, pattern_chars: int | None = PATTERN_CHARS) -> Column:
    """TRUE, FALSE, or NULL where the criterion can't tell. Missing text counts as empty for patterns, as unknown for equality and tags."""
    unknown = F.lit(None).cast("boolean")
    if c.kind in ("keyword_any", "keyword_none"):
        pattern = keyword_pattern(c.values)
        hit = joined(c.fields).rlike(pattern) if pattern else unknown
        return ~hit if c.kind == "keyword_none" else hit
    if c.kind == "equals":
        value = F.lower(F.trim(joined(c.fields)))
        return F.when(value != "", value.isin(*[v.strip().lower() for v in c.values]) if c.values else F.lit(False))
    if c.kind == "regex":
        text = joined(c.fields) if pattern_chars is None else F.substring(joined(c.fields), 1, pattern_chars)
        return text.rlike("(?i)" + c.values[0]) if c.values and safe_pattern(c.values[0]) else unknown
    if c.kind == "tag":
        tags = F.col(c.fields[0])
        return F.when(F.size(tags) > 0, F.arrays_overlap(tags, F.array(*map(F.lit, c.values))) if c.values else F.lit(False))
    return F.col(c.fields[0]).cast("boolean")


def match(rows: DataFrame, criteria: tuple[Criterion, ...], pattern_chars: int | None = PATTERN_CHARS) -> DataFrame:
    """Add `signals` (one struct per criterion), `match_score`, `rejected` (ids of failed hard criteria) and `match_reason`.

    The score is the earned share of the soft weight, 1 without any; unknown earns nothing and rejects nothing.
    """
    signal = lambda c: F.struct(F.lit(c.id).alias("id"), F.lit(c.label).alias("label"), F.lit(c.hard).alias("hard"), F.lit(float(c.weight)).alias("weight"), outcome(c, pattern_chars).alias("passed"))
    total = sum(c.weight for c in criteria if not c.hard)
    rows = rows.withColumn("signals", F.array(*map(signal, criteria)) if criteria else F.expr("array()").cast("array<struct<id:string,label:string,hard:boolean,weight:double,passed:boolean>>"))
    passed = lambda s: F.coalesce(s["passed"], F.lit(False))
    earned = F.aggregate("signals", F.lit(0.0), lambda sum_, s: sum_ + F.when(passed(s) & ~s["hard"], s["weight"]).otherwise(0.0))
    failed = lambda s: ~F.coalesce(s["passed"], F.lit(True))
    good = F.array_join(F.transform(F.filter("signals", passed), lambda s: s["label"]), "; ")
    bad = F.array_join(F.transform(F.filter("signals", lambda s: failed(s) & ~s["hard"]), lambda s: s["label"]), "; ")
    reason = F.concat_ws(" ", F.when(good != "", F.concat(F.lit("Matches: "), good, F.lit("."))), F.when(bad != "", F.concat(F.lit("Not confirmed: "), bad, F.lit("."))))
    return (
        rows.withColumn("match_score", earned / F.lit(float(total)) if total else F.lit(1.0))
        .withColumn("rejected", F.transform(F.filter("signals", lambda s: failed(s) & s["hard"]), lambda s: s["id"]))
        .withColumn("match_reason", F.when(reason == "", "No criteria confirmed.").otherwise(reason))
    )


def field_confidence(method: Column, verified: Column) -> Column:
    """The way's prior, 0 where the value isn't verified."""
    priors = F.create_map(*[x for m, p in PRIORS.items() for x in (F.lit(m), F.lit(p))])
    return F.when(verified, F.coalesce(priors[method], F.lit(0.0))).otherwise(0.0)


#: The most that a sensitive value is trusted without a verified quote.
UNQUOTED = 0.7


def sensitive_confidence(confidence: Column, sensitive: Column, quoted: Column) -> Column:
    """A field's confidence, bounded where it is sensitive and no verified quote states it."""
    return F.when(sensitive & ~F.coalesce(quoted, F.lit(False)), F.least(confidence, F.lit(UNQUOTED))).otherwise(confidence)


def record_confidence(fields: dict[str, Column], present: dict[str, Column], required: tuple[str, ...], most: float = 1.0) -> Column:
    """The least confidence over required fields that are present, else over all, 0 without any, capped."""
    wanted = F.array_compact(F.array(*[F.when(present[f], fields[f]) for f in required])) if required else F.array().cast("array<double>")
    return F.least(F.lit(most), F.coalesce(F.array_min(wanted), F.array_min(F.array(*fields.values())), F.lit(0.0)))


def status(reasons: Column, missing: Column) -> Column:
    """invalid with reasons, incomplete with missing fields, else valid."""
    return F.when(F.size(reasons) > 0, "invalid").when(F.size(missing) > 0, "incomplete").otherwise("valid")


def certainty(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "sure").when(confidence >= 0.75, "likely").otherwise("check")


def lead_score(state: Column, match_score: Column, confidence: Column) -> Column:
    """0 to 100 for valid rows, else null."""
    return F.when(state == "valid", F.floor(50 * (match_score + confidence) + 0.5).cast("int"))


def lead_tier(score: Column) -> Column:
    return F.when(score >= 80, "strong").when(score >= 60, "good").when(score.isNotNull(), "possible")


def prefilter(rows: DataFrame, fields: tuple[str, ...], include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), most: int | None = None, by: str = "source", order: str = "ord") -> DataFrame:
    """Rows that hold an include word (where there are any) and no exclude word, the first `most` of each source."""
    from pyspark.sql import Window as W

    tests = []
    if pattern := keyword_pattern(include):
        tests.append(joined(fields).rlike(pattern))
    if pattern := keyword_pattern(exclude):
        tests.append(~joined(fields).rlike(pattern))
    kept = rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows
    if most is None:
        return kept
    return kept.withColumn("_rank", F.row_number().over(W.partitionBy(by).orderBy(order))).filter(F.col("_rank") <= most).drop("_rank")


def lead_order() -> list[Column]:
    """Valid rows first, then incomplete ones, best first, older first."""
    rank = F.when(F.col("status") == "valid", 0).when(F.col("status") == "incomplete", 1).otherwise(2)
    return [rank.asc(), (F.col("match_score") + F.col("confidence")).desc(), F.col("created_at").asc(), F.col("id").asc()]
