"""The read path: filtered and ordered pages of records, records with their proof, runs with their contracts, words for people."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerframe.operators.criteria import lead_order

# What certainty, tiers and ways of obtaining a value are called, and the groups of trust.
CERTAINTY_WORDS = {"sure": "Sure", "likely": "Likely", "check": "Check this"}
TIER_WORDS = {"strong": "Strong", "good": "Good", "possible": "Possible"}
SOURCE_WORDS = {
    "API": "From the site's data feed", "JSON_LD": "From the page's listing data", "DOC_META": "From the file's details", "EMBEDDED_JSON": "From data inside the page", "DOM": "Read from the page",
    "REGEX": "Found in the text", "LLM": "Found by AI, quote checked", "SEARCH": "From search results", "DERIVED": "Worked out from other values",
}
FETCH_WORDS = {"http": "Read directly", "browser": "Opened in a browser", "stealth": "Opened in a stealth browser, past a bot check", "search": "From search results", "document": "From the file, never opened as a page"}
TRUST = {"API": "direct", "JSON_LD": "direct", "EMBEDDED_JSON": "direct", "DOM": "read", "REGEX": "read", "DERIVED": "derived", "LLM": "ai", "SEARCH": "search"}


@dataclass(frozen=True)
class Filters:
    """Which records a list shows. `equals` and `has` are by field; `text` is looked for in all data, field names too."""

    status: str | None = None
    source: str | None = None
    duplicates: bool = False
    least_confidence: float | None = None
    text: str | None = None
    equals: dict[str, str] = field(default_factory=dict)
    has: dict[str, bool] = field(default_factory=dict)


def filtered(records: DataFrame, wanted: Filters, data: list[str]) -> DataFrame:
    """The records that pass; `text` is taken literally, whatever its case."""
    tests = [] if wanted.duplicates else [F.col("duplicate_of").isNull()]
    if wanted.status:
        tests.append(F.col("status") == wanted.status)
    if wanted.source:
        tests.append(F.col("source") == wanted.source)
    if wanted.least_confidence is not None:
        tests.append(F.col("confidence") >= wanted.least_confidence)
    if wanted.text:
        tests.append(F.contains(F.lower(F.to_json(F.struct(*data))), F.lower(F.lit(wanted.text))))
    tests += [F.lower(F.col(f).cast("string")) == v.lower() for f, v in wanted.equals.items()]
    tests += [F.col(f).isNotNull() if there else F.col(f).isNull() for f, there in wanted.has.items()]
    return records.filter(reduce(lambda a, b: a & b, tests)) if tests else records


def page_of(records: DataFrame, offset: int, most: int, order: list[Column] | None = None) -> DataFrame:
    """Rows `offset` to `offset + most` in order (lead order if not given), each with the count of all as `total`."""
    return records.orderBy(*(order or lead_order())).offset(offset).limit(most).withColumn("total", records.agg(F.count("*")).scalar())


def with_proof(records: DataFrame, evidence: DataFrame, pages: DataFrame, key: str = "id") -> DataFrame:
    """Each value of the records with its proof and the page it was read from (via, fetched_at), null without one."""
    values = evidence.join(records.select(key), key, "left_semi")
    return values.join(pages.select("page_id", "via", "fetched_at"), "page_id", "left")


def export_values(records: DataFrame, evidence: DataFrame, wanted: Filters, data: list[str], key: str = "id") -> DataFrame:
    """The values of the records that a filter lets through."""
    return evidence.join(filtered(records, wanted, data).select(key), key, "left_semi")


def two_digits(share: Column) -> Column:
    """A number from 0 to 1 with the two digits nearest to the double itself, not to how it is written: 0.285 lies below the middle; of two as near the larger."""
    # Whole numbers that fit 64 bits: share * 2^bits is one, exactly, and its 25 fold is the digits times 2^(bits - 2).
    near = lambda bits: F.shiftright((share * F.lit(2.0**bits)).cast("long") * 25 + F.lit(1 << bits - 3), bits - 2)
    return F.format_string("%.2f", F.when(share < 1 / 16, near(62)).otherwise(near(58)) / 100)


def export_columns(records: DataFrame, fields: list[str], methods: DataFrame, key: str = "id") -> DataFrame:
    """An export's columns: the fields, then tier, score, status, match score and confidence with two digits, source, methods."""
    two = lambda c: two_digits(F.col(c).cast("double"))
    return records.join(methods, key, "left").select(
        *fields, "lead_tier", "lead_score", "status", two("match_score").alias("match_score"), two("confidence").alias("confidence"), "source", F.coalesce("evidence_methods", F.lit("")).alias("evidence_methods")
    )


def label(title: Column, company: Column, key: Column) -> Column:
    """'title, company' as far as they are there, else the key."""
    return F.coalesce(F.nullif(F.concat_ws(", ", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(company), F.lit(""))), F.lit("")), key)


def words_for(value: Column, words: dict[str, str]) -> Column:
    """What a code is called, the code itself if it has no name."""
    return F.coalesce(*[F.when(value == code, said) for code, said in words.items()], value)


def run_summaries(runs: DataFrame, contracts: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Runs with the title and version of their request's newest contract, and the request's prompt if asked for."""
    newest = contracts.groupBy("request").agg(F.max_by("title", "version").alias("title"), F.max("version").alias("version"))
    found = runs.join(newest, "request", "left")
    return found if requests is None else found.join(requests.select("request", "prompt"), "request")


def run_list(runs: DataFrame, most: int = 50) -> DataFrame:
    """The newest runs first."""
    return runs.orderBy(F.desc("created_at"), F.desc("run")).limit(most)


def events_after(events: DataFrame, run: Column, after: Column, most: int = 500) -> DataFrame:
    """The next events of a run after a cursor, in order."""
    return events.filter((F.col("run") == run) & (F.col("seq") > after)).orderBy("seq").limit(most)


def latest_meaning(events: DataFrame, words: dict[str, str], by: str = "run") -> DataFrame:
    """For each run the newest event that people have words for: (run, seq, line)."""
    said = events.withColumn("line", F.coalesce(*[F.when(F.col("type") == kind, line) for kind, line in words.items()])).filter("line is not null")
    return said.groupBy(by).agg(F.max("seq").alias("seq"), F.max_by("line", "seq").alias("line"))


def top_reason(rows: DataFrame, by: str, reason: str) -> DataFrame:
    """The commonest reason of each group and its count; ties go to the first by name."""
    counts = rows.groupBy(by, reason).agg(F.count("*").alias("n"))
    best = counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(reason).alias("reason"))).alias("x"))
    return best.select(by, F.col("x.reason").alias("reason"), (-F.col("x.n")).alias("n"))


def trust_split(evidence: DataFrame) -> DataFrame:
    """Values by group of trust, and their share of all that belong to a group; groups without any too."""
    every = evidence.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(TRUST.values())], "trust string")
    counts = evidence.filter(F.col("method").isin(*TRUST)).groupBy(words_for(F.col("method"), TRUST).alias("trust")).agg(F.count("*").alias("n"))
    rows = F.broadcast(every).join(counts, "trust", "left").select("trust", F.coalesce("n", F.lit(0)).alias("n"))  # a handful of rows
    total = F.sum("n").over(W.partitionBy())
    return rows.select("trust", "n", F.when(total > 0, F.round(F.col("n") / total, 6)).otherwise(0.0).alias("share"))


def page_last_read(pages: DataFrame, evidence: DataFrame, method: str = "DOM") -> DataFrame:
    """The newest copy of each address that a value was read from."""
    cited = evidence.filter(F.col("method") == method).select("page_id").distinct()
    return pages.join(cited, "page_id", "left_semi").groupBy("url").agg(F.max_by("page_id", F.struct("fetched_at", "page_id")).alias("page_id"))


def overlap(plans: DataFrame, available: DataFrame) -> DataFrame:
    """For each plan the share of its sources (plan, ref) that are among the available ones (ref); a plan without any has no row."""
    known = available.select("ref", F.lit(1).alias("_there")).distinct()
    return plans.join(known, "ref", "left").groupBy("plan").agg(F.round(F.count("_there") / F.count("*"), 6).alias("ratio"))
