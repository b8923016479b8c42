"""A contract and its sources as one lazy DataFrame."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ledgerframe.functions.url import canonical_url
from ledgerframe.operators import criteria as c
from ledgerframe.operators.resolve import clusters, keepers, record_key
from ledgerframe.operators.store import RunStore, candidate_key, evidence_rows, stored
from ledgerframe.session import materialise

#: Steps in the order in which they run.
STEPS = ("collect", "prefilter", "match", "validate", "dedupe", "store")


def normalize(contract: c.Contract) -> c.Contract:
    """A contract that can run: snake-case names once each, required fields and keys that exist, 1 to 1,000 rows, safe patterns."""
    names = tuple(dict.fromkeys(re.sub(r"[^a-z0-9]+", "_", f.lower()).strip("_") for f in contract.fields))
    kept = tuple(x for x in contract.criteria if set(x.fields) <= set(names) and (x.kind != "regex" or (x.values and c.safe_pattern(x.values[0]))))
    keys = tuple(k for k in contract.keys if k and set(k) <= set(names)) or tuple(k for k in (("url",), ("title",)) if set(k) <= set(names))
    return replace(contract, fields=names, required=tuple(f for f in contract.required if f in names), criteria=kept, keys=keys, urls=tuple(u for u in contract.urls if u in names), most=max(1, min(1_000, contract.most)))


def collect(sources: list[DataFrame]) -> DataFrame:
    """All sources' rows; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def validate(rows: DataFrame, contract: c.Contract) -> DataFrame:
    """Add reasons, missing, status and confidence. Rows carry id, method, verified and the contract's fields."""
    value = lambda f: F.coalesce(F.col(f).cast("string"), F.lit(""))
    present = {f: F.col("verified") & (F.trim(value(f)) != "") for f in contract.fields}
    links = [F.when((value(f) != "") & canonical_url(F.col(f)).isNull(), F.concat(F.lit("invalid_link:"), F.lit(f))) for f in contract.urls]
    hard = F.transform("rejected", lambda r: F.concat(F.lit("criterion_not_met:"), r))
    reasons = F.concat(hard, F.array_compact(F.array(*links))) if links else hard
    missing = F.array_compact(F.array(*[F.when(~present[f], f) for f in contract.required])) if contract.required else F.array().cast("array<string>")
    trust = c.field_confidence(F.col("method"), F.col("verified"))
    rows = rows.withColumn("reasons", reasons).withColumn("missing", missing).withColumn("status", c.status(F.col("reasons"), F.col("missing")))
    note = F.when(F.size("missing") > 0, F.concat(F.lit("missing_fields:"), F.array_join("missing", "|")))
    rows = rows.withColumn("reasons", F.concat("reasons", F.array_compact(F.array(note))))
    return rows.withColumn("confidence", c.record_confidence({f: F.when(present[f], trust).otherwise(0.0) for f in contract.fields}, present, contract.required))


def run(contract: c.Contract, sources: list[DataFrame]) -> DataFrame:
    """Collect, prefilter, match, validate and dedupe: rows with status, scores and duplicate_of.

    The judged rows are written once, as the dedupe reads them several times and what they come from may be dear. Only
    rows that aren't invalid take part in it, by id and keys.
    """
    contract = normalize(contract)
    rows = collect(sources)
    o = contract.options
    rows = c.prefilter(rows, tuple(o.get("text", contract.fields)), tuple(o.get("include", ())), tuple(o.get("exclude", ())), o.get("most"))
    rows = materialise(validate(c.match(rows, contract.criteria, o.get("pattern_chars", c.PATTERN_CHARS)), contract), "plan-rows")
    keys = [record_key(k, contract.urls) for k in contract.keys]
    joining = rows.filter("status <> 'invalid'")
    filled = reduce(lambda a, b: a + b, [(F.coalesce(F.col(f).cast("string"), F.lit("")) != "").cast("int") for f in contract.fields])
    ranked = joining.withColumn("completeness", filled).withColumn("method_rank", F.coalesce(F.create_map(*[x for i, m in enumerate(c.METHODS) for x in (F.lit(m), F.lit(i))])[F.col("method")], F.lit(9)))
    brief = ranked.select("id", "method_rank", "confidence", "completeness", "created_at")
    best = keepers(materialise(brief.join(clusters(joining, keys), "id"), "plan-clusters")).select("id", "duplicate_of")
    rows = rows.join(best, "id", "left")
    rows = rows.withColumn("lead_score", c.lead_score(F.col("status"), F.col("match_score"), F.col("confidence")))
    return rows.withColumn("lead_tier", c.lead_tier(F.col("lead_score")))


def run_and_store(contract: c.Contract, sources: list[DataFrame], store: RunStore, name: str) -> DataFrame:
    """`run`, and its last step: the records and their evidence are stored under the run's name; the stored records.

    Of candidates that share a source and id the last one is stored. A run that comes again, after it was killed or with
    other sources, leaves one copy of its records and none of its old evidence.
    """
    rows = run(contract, sources).withColumn("key", candidate_key(F.col("source"), F.col("id").cast("string")))
    records = materialise(stored(rows, name, "key", "ord"), "run-records")
    store.write(name, records, evidence_rows(records, list(normalize(contract).fields), ["key"]))
    return store.read("records", name)
