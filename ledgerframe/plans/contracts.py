"""Contracts before they are planned: domain defaults, links, canonical text, budgets, drafts and versions."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from ledgerframe.operators.criteria import Contract, Criterion
from ledgerframe.session import materialise

# What makes one posting or one document, words that ask for good companies and the tags they mean, fields
# that search rarely knows, budgets of each mode, pages of a list, sources at once and results of a search by mode.
JOB_KEYS, DOCUMENT_KEYS = (("url",), ("company", "title", "location")), (("url",),)
GOOD = r"(?i)\b(?:good|great|top|best|leading|reputable|strong|well[- ]known)\b[^.]{0,40}\b(?:compan(?:y|ies)|employers?|startups?|teams?)\b"
GOOD_TAGS, GOOD_WEIGHT = ("ai_lab", "ai_infra", "devtools"), 0.3
OFTEN_UNKNOWN = ("author", "pages", "size_bytes")
BUDGETS = {
    "quick": {"pages": 40, "browser": 3, "calls": 15, "searches": 3, "seconds": 120}, "balanced": {"pages": 150, "browser": 10, "calls": 60, "searches": 8, "seconds": 240},
    "thorough": {"pages": 300, "browser": 20, "calls": 150, "searches": 20, "seconds": 480},
}
LIST_PAGES = {"quick": 2, "balanced": 5, "thorough": 10}
AT_ONCE = {"quick": 3, "balanced": 4, "thorough": 6}
RESULTS = {"quick": 10, "balanced": 10, "thorough": 20}
#: Items that a plan without advice takes from a source.
DRAFT_ITEMS = 40


def job_defaults(contract: Contract, prompt: str) -> tuple[Contract, list[str]]:
    """Keys of a posting where none are given, and, if the prompt asks for good companies and no tags are wished, a soft wish for them; with notes."""
    kept = replace(contract, keys=contract.keys or JOB_KEYS)
    if not re.search(GOOD, prompt) or any(c.kind == "tag" for c in contract.criteria):
        return kept, []
    wish = Criterion("good_companies", "good companies", "tag", ("tags",), GOOD_TAGS, weight=GOOD_WEIGHT)
    return replace(kept, criteria=(*kept.criteria, wish)), ["good companies are those with the tags " + ", ".join(GOOD_TAGS)]


def document_defaults(contract: Contract, description: str, queries: list[str], links: list[str]) -> tuple[Contract, list[str], list[str]]:
    """One document a link, fields that search rarely knows optional, and the description as a query where there is none; contract, queries, notes."""
    optional = [f for f in contract.required if f in OFTEN_UNKNOWN]
    notes = [f"{f} is optional: search results rarely state it" for f in optional]
    asked = queries or ([] if links or not description.strip() else [description.strip()])
    if asked != queries:
        notes.append("the description is the search query")
    return replace(contract, required=tuple(f for f in contract.required if f not in OFTEN_UNKNOWN), keys=contract.keys or DOCUMENT_KEYS), asked, notes


def web_links(links: list[str]) -> tuple[list[str], list[str]]:
    """Absolute http(s) addresses, each once, https where no scheme is given; and those that are none."""
    kept, refused = {}, []
    for raw in map(str.strip, links):
        whole = raw if re.match(r"(?i)[a-z][a-z0-9+.-]*://", raw) else f"https://{raw}"
        (kept.setdefault(whole) if re.match(r"(?i)https?://[^/?#\s]+[^\s]*$", whole) else refused.append(raw))
    return list(kept), refused


def summary(contract: Contract, domain: str, description: str, companies: tuple = (), tags: tuple = ()) -> str:
    """A contract in one canonical text, so that requests that ask for the same are alike whatever their wording."""
    low = lambda xs: sorted(x.lower() for x in xs)
    wishes = [f"{'hard' if c.hard else 'soft'} {c.kind} {c.label}: {'/'.join(low(c.values))}" for c in contract.criteria]
    return "\n".join([
        f"domain: {domain} ({description})", "fields: " + ", ".join(low(f + "*" * (f in contract.required) for f in contract.fields)), "criteria: " + "; ".join(low(wishes)),
        f"companies: {', '.join(low(companies)) or 'any'}; tags: {', '.join(low(tags)) or 'any'}",
    ])


def budget(mode: str, ceilings: dict[str, int]) -> dict[str, int]:
    """A mode's budget, nowhere above the ceilings."""
    return {k: min(n, ceilings.get(k, n)) for k, n in BUDGETS[mode].items()}


def template_draft(candidates: DataFrame, items: int = DRAFT_ITEMS) -> DataFrame:
    """A plan that takes every candidate source (ref, ord) with default settings."""
    return candidates.select("ref", "ord", F.lit(True).alias("include"), F.lit(items).alias("most"), F.lit(0).alias("calls"))


def redraft(candidates: DataFrame, draft: DataFrame, items: int = DRAFT_ITEMS) -> DataFrame:
    """A draft after its contract was edited: entries of sources that are still there stay, new ones get the defaults, others go."""
    kept = draft.select("ref", F.col("include").alias("_include"), F.col("most").alias("_most"), F.col("calls").alias("_calls"))
    met = template_draft(candidates, items).join(kept, "ref", "left")
    return met.select("ref", "ord", *[F.coalesce(f"_{c}", c).alias(c) for c in ("include", "most", "calls")])


def lineage(versions: DataFrame) -> DataFrame:
    """For each version (id, parent) the first one that it comes from and how many steps away: id, root, depth.

    Each round doubles how far every version looks back, so rounds grow with the logarithm of the longest line.
    """
    now = materialise(versions.select("id", F.coalesce("parent", "id").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")), "lineage")
    while True:
        up = now.select(F.col("id").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        following = materialise(now.join(up, "root").select("id", F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("_depth") > 0).alias("moved")), "lineage")
        now = following.drop("moved")
        if following.filter("moved").isEmpty():
            return now
