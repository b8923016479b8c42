"""Steps between collecting and matching: triage, reading texts, filling what is missing, cheapest way first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerframe.functions import dom, schema_org
from ledgerframe.functions.evidence import Proof, from_text
from ledgerframe.functions.parsers import pay, shown_pay
from ledgerframe.functions.text import html_to_text
from ledgerframe.operators.criteria import outcome

#: Where rows that triage puts last go in the order of their source.
LATER = 1 << 40


def triage(rows: DataFrame, label: Column) -> DataFrame:
    """Rows that are not judged irrelevant ('no'), the relevant ones ('yes') before the unknown, otherwise in order (ord)."""
    return rows.withColumn("_label", F.coalesce(label, F.lit("unknown"))).filter("_label <> 'no'").withColumn("ord", F.col("ord") + F.when(F.col("_label") == "yes", 0).otherwise(LATER)).drop("_label")


def relevance(criteria: tuple, title: str = "title") -> Column:
    """What hard role keywords say of a title: yes, no, or null without such a criterion."""
    rules = [outcome(c) for c in criteria if c.hard and c.kind == "keyword_any" and title in c.fields]
    return F.when(reduce(lambda a, b: a & b, rules), "yes").otherwise("no") if rules else F.lit(None).cast("string")


def allowed(rows: DataFrame, wants: Column, first: Column, most: int) -> DataFrame:
    """Add `may_ask`: whether a row is among the first `most` of its source that want something, those with `first` before others."""
    chosen = rows.filter(wants).select("id", "source", first.alias("_first"), "ord").withColumn("n", F.row_number().over(W.partitionBy("source").orderBy(F.desc("_first"), "ord"))).filter(F.col("n") <= most)
    return rows.join(chosen.select("id", F.lit(True).alias("_chosen")), "id", "left").withColumn("may_ask", F.coalesce("_chosen", F.lit(False))).drop("_chosen")


def pay_rung(text: Column) -> dict[str, Column]:
    """What patterns read in a text: its pay."""
    return {"salary": shown_pay(pay(text))}


def filled(rows: DataFrame, fields: list[str], rungs: list[tuple[str, dict[str, Column]]]) -> DataFrame:
    """`rows` with missing fields filled by the first rung that has them, and `filled`: a map of field to the rung's method."""
    tried = schema_org.ladder(rungs, fields)
    missing = {f: F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "" for f in fields}
    made = rows.withColumn("_new", F.struct(*[F.when(missing[f], tried[f]).alias(f) for f in fields]))
    added = F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col("_new")[f]["method"])]), lambda _, m: m.isNotNull())
    return made.select(*[F.coalesce(F.col(c), F.col("_new")[c]["value"]).alias(c) if c in fields else F.col(c) for c in rows.columns], added.alias("filled"))


def extract_text(rows: DataFrame, fields: list[str], required: list[str], budget: int) -> DataFrame:
    """Read what texts state for missing fields, and mark the rows whose model may still be asked (`may_ask`).

    Patterns read every text. A model may be asked for those that lack a required field afterwards, `budget` a source.
    """
    read = filled(rows, fields, [("REGEX", pay_rung(F.col("text")))])
    lacks = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "" for f in required], F.lit(False))
    return allowed(read, lacks & (F.coalesce(F.trim("text"), F.lit("")) != ""), lacks, budget)


def enrich(rows: DataFrame, fields: list[str], pages: DataFrame, most_pages: int) -> DataFrame:
    """Fill missing fields of rows (id, source, ord, url, text): from the text, then from the posting's page (url, html).

    A page is read for the first `most_pages` rows of each source that still lack a field and have an address: its
    JobPosting, then patterns over its text. `filled` says which way brought each field.
    """
    first = filled(rows, fields, [("REGEX", pay_rung(F.col("text")))])
    lacks = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "" for f in fields])
    asked = allowed(first, lacks & F.startswith(F.col("url"), F.lit("http")), F.lit(0), most_pages)
    wanted = pages.join(asked.filter("may_ask").select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.min("html").alias("html"))
    read = wanted.select("url", dom.page_facets("json_ld", "text")(F.col("html"), F.col("url")).alias("_page"))
    posting = F.get(schema_org.of_type(F.col("_page.json_ld"), "JobPosting"), F.lit(0))
    met = asked.withColumnRenamed("filled", "_before").join(read, "url", "left").withColumn("_page", F.when(F.col("may_ask"), F.col("_page")))
    second = filled(met, fields, [("JSON_LD", schema_org.job_posting(posting)), ("REGEX", pay_rung(F.col("_page.text")))])
    # What a page fills was missing before, so no field is in both maps.
    return second.withColumn("filled", F.map_concat("_before", "filled")).drop("_before", "_page", "may_ask").select(*rows.columns, "filled")


def with_reason(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """`rows` with the match reason as a derived, verified value where the contract has a field for it."""
    return rows.withColumn("match_reason_value", F.struct(F.col("match_reason").alias("value"), F.lit("DERIVED").alias("method"), F.lit(True).alias("verified"))) if "match_reason" in fields else rows


def text_values(rows: DataFrame, html: str = "html") -> DataFrame:
    """Rows with `text`, the visible text of their HTML, and `salary`, the pay it states with its span as evidence."""
    read = rows.withColumn("text", html_to_text(F.col(html))).withColumn("_pay", pay(F.col("text")))
    return read.withColumn("salary", from_text(Proof(shown_pay(F.col("_pay")), F.col("_pay.raw")), F.col("text"), F.col("url"))).drop("_pay")
