"""Hiring threads of a forum: each comment with text is an item, its header's values quoted from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerframe.functions.evidence import Proof, derived, from_text
from ledgerframe.functions.header import header
from ledgerframe.functions.text import html_to_text, truncate

THREAD = "id bigint, title string, children array<struct<id:bigint,author:string,created_at:string,text:string>>"
#: Address of a comment by its number, and characters of a description.
COMMENT, DESCRIPTION = "https://news.ycombinator.com/item?id=", 500


def items(comments: DataFrame) -> DataFrame:
    """Items of comments (id, author, created_at, text as HTML; others without text are left out).

    external_id, ord, author, plain text, parsed (whether there was a header) and a struct of value and evidence for company,
    title, location, remote, salary, employment_type, url, posted_at and description; all null without a header. A
    header's link is the item's address, else the comment is.
    """
    link = F.concat(F.lit(COMMENT), F.col("id").cast("string"))
    rows = comments.filter(F.coalesce(F.trim("text"), F.lit("")) != "").withColumn("plain", html_to_text(F.col("text"))).withColumn("link", link)
    rows = rows.withColumn("h", header(F.get(F.split("plain", "\n"), F.lit(0))))
    said = lambda value, words: from_text(Proof(F.col(f"h.{value}"), F.col(f"h.words.{words}")), F.col("plain"), F.col("link"))
    start = F.substring("plain", 1, 300)
    there = F.col("h").isNotNull()
    values = {
        "company": said("company", "company"), "title": said("role", "role"), "location": said("location", "location"), "remote": said("arrangement", "arrangement"), "salary": said("pay", "pay"),
        "employment_type": said("employment", "employment"), "url": F.coalesce(said("url", "url"), F.when(there, derived(F.col("link"), F.col("link"), F.col("link")))),
        "posted_at": F.when(there, derived(F.col("created_at"), F.col("created_at"), F.col("link"))),
        "description": F.when(there, from_text(Proof(truncate(F.col("plain"), DESCRIPTION), start), F.col("plain"), F.col("link"))),
    }
    return rows.select(F.col("id").cast("string").alias("external_id"), "ord", "author", "plain", there.alias("parsed"), *[c.alias(f) for f, c in values.items()])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Items of a thread's JSON."""
    return items(spark.read.schema(THREAD).json(path, multiLine=True).select(F.posexplode("children").alias("ord", "c")).select("ord", "c.*"))


def latest_thread(hits: DataFrame) -> DataFrame:
    """The first hit (ord, id, title) that is a hiring thread: one row, or none."""
    return hits.filter(F.col("title").rlike("(?i)who is hiring")).orderBy("ord").limit(1)
