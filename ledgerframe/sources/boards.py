"""Posting boards' JSON as rows of one shape, each value with the place it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerframe.functions.parsers import arrangement, employment_type, join_locations, workplace
from ledgerframe.functions.text import coded_html_to_text, truncate

FIELDS = ("title", "company", "location", "url", "arrangement", "employment", "posted", "salary_low", "salary_high", "currency", "description")

_PLACE = "struct<name:string>"
GREENHOUSE = f"jobs array<struct<id:bigint,title:string,absolute_url:string,company_name:string,location:{_PLACE},metadata:array<struct<name:string,value:string>>,first_published:string,updated_at:string,content:string>>"
_PAY = "struct<compensationType:string,interval:string,currencyCode:string,minValue:double,maxValue:double>"
ASHBY = f"jobs array<struct<id:string,title:string,employmentType:string,location:string,secondaryLocations:array<struct<location:string>>,publishedAt:string,isListed:boolean,isRemote:boolean,workplaceType:string,jobUrl:string,descriptionPlain:string,compensation:struct<summaryComponents:array<{_PAY}>>>>"
LEVER = "id string, text string, hostedUrl string, categories struct<location:string,allLocations:array<string>,commitment:string>, workplaceType string, createdAt bigint, descriptionPlain string, lists array<struct<text:string,content:string>>, additionalPlain string, salaryRange struct<min:double,max:double,currency:string,interval:string>"
WORKABLE = "name string, jobs array<struct<title:string,shortcode:string,employment_type:string,telecommuting:boolean,url:string,published_on:string,country:string,city:string,state:string>>"


def _rows(df: DataFrame, company: Column, source: str, values: dict[str, Column], id: Column) -> DataFrame:
    """One shape for all boards: external_id, FIELDS, and `evidence`, the JSON path of each value that is there."""
    columns = {f: values.get(f, F.lit(None)).cast("double" if f.startswith("salary_") else "string") for f in FIELDS} | {"company": company}
    out = df.select(F.lit(source).alias("source"), id.cast("string").alias("external_id"), "ord", *[c.alias(f) for f, c in columns.items()])
    proof = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.lit("API").alias("method"), F.concat(F.lit("$["), F.col("ord").cast("string"), F.lit(f"].{f}")).alias("path"), F.lit(True).alias("verified"))) for f in FIELDS]))
    return out.withColumn("evidence", proof)


def greenhouse(spark: SparkSession, path: str, company: str) -> DataFrame:
    return greenhouse_rows(spark.read.schema(GREENHOUSE).json(path, multiLine=True), company)


def greenhouse_rows(board: DataFrame, company: str) -> DataFrame:
    """Rows of boards that are read already, one board a row."""
    df = board.select(F.posexplode("jobs").alias("ord", "j")).withColumn("_places", join_locations(F.split(F.col("j.location.name"), r"\s*[;|]\s*"))).withColumn("_text", coded_html_to_text(F.col("j.content")))
    places = F.col("_places")
    stated = F.get(F.filter("j.metadata", lambda m: F.lower(m["name"]).rlike("location type|workplace|remote")), F.lit(0))["value"]
    return _rows(df, F.coalesce("j.company_name", F.lit(company)), "greenhouse", {"title": F.col("j.title"), "location": F.when(places != "", places), "url": F.col("j.absolute_url"), "arrangement": F.coalesce(workplace(stated), arrangement(places)), "posted": F.coalesce("j.first_published", "j.updated_at"), "description": truncate(F.col("_text"), 500)}, F.col("j.id"))


def ashby(spark: SparkSession, path: str, company: str) -> DataFrame:
    return ashby_rows(spark.read.schema(ASHBY).json(path, multiLine=True), company)


def ashby_rows(board: DataFrame, company: str) -> DataFrame:
    """Rows of boards that are read already, one board a row."""
    df = board.select(F.posexplode("jobs").alias("ord", "j")).filter("coalesce(j.isListed, true)")
    places = join_locations(F.concat(F.array("j.location"), F.coalesce(F.transform("j.secondaryLocations", lambda s: s["location"]), F.array().cast("array<string>"))))
    pay = F.get(F.filter("j.compensation.summaryComponents", lambda c: c["compensationType"] == "Salary"), F.lit(0))
    return _rows(df, F.lit(company), "ashby", {"title": F.col("j.title"), "location": F.when(places != "", places), "url": F.col("j.jobUrl"), "arrangement": F.coalesce(workplace(F.col("j.workplaceType")), F.when(F.col("j.isRemote"), "remote")), "employment": employment_type(F.col("j.employmentType")), "posted": F.col("j.publishedAt"), "salary_low": F.coalesce(pay["minValue"], pay["maxValue"]), "salary_high": F.coalesce(pay["maxValue"], pay["minValue"]), "currency": pay["currencyCode"], "description": truncate(F.col("j.descriptionPlain"), 500)}, F.col("j.id"))


def lever(spark: SparkSession, path: str, company: str) -> DataFrame:
    return lever_rows(spark.read.schema(LEVER).json(path, multiLine=True), company)


def lever_rows(postings: DataFrame, company: str) -> DataFrame:
    """Rows of postings that are read already; this kind of board is a list of them."""
    df = postings.select(F.struct("*").alias("j")).withColumn("ord", F.monotonically_increasing_id())
    places = join_locations(F.coalesce(F.when(F.size("j.categories.allLocations") > 0, F.col("j.categories.allLocations")), F.array("j.categories.location")))
    parts = F.concat_ws("\n\n", "j.descriptionPlain", F.transform("j.lists", lambda part: F.concat_ws("\n", part["text"], F.regexp_replace(part["content"], "<[^>]+>", " "))), "j.additionalPlain")
    posted = F.date_format(F.timestamp_millis("j.createdAt"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    pay = F.col("j.salaryRange")
    return _rows(df, F.lit(company), "lever", {"title": F.col("j.text"), "location": F.when(places != "", places), "url": F.col("j.hostedUrl"), "arrangement": F.coalesce(workplace(F.col("j.workplaceType")), arrangement(places)), "employment": F.col("j.categories.commitment"), "posted": posted, "salary_low": F.coalesce(pay["min"], pay["max"]), "salary_high": F.coalesce(pay["max"], pay["min"]), "currency": pay["currency"], "description": truncate(parts, 500)}, F.col("j.id"))


def workable(spark: SparkSession, path: str, company: str) -> DataFrame:
    return workable_rows(spark.read.schema(WORKABLE).json(path, multiLine=True), company)


def workable_rows(board: DataFrame, company: str) -> DataFrame:
    """Rows of boards that are read already, one board a row."""
    df = board.select("name", F.posexplode("jobs").alias("ord", "j"))
    place = F.concat_ws(", ", *[F.nullif(F.col(f"j.{c}"), F.lit("")) for c in ("city", "state", "country")])
    return _rows(df, F.coalesce("name", F.lit(company)), "workable", {"title": F.col("j.title"), "location": F.when(place != "", place), "url": F.col("j.url"), "arrangement": F.when(F.col("j.telecommuting"), "remote").otherwise(arrangement(F.concat_ws(" ", "j.title", place))), "employment": employment_type(F.col("j.employment_type")), "posted": F.col("j.published_on")}, F.col("j.shortcode"))


READERS = {"greenhouse": greenhouse, "ashby": ashby, "lever": lever, "workable": workable}


def read(spark: SparkSession, kind: str, path: str, company: str) -> DataFrame:
    """Rows of a board's JSON; an unknown kind fails at once."""
    if kind not in READERS:
        raise KeyError(f"unknown board kind {kind!r}; known: {', '.join(READERS)}")
    return READERS[kind](spark, path, company)
