"""Registered queries of sources, discovery, decisions, steps and page elements, with SQL where SQL says the same."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ledgerframe.functions import dom, evidence, pages as page_checks, parsers, text
from ledgerframe.operators import criteria, decisions, discovery, elements, reports
from ledgerframe.plans import contracts, steps
from ledgerframe.queries import _CANONICAL, query, table
from ledgerframe.sources import boards, export, files, forum, hits

# Search results: a document is a result, its first line the title and the rest the snippet.

_HIT = "SELECT doc_id, string_split(text, chr(10))[1] AS title, text AS description, 'https://www.' || lower(source) || '.example/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.pdf' ELSE '' END AS url FROM documents WHERE text IS NOT NULL"


def _hits(spark, d):
    rows = table(spark, d, "documents").filter("text is not null")
    address = F.concat(F.lit("https://www."), F.lower("source"), F.lit(".example/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".pdf").otherwise(""))
    return rows.select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.col("text").alias("description"), address.alias("url"))


@query(rf"""SELECT doc_id, nullif(regexp_extract(title || chr(10) || description, '@[\w.]{{2,30}}'), '') AS handle,
            CASE WHEN length(trim(regexp_split_to_array(title, '\s+[(|•·–-]|\s+@')[1])) > 1 THEN trim(regexp_split_to_array(title, '\s+[(|•·–-]|\s+@')[1]) END AS name FROM ({_HIT})""")
def src13_hit_facts(spark, d):
    rows = _hits(spark, d)
    facts = hits.hit_facts(F.col("title"), F.col("description"), F.col("url"))
    return rows.select("doc_id", facts["handle"].value.alias("handle"), facts["name"].value.alias("name"))


@query()
def src12_profile_items(spark, d):
    """Items of all results, each value a span of the result's text."""
    out = hits.profile_items(_hits(spark, d), {"who": "name", "account": "handle", "about": "bio"})
    return out.select("external_id", *[F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in ("who", "account", "about") for x in ("value", "locator", "verified")])


@query(rf"""SELECT url, nullif(regexp_extract(trim(description), '(?i)\b(\d{{1,4}})\s+pages?\b', 1), '') AS pages, CASE WHEN regexp_matches(url, '\.pdf$') THEN 'PDF' END AS file_type, replace(regexp_extract(url, 'https://([^/]+)', 1), 'www.', '') AS site FROM ({_HIT})""")
def src16_document_facts(spark, d):
    rows = _hits(spark, d).withColumn("published", F.lit(None).cast("string"))
    facts = hits.document_facts(rows)
    return rows.select("url", *[facts[f].value.alias(f) for f in ("pages", "file_type", "site")])


@query(f"""SELECT url, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 5 = 1 THEN 'PDF' WHEN doc_id % 3 = 0 THEN 'PDF' END WHEN doc_id % 3 = 0 THEN 'PDF' END AS file_type, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR END AS size_bytes,
            CASE WHEN doc_id % 2 = 0 THEN '2024-02-03' END AS published FROM ({_HIT}) WHERE NOT (doc_id % 2 = 0 AND doc_id % 5 = 2)""")
def src17_document_headers(spark, d):
    """Files' headers over their results: an even document answers, one in five as a page, one in five as a PDF by its type."""
    rows = _hits(spark, d).withColumn("published", F.lit(None).cast("string"))
    kind = F.when(F.col("doc_id") % 5 == 1, "application/pdf").when(F.col("doc_id") % 5 == 2, "text/html; charset=utf-8").otherwise("application/octet-stream")
    heads = rows.filter("doc_id % 2 = 0").select("url", F.lit(200).alias("status"), kind.alias("content_type"), F.col("doc_id").alias("content_length"), F.lit("2024-02-03T10:00:00Z").alias("last_modified"), F.lit(None).cast("string").alias("disposition_name"), F.col("url").alias("final_url"))
    out = hits.document_items(rows, heads)
    return out.select("url", *[F.col(f"{f}.value").alias(f) for f in ("file_type", "size_bytes", "published")])


@query()
def src07_forum_items(spark, d):
    """Every turn of every conversation as a comment; its first line is a header if it is one."""
    rows = table(spark, d, "conversations")
    made = F.concat(F.concat_ws(" | ", F.col("role"), F.lit("Engineer"), F.lit("Remote (Oslo)"), F.concat(F.lit("$"), (90 + F.col("turn") % 50).cast("string"), F.lit("k"))), F.lit("<p>"), F.col("text"))
    comments = rows.select((F.col("conv_id") * 1_000 + F.col("turn")).alias("id"), F.col("turn").alias("ord"), F.col("role").alias("author"), F.lit("2024-01-01").alias("created_at"), F.when(F.col("turn") % 2 == 0, made).otherwise(F.col("text")).alias("text"))
    out = forum.items(comments)
    return out.select("external_id", "parsed", *[F.col(f"{f}.value").alias(f) for f in ("company", "title", "location", "remote", "salary", "url")], F.col("salary.locator").alias("salary_span"))


@query("""SELECT min(doc_id) AS ord, 'Ask: Who is hiring? ' || min(doc_id) AS title FROM documents WHERE doc_id % 50 = 7""")
def src08_latest_thread(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit("Ask: Who is hiring? "), F.col("doc_id").cast("string"))).otherwise(F.lit("other")).alias("title"))
    return forum.latest_thread(rows).select("ord", "title")


# Boards: orders as postings of their customer's board, written as JSON and read back.


@query("""SELECT o_orderkey::VARCHAR AS external_id, o_orderpriority AS title, c_name AS company, c_mktsegment AS location, 'USD' AS currency, round(o_totalprice, 2) AS salary_low, round(o_totalprice, 2) AS salary_high, CASE WHEN o_orderkey % 3 = 0 THEN 'remote' END AS arrangement
          FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'""")
def src04_ashby_board(spark, d):
    """The board's file holds one list; each customer's is one file."""
    from ledgerframe.session import scratch

    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pay = F.array(F.struct(F.lit("Salary").alias("compensationType"), F.lit("USD").alias("currencyCode"), F.round("o_totalprice", 2).alias("minValue")))
    posting = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.col("c_mktsegment").alias("location"), (F.col("o_orderstatus") != "P").alias("isListed"), (F.col("o_orderkey") % 3 == 0).alias("isRemote"), F.struct(pay.alias("summaryComponents")).alias("compensation"), F.col("c_name").alias("jobUrl"))
    path = scratch(spark, "boards")
    o.select(F.to_json(F.struct(F.array(posting).alias("jobs"))).alias("value")).write.text(path)
    rows = spark.read.schema(boards.ASHBY).json(path)
    out = boards.ashby_rows(rows, "")
    return out.select("external_id", "title", F.col("url").alias("company"), "location", "currency", "salary_low", "salary_high", "arrangement")


def _board(spark, d, value, schema):
    """Orders with their customers as lines of JSON, read back as boards."""
    from ledgerframe.session import scratch

    path = scratch(spark, "boards")
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o.select(F.to_json(value).alias("value")).write.text(path)
    return spark.read.schema(schema).json(path)


@query("""SELECT o_orderkey::VARCHAR AS external_id, o_orderpriority AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'ACME' ELSE c_name END AS company, c_mktsegment || '; Oslo' AS location, strftime(o_orderdate, '%Y-%m-%d') AS posted,
                 CASE o_orderkey % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' END AS arrangement, 'Pays ' || o_orderpriority || ' & more' AS description FROM orders JOIN customer ON c_custkey = o_custkey""")
def src03_greenhouse_board(spark, d):
    """Places in one text, the arrangement among other metadata, the description as HTML that is escaped once more."""
    stated = F.array(F.struct(F.lit("Team").alias("name"), F.lit("Remote").alias("value")), F.struct(F.lit("Workplace Type").alias("name"), F.when(F.col("o_orderkey") % 3 == 0, "Remote").when(F.col("o_orderkey") % 3 == 1, "Hybrid").alias("value")))
    posting = F.struct(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit("https://a.example/j").alias("absolute_url"), F.when(F.col("o_orderkey") % 4 != 0, F.col("c_name")).alias("company_name"),
        F.struct(F.concat("c_mktsegment", F.lit(" ; Oslo | "), F.lower("c_mktsegment")).alias("name")).alias("location"), stated.alias("metadata"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("first_published"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"), F.concat(F.lit("&lt;p&gt;Pays &lt;b&gt;"), "o_orderpriority", F.lit("&lt;/b&gt; &amp;amp; more&lt;/p&gt;")).alias("content"),
    )
    out = boards.greenhouse_rows(_board(spark, d, F.struct(F.array(posting).alias("jobs")), boards.GREENHOUSE), "ACME")
    return out.select("external_id", "title", "company", "location", "posted", "arrangement", "description")


@query("""SELECT o_orderkey::VARCHAR AS external_id, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN c_mktsegment || '; Oslo' ELSE c_mktsegment END AS location, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS posted,
                 CASE WHEN o_orderkey % 3 = 0 THEN 'onsite' END AS arrangement, round(o_totalprice, 2) AS salary_low, round(o_totalprice, 2) AS salary_high, c_name || chr(10) || chr(10) || 'What' || chr(10) || ' builds ' || chr(10) || chr(10) || 'Apply' AS description
          FROM orders JOIN customer ON c_custkey = o_custkey""")
def src05_lever_board(spark, d):
    """All places where there are any, else the one; text, lists and what follows as one description; a single bound of pay is both."""
    posting = F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("text"), F.lit("https://a.example/j").alias("hostedUrl"),
        F.struct(F.col("c_mktsegment").alias("location"), F.when(F.col("o_orderkey") % 2 == 0, F.array("c_mktsegment", F.lit("Oslo"), F.lit("OSLO"))).otherwise(F.array().cast("array<string>")).alias("allLocations"), F.lit("Full-time").alias("commitment")).alias("categories"),
        F.when(F.col("o_orderkey") % 3 == 0, "on-site").otherwise("unspecified").alias("workplaceType"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("createdAt"), F.col("c_name").alias("descriptionPlain"),
        F.array(F.struct(F.lit("What").alias("text"), F.lit("<li>builds</li>").alias("content"))).alias("lists"), F.lit("Apply").alias("additionalPlain"),
        F.struct(F.when(F.col("o_orderkey") % 5 > 0, F.round("o_totalprice", 2)).alias("min"), F.when(F.col("o_orderkey") % 5 < 3, F.round("o_totalprice", 2)).alias("max"), F.lit("USD").alias("currency")).alias("salaryRange"),
    )
    out = boards.lever_rows(_board(spark, d, posting, boards.LEVER), "ACME")
    return out.select("external_id", "title", "location", "posted", "arrangement", "salary_low", "salary_high", "description")


@query("""SELECT o_orderkey::VARCHAR AS external_id, o_orderpriority AS title, c_name AS company, CASE WHEN o_orderkey % 2 = 0 THEN c_mktsegment || ', Norway' ELSE 'Norway' END AS location, strftime(o_orderdate, '%Y-%m-%d') AS posted,
                 CASE WHEN o_orderkey % 3 = 0 THEN 'remote' END AS arrangement, 'Full-time' AS employment FROM orders JOIN customer ON c_custkey = o_custkey""")
def src06_workable_board(spark, d):
    """City, state and country as one place, blank ones left out; telecommuting is remote."""
    posting = F.struct(
        F.col("o_orderkey").cast("string").alias("shortcode"), F.col("o_orderpriority").alias("title"), F.lit("full_time").alias("employment_type"), (F.col("o_orderkey") % 3 == 0).alias("telecommuting"), F.lit("https://a.example/j").alias("url"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_on"), F.lit("Norway").alias("country"), F.when(F.col("o_orderkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("city"), F.lit(None).cast("string").alias("state"),
    )
    out = boards.workable_rows(_board(spark, d, F.struct(F.col("c_name").alias("name"), F.array(posting).alias("jobs")), boards.WORKABLE), "ACME")
    return out.select("external_id", "title", "company", "location", "posted", "arrangement", "employment")


@query("""SELECT o_custkey AS company, count(*) AS n FROM orders GROUP BY 1""")
def k53_count_postings(spark, d):
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("company")).agg(F.collect_list(F.struct("o_orderkey")).alias("jobs"))  # a board's postings
    board = F.when(F.col("company") % 2 == 0, F.to_json("jobs")).otherwise(F.to_json(F.struct("jobs")))
    return lists.select("company", parsers.count_postings(board).cast("long").alias("n"))


# Files: parts as CSV and JSON files, scanned and read as tables.


@query("""SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand FROM part""")
def src23_csv_tables(spark, d):
    """The parts in as many CSV files as their table has types, each with its header."""
    from ledgerframe.session import scratch

    path = scratch(spark, "files")
    columns = ["p_partkey", "p_name", "p_brand"]
    table(spark, d, "part").select(*[F.col(c).cast("string") for c in columns], "p_type").write.partitionBy("p_type").option("header", True).option("sep", ";").csv(path)
    rows = files.table_rows(spark, f"{path}/*/*.csv")
    value = lambda c: F.get(F.filter("cells", lambda x: x["header"] == c), F.lit(0))["value"]
    return rows.select(*[value(c).alias(c) for c in columns])


@query("""SELECT p_type AS name, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes FROM part GROUP BY 1""")
def src25_json_tables(spark, d):
    from ledgerframe.session import scratch

    path = scratch(spark, "files")
    table(spark, d, "part").select("p_partkey", "p_size", F.col("p_type").alias("name"), "p_type").write.partitionBy("p_type").json(path)
    rows = files.table_rows(spark, f"{path}/*/*.json")
    value = lambda c: F.get(F.filter("cells", lambda x: x["header"] == c), F.lit(0))["value"]
    return rows.select(value("name").alias("name"), value("p_size").cast("long").alias("s")).groupBy("name").agg(F.count("*").alias("n"), F.sum("s").alias("sizes"))


@query("""SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}' AS value FROM orders""")
def snk05_json_rows(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return export.json_rows(rows).select(F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey"), "value")


# Companies and discovery

_CORE = r"regexp_replace(lower(c_mktsegment || ' Labs Inc. ' || c_nationkey), '\b(?:inc|llc|ltd|corp|co|labs?|technologies|technology|hq|ai)\b\.?', ' ', 'g')"


@query(rf"""SELECT c_custkey, array_to_string(list_distinct_in_order, ',') AS slugs FROM (SELECT c_custkey, [w, h, c1] AS list_distinct_in_order FROM (
            SELECT c_custkey, replace(t, ' ', '') AS w, replace(t, ' ', '-') AS h, replace(k, ' ', '') AS c1 FROM (
              SELECT c_custkey, lower(c_mktsegment) || ' labs inc ' || c_nationkey AS t, trim(regexp_replace({_CORE}, '\s+', ' ', 'g')) AS k FROM customer)))""")
def dsc03_name_slugs(spark, d):
    name = F.concat(F.col("c_mktsegment"), F.lit(" Labs Inc. "), F.col("c_nationkey").cast("string"))
    rows = table(spark, d, "customer").select("c_custkey", discovery.name_slugs(name).alias("s"))
    return rows.select("c_custkey", F.array_join(F.slice("s", 1, 3), ",").alias("slugs"))


@query("""SELECT p_type AS slug, max(p_type || ' ' || repeat('x', CAST(1 + p_size % 7 AS INTEGER))) AS name FROM part GROUP BY 1""")
def dsc06_company_names(spark, d):
    """A part's type is a board, its postings name the company at different lengths."""
    rows = table(spark, d, "part").select(F.col("p_type").alias("slug"), F.col("p_partkey").alias("ord"), F.concat(F.col("p_name"), F.lit(" - "), F.col("p_type"), F.lit(" "), F.expr("repeat('x', 1 + p_size % 7)"), F.lit(" at home")).alias("title"))
    return discovery.company_names(rows)


@query(f"""WITH h AS (SELECT page_id AS ord, canonical AS url, site, CASE WHEN page_id % 3 = 0 THEN 'list' ELSE 'record' END AS kind FROM ({_CANONICAL})), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ord) AS n FROM h)
          SELECT ord, kind FROM r WHERE n <= CASE kind WHEN 'list' THEN 8 ELSE 10 END AND length(site) % 2 = 0""")
def dsc10_capped_hits(spark, d):
    from ledgerframe.functions import url

    rows = table(spark, d, "pages").select(F.col("page_id").alias("ord"), "url", url.site_of(F.col("url")).alias("site"), F.when(F.col("page_id") % 3 == 0, "list").otherwise("record").alias("kind"))
    robots = rows.select("site", (F.length("site") % 2 == 0).alias("allowed")).distinct()
    return discovery.capped_hits(rows, robots).select("ord", "kind")


@query(f"""SELECT site, count(*) AS hits, min(page_id) AS ord, min(page_id)::VARCHAR AS first FROM ({_CANONICAL}) GROUP BY site""")
def dsc11_profile_sites(spark, d):
    from ledgerframe.functions import url

    rows = table(spark, d, "pages").select(F.col("page_id").alias("ord"), F.col("page_id").cast("string").alias("url"), url.site_of(F.col("url")).alias("site"))
    return discovery.profile_sites(rows).select("site", "hits", "ord", F.get("urls", F.lit(0)).alias("first"))


@query(f"""WITH f AS (SELECT canonical AS url, min(page_id) AS ord, min_by('q' || page_id % 40, page_id) AS base FROM ({_CANONICAL}) GROUP BY 1)
          SELECT base, count(*) AS files, min(ord) AS ord FROM f WHERE ord % 5 > 0 GROUP BY base ORDER BY ord LIMIT 12""")
def dsc13_documents_by_query(spark, d):
    from ledgerframe.functions import url

    rows = table(spark, d, "pages").select(url.canonical_url(F.col("url")).alias("url"), F.col("page_id").alias("ord"), F.concat(F.lit("q"), (F.col("page_id") % 40).cast("string")).alias("base"))
    seen = rows.groupBy("url").agg(F.min("ord").alias("ord")).filter("ord % 5 = 0")
    return discovery.documents_by_query(rows, seen, 12)


@query("""SELECT coalesce(a.ref, b.ref) AS ref, CASE WHEN a.ref IS NOT NULL THEN 0 ELSE 1 END AS rank, coalesce(a.ord, b.ord) AS ord FROM (SELECT l_suppkey AS ref, min(l_orderkey) AS ord FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a FULL JOIN (SELECT s_suppkey AS ref, s_suppkey AS ord FROM supplier) b ON a.ref = b.ref""")
def dsc01_ordered_candidates(spark, d):
    linked = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("ref")).agg(F.min("l_orderkey").alias("ord"))
    return discovery.ordered_candidates(linked, table(spark, d, "supplier").select(F.col("s_suppkey").alias("ref"), F.col("s_suppkey").alias("ord")))


# Decisions

_ASKED = """SELECT event_id AS id, event_type AS task, user_id, value, sha256('{"labels":"yes,no","state":"' || user_id || '","task":"' || event_type || '"}') AS hash FROM events"""


def _asked(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("task"), "user_id", "value")
    return rows.withColumn("hash", decisions.input_hash({"task": F.col("task"), "state": F.col("user_id").cast("string"), "labels": F.lit("yes,no")}))


@query(f"SELECT id, hash FROM ({_ASKED})")
def dec02_input_hash(spark, d):
    return _asked(spark, d).select("id", "hash")


@query(f"""WITH a AS ({_ASKED}), k AS (SELECT hash, arg_max(CASE WHEN value > 50 THEN 'yes' WHEN value > 20 THEN 'no' ELSE 'maybe' END, id) AS label FROM a WHERE id % 3 = 0 AND id % 2 = 0 GROUP BY 1)
          SELECT id, CASE WHEN label IN ('yes', 'no') THEN label END AS cached FROM a LEFT JOIN k USING (hash)""")
def jon15_reused_decisions(spark, d):
    asked = _asked(spark, d)
    made = asked.filter("id % 3 = 0").select("hash", "id", F.col("id").alias("created_at"), F.when(F.col("value") > 50, "yes").when(F.col("value") > 20, "no").otherwise("maybe").alias("label"), F.lit(True).alias("reusable"), F.when(F.col("id") % 2 == 0, "LLM").otherwise("RULES").alias("decided_by"))
    return decisions.reused(asked.withColumn("labels", F.array(F.lit("yes"), F.lit("no"))), made).select("id", "cached")


@query("""SELECT doc_id, CASE WHEN greatest(a, b) >= 0.5 THEN CASE WHEN a >= b THEN 'long' ELSE 'short' END END AS choice FROM (SELECT doc_id, least(n_chars / 4000.0::DOUBLE, 1.0::DOUBLE) AS a, 0.8::DOUBLE - least(n_chars / 4000.0::DOUBLE, 1.0::DOUBLE) AS b FROM documents)""")
def dec04_choice(spark, d):
    a = F.least(F.col("n_chars") / 4_000.0, F.lit(1.0))
    shares = F.create_map(F.lit("long"), a, F.lit("short"), 0.8 - a, F.lit("other"), F.lit(0.95))
    return table(spark, d, "documents").select("doc_id", decisions.choice(shares, ["long", "short"], 0.5).alias("choice"))


@query("""SELECT event_id, CASE WHEN value / 400 >= 0.5 THEN 'yes' ELSE 'no' END AS label, round(abs(value / 400 - 0.5) * 2, 6) AS confidence FROM events WHERE value IS NOT NULL""")
def dec07_leaning(spark, d):
    rows = table(spark, d, "events").filter("value is not null").select("event_id", decisions.leaning(F.col("value") / 400).alias("x"))
    return rows.select("event_id", "x.label", F.round("x.confidence", 6).alias("confidence"))


@query("""WITH r AS (SELECT user_id AS batch, event_id AS id FROM events), a AS (SELECT batch, id, CASE WHEN id % 7 = 0 THEN 'perhaps' WHEN id % 2 = 0 THEN 'YES ' ELSE 'no' END AS label FROM r WHERE id % 11 > 0), v AS (SELECT * FROM a WHERE id % 7 > 0),
          b AS (SELECT batch, count(*) AS asked FROM r GROUP BY 1), g AS (SELECT batch, count(*) AS given, count(*) FILTER (WHERE id % 7 > 0) AS good FROM a GROUP BY 1)
          SELECT v.batch, v.id, lower(trim(v.label)) AS label, asked = given AND asked = good AS reusable FROM v JOIN b USING (batch) JOIN g USING (batch)""")
def dec06_whole_batches(spark, d):
    asked = table(spark, d, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("id"), F.array(F.lit("yes"), F.lit("no")).alias("labels"))
    given = asked.filter("id % 11 > 0").select("batch", "id", F.when(F.col("id") % 7 == 0, "perhaps").when(F.col("id") % 2 == 0, "YES ").otherwise("no").alias("label"))
    return decisions.whole_batches(asked, given)


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS yes, CASE event_type WHEN 'click' THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END AS "no", CASE event_type WHEN 'view' THEN 'off' WHEN 'click' THEN 'shadow' ELSE 'active' END AS mode FROM events""")
def dec08_task_thresholds(spark, d):
    asked = table(spark, d, "events").select("event_id", F.col("event_type").alias("task"))
    kinds = asked.select("task").distinct()
    saved = kinds.filter("task in ('click', 'view')").select("task", F.when(F.col("task") == "click", 0.9).otherwise(0.8).alias("yes"), F.when(F.col("task") == "click", 0.1).otherwise(0.2).alias("no"), F.when(F.col("task") == "click", "shadow").otherwise("off").alias("mode"))
    return decisions.task_thresholds(asked, saved).select("event_id", "yes", "no", "mode")


_FAILED = """SELECT event_id, CASE event_type WHEN 'error' THEN CASE WHEN event_id % 4 = 0 THEN 'robots_disallowed' WHEN event_id % 4 = 1 THEN 'budget_exhausted' ELSE 'http_status' END WHEN 'view' THEN 'timeout' END AS kind,
    CAST(CASE WHEN event_id % 3 = 0 THEN 429 ELSE 500 END AS INTEGER) AS status, event_id % 10 = 2 AS blocked, CAST(event_id % 4 AS INTEGER) AS attempt FROM events"""


@query(f"""WITH f AS (SELECT *, CASE WHEN kind IS NULL THEN 'UNKNOWN' WHEN kind = 'robots_disallowed' THEN 'BLOCKED' WHEN kind = 'budget_exhausted' THEN 'BUDGET' WHEN kind = 'http_status' AND blocked THEN 'BLOCKED' WHEN kind = 'http_status' AND status = 429 THEN 'RATE_LIMITED' ELSE 'HTTP_ERROR' END AS failure FROM ({_FAILED}))
          SELECT event_id, failure, CASE WHEN attempt > 2 THEN 'STOP' WHEN failure IN ('BLOCKED', 'BUDGET') THEN 'STOP' WHEN failure IN ('HTTP_ERROR', 'RATE_LIMITED') THEN CASE WHEN attempt > 1 THEN 'STOP' ELSE 'RETRY' END END AS action FROM f""")
def dec09_repairs(spark, d):
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", F.when(e % 4 == 0, "robots_disallowed").when(e % 4 == 1, "budget_exhausted").otherwise("http_status")).when(F.col("event_type") == "view", "timeout")
    failure = decisions.failure_class(kind, F.when(e % 3 == 0, 429).otherwise(500), e % 10 == 2)
    rows = table(spark, d, "events").select("event_id", failure.alias("failure"))
    return rows.select("event_id", "failure", decisions.repair(F.col("failure"), e % 4, F.lit("http")).alias("action"))


@query("""SELECT event_type AS task, count(*) AS compared, count(*) FILTER (WHERE (value >= 100) = (value >= 120)) AS agreed FROM events WHERE event_id % 2 = 0 AND value IS NOT NULL GROUP BY 1""")
def agg12_agreement(spark, d):
    v = F.col("value")
    rows = table(spark, d, "events").select(F.col("event_type").alias("task"), F.when(F.col("event_id") % 2 == 0, "LLM").otherwise("RULE").alias("tier"), F.when(v >= 100, "yes").when(v.isNotNull(), "no").alias("shadow"), F.when(v >= 120, "yes").otherwise("no").alias("label"))
    return decisions.agreement(rows)


@query("""SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'RULE' ELSE 'LLM' END AS tier FROM events ORDER BY event_id % 2 = 0, event_id LIMIT 25""")
def agg12_samples(spark, d):
    return decisions.samples(table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "RULE").otherwise("LLM").alias("tier")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(CASE l_returnflag WHEN 'R' THEN l_quantity * 2 / 1e6 + l_extendedprice * 10 / 1e6 WHEN 'A' THEN l_quantity * 0.1 / 1e6 + l_extendedprice * 0.5 / 1e6 ELSE 0 END, 9) AS cost FROM lineitem""")
def k80_call_costs(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("input"), F.col("l_extendedprice").alias("output"))
    prices = lines.select("model").distinct().filter("model <> 'N'").select("model", F.when(F.col("model") == "R", 2.0).otherwise(0.1).alias("input"), F.when(F.col("model") == "R", 10.0).otherwise(0.5).alias("output"))
    return decisions.call_costs(lines, prices).select("l_orderkey", "l_linenumber", "l_partkey", F.round("cost", 9).alias("cost"))


# Steps

_TITLES = """SELECT p_partkey AS id, p_type AS source, p_partkey AS ord, p_name AS title FROM part"""


@query(f"""SELECT id, CASE WHEN regexp_matches(title, '(?i)(?:^|[^a-z0-9])(?:widget|ring)') THEN ord ELSE ord + 1099511627776 END AS ord FROM ({_TITLES}) WHERE id % 4 = 0 OR regexp_matches(title, '(?i)(?:^|[^a-z0-9])(?:widget|ring)')""")
def stp02_triage(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("source"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"))
    says = steps.relevance((criteria.Criterion("role", "role", "keyword_any", ("title",), ("widget", "ring"), hard=True),))
    return steps.triage(rows, F.when((says == "no") & (F.col("id") % 4 == 0), None).otherwise(says)).select("id", "ord")


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'USD 120,000–150,000 / year' WHEN o_orderkey % 3 = 1 THEN 'given' END AS salary, o_orderkey % 3 = 2 AS lacks FROM orders),
          k AS (SELECT id, row_number() OVER (PARTITION BY source ORDER BY id) AS n FROM r WHERE lacks)
          SELECT r.id, r.salary, CASE WHEN r.id % 3 = 0 THEN 'REGEX' END AS method, coalesce(n <= 15, false) AS may_ask FROM r LEFT JOIN k USING (id)""")
def stp03_extract_text(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("ord"))
    rows = o.withColumn("text", F.when(F.col("id") % 3 == 0, "It pays $120k to $150k a year").otherwise("No word of it")).withColumn("salary", F.when(F.col("id") % 3 == 1, "given"))
    return steps.extract_text(rows, ["salary"], ["salary"], 15).select("id", "salary", F.col("filled")["salary"].alias("method"), "may_ask")


@query()
def stp05_enrich(spark, d):
    """Pages as postings: what the page's own JobPosting and text say fills what is missing, 200 pages a site at most."""
    from ledgerframe.functions import url

    p = table(spark, d, "pages")
    rows = p.select(F.col("page_id").alias("id"), url.site_of(F.col("url")).alias("source"), F.col("page_id").alias("ord"), "url", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("salary"), F.when(F.col("page_id") % 4 == 0, "from $90k a year").otherwise("").alias("text"))
    return steps.enrich(rows, ["title", "salary"], p.select("url", "html"), 200).select("id", "title", "salary", F.col("filled")["salary"].alias("salary_method"), F.col("filled")["title"].alias("title_method"))


# Quotes, page checks, words

_NUMBERS = r"regexp_replace(regexp_replace(lower({}), '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g')"


@query(rf"""SELECT doc_id, list_has_all(list_distinct(regexp_extract_all({_NUMBERS.format('q')}, '[\p{{L}}\p{{N}}]+')), list_distinct(regexp_extract_all({_NUMBERS.format('w')}, '[\p{{L}}\p{{N}}]+'))) AS stated
          FROM (SELECT doc_id, text || ' 1,250,000' AS w, CASE WHEN doc_id % 2 = 0 THEN text || ' 1250000 in all' ELSE substr(text, 2) || ' 1,250,00' END AS q FROM documents WHERE text IS NOT NULL)""")
def k61_quote_supports(spark, d):
    """Whole texts as values; every other quote lacks their first letter and says another number."""
    rows = table(spark, d, "documents").filter("text is not null")
    quote = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" 1250000 in all"))).otherwise(F.concat(F.substring("text", F.lit(2), F.length("text")), F.lit(" 1,250,00")))
    return rows.select("doc_id", evidence.quote_supports(F.concat("text", F.lit(" 1,250,000")), quote).alias("stated"))


@query()
def prd24_needs_render(spark, d):
    """By the length of each page's visible text."""
    from ledgerframe.functions.text import html_to_text

    return table(spark, d, "pages").filter("html is not null").select("page_id", page_checks.needs_render(F.col("html"), F.length(html_to_text(F.col("html")))).alias("reason"))


@query("""SELECT page_id, contains(html, 'collectConsent?sessionId=') OR (page_id % 4 = 0 AND (contains(html, '_cf_chl_opt') OR contains(html, 'captcha-delivery.com') OR page_id % 8 = 0)) AS challenge FROM pages WHERE html IS NOT NULL""")
def prd25_challenges(spark, d):
    rows = table(spark, d, "pages").filter("html is not null")
    status, mitigated = F.when(F.col("page_id") % 4 == 0, 403).otherwise(200), F.when(F.col("page_id") % 8 == 0, "challenge")
    return rows.select("page_id", page_checks.is_challenge(status, mitigated, F.col("html")).alias("challenge"))


@query("""SELECT event_id, a = 10 OR a = 127 OR a = 0 OR (a = 172 AND b >= 16 AND b <= 31) OR (a = 192 AND b = 168) OR (a = 100 AND b >= 64 AND b <= 127) OR (a = 169 AND b = 254) OR (a = 198 AND b IN (18, 19)) OR (a = 192 AND b = 0 AND c = 0) OR a >= 224 AS internal
          FROM (SELECT event_id, (event_id * 7) % 256 AS a, (event_id * 13) % 256 AS b, event_id % 3 AS c FROM events)""")
def prd26_internal_addresses(spark, d):
    e = F.col("event_id")
    address = F.concat_ws(".", *[x.cast("string") for x in ((e * 7) % 256, (e * 13) % 256, e % 3, F.lit(1))])
    return table(spark, d, "events").select("event_id", page_checks.is_internal(address).alias("internal"))


@query(r"""SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: w IN ('tion', 'ing', 'then')))) AS n FROM documents WHERE text IS NOT NULL""")
def k32_relevance(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", page_checks.shared(F.col("text"), "the Tion and ing of then").cast("long").alias("n"))


@query()
def k31_document_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(page_checks.document_text(F.col("text")), 256).alias("digest"))


@query("""SELECT event_id, CASE WHEN abs(s) < 60 OR s IS NULL THEN 'just now' WHEN unit = 'day' AND n = -1 THEN 'yesterday' WHEN unit = 'day' AND n = 1 THEN 'tomorrow'
            WHEN n < 0 THEN -n || ' ' || unit || CASE WHEN n = -1 THEN '' ELSE 's' END || ' ago' ELSE 'in ' || n || ' ' || unit || CASE WHEN n = 1 THEN '' ELSE 's' END END AS ago
          FROM (SELECT *, CAST(floor(s / size + 0.5::DOUBLE) AS BIGINT) AS n FROM (
            SELECT event_id, s, CASE WHEN abs(s) >= 86400 THEN 'day' WHEN abs(s) >= 3600 THEN 'hour' ELSE 'minute' END AS unit, CASE WHEN abs(s) >= 86400 THEN 86400 WHEN abs(s) >= 3600 THEN 3600 ELSE 60 END AS size
            FROM (SELECT event_id, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-06-01')) / 1e6::DOUBLE + 0.5::DOUBLE) AS s FROM events)))""")
def k82_time_ago(spark, d):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return table(spark, d, "events").select("event_id", page_checks.ago(F.col("ts").cast("timestamp"), now).alias("ago"))


@query("""WITH RECURSIVE v AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS depth, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS root FROM orders)
          SELECT id, root, CAST(depth AS INTEGER) AS depth FROM v""")
def pln09_lineage(spark, d):
    from ledgerframe.operators import state

    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate")
    return contracts.lineage(state.versions(rows, "o_custkey", ["o_orderdate", "id"])).select("id", "root", "depth")


@query("""SELECT c_custkey AS ref, c_custkey AS ord, coalesce(o.n < 10, true) AS include, coalesce(o.n, 40) AS most FROM customer LEFT JOIN (SELECT o_custkey, CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def pln08_redraft(spark, d):
    found = table(spark, d, "customer").select(F.col("c_custkey").alias("ref"), F.col("c_custkey").alias("ord"))
    draft = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("ref")).agg((F.count("*") < 10).alias("include"), F.count("*").cast("int").alias("most")).withColumn("calls", F.lit(0))
    return contracts.redraft(found, draft).select("ref", "ord", "include", "most")


# Elements of pages


@query()
def l02_repeated_groups(spark, d):
    rows = elements.elements(table(spark, d, "pages"))
    return elements.groups(rows).select("page_id", "selector", "items", F.round("mean_text", 6).alias("mean_text"), F.round("link_share", 6).alias("link_share"), "score", "place")


@query()
def l19_content(spark, d):
    rows = elements.elements(table(spark, d, "pages"))
    return elements.content(rows, "the tion and ing").select("page_id", "i", "tag", F.round("score", 6).alias("score"), "relevance", "place")


@query()
def k67_alike_elements(spark, d):
    """For the first item of each page's best group the elements that are like it."""
    from ledgerframe.session import materialise

    rows = materialise(elements.elements(table(spark, d, "pages")), "elements")
    best = elements.groups(rows, 1).select("page_id", "parent", "selector")
    first = rows.join(best, ["page_id", "parent", "selector"]).groupBy("page_id").agg(F.min("i").alias("i"))
    return elements.alike(rows, first).groupBy("page_id", "i").agg(F.count("*").alias("alike"))


@query()
def k72_embedded_data(spark, d):
    rows = table(spark, d, "pages").select("page_id", dom.page_facets("embedded", "json_ld", "canonical")(F.col("html"), F.col("url")).alias("s"))
    return rows.select("page_id", F.size("s.embedded").alias("n_embedded"), F.size("s.json_ld").alias("n_json_ld"), "s.canonical")


@query()
def src09_list_pages(spark, d):
    """Every page as the start of a list, its navigation as the items, five pages at most."""
    from ledgerframe.sources import pages as lists

    p = table(spark, d, "pages").select("url", "html")
    chain = lists.page_chain(p, p.select(F.col("url").alias("start")), 5)
    out = lists.list_items(chain, ("nav li", {"title": ("a", None), "link": ("a", "href")}), {}, "company")
    return out.select("start", F.col("ord.place").alias("place"), F.col("ord.n").alias("n"), *[F.col(f"{f}.value").alias(f) for f in ("title", "link", "company")])


@query()
def src11_record_items(spark, d):
    from ledgerframe.sources import pages as lists

    return lists.record_items(table(spark, d, "pages").select("url", "html"), ["name"], {})


# Records of statuses and confidence

@query("""SELECT o_orderkey AS id, CASE WHEN p THEN 0.99::DOUBLE ELSE 0.0::DOUBLE END AS field_confidence, CASE WHEN o_orderkey % 5 = 0 THEN 'invalid' WHEN NOT p THEN 'incomplete' ELSE 'valid' END AS status,
            CASE WHEN p THEN CASE WHEN v THEN 0.99::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END AS confidence FROM (SELECT *, o_totalprice > 100000 AS v, o_totalprice > 100000 AS p FROM orders)""")
def prd14_status(spark, d):
    v = F.col("o_totalprice") > 100_000
    trust = criteria.field_confidence(F.lit("API"), v)
    reasons = F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    missing = F.when(~v, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), trust.alias("field_confidence"), criteria.status(reasons, missing).alias("status"), criteria.record_confidence({"f": trust}, {"f": v}, ("f",)).alias("confidence"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_totalprice > 100000 THEN 0.99::DOUBLE WHEN o_orderkey % 2 = 0 THEN 0.7::DOUBLE ELSE 0.88::DOUBLE END AS confidence FROM orders""")
def prd18_sensitive(spark, d):
    """A sensitive value without a verified quote is never surer than that."""
    trust = F.when(F.col("o_totalprice") > 100_000, 0.99).otherwise(0.88)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), criteria.sensitive_confidence(trust, F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") > 100_000).alias("confidence"))


@query("""SELECT user_id AS key, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND ts < TIMESTAMP '2024-01-30'""")
def src31_cached_copy(spark, d):
    newest = reports.latest(table(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    return newest.filter(F.col("ts") < F.lit("2024-01-30").cast("timestamp_ntz")).select(F.col("user_id").alias("key"), "value", "event_id")


# NFKC, which DuckDB lacks: signs that have a plain form besides NFC's (ligatures, wide digits) become it, then NFC. Planes 0
# and 1 hold them all. DuckDB's NFC ends at U+0000 and loses U+11A7, so it gets what lies between them.

_PLAIN = {c: unicodedata.normalize("NFKD", c) for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))) if unicodedata.normalize("NFKD", c) != unicodedata.normalize("NFD", c)}
_SIGNS, _FORMS = "".join(_PLAIN), ["['" + "', '".join(x.replace("'", "''") for x in xs) + "']" for xs in (_PLAIN, _PLAIN.values())]
_NFKC = rf"""array_to_string(list_transform(regexp_extract_all(CASE WHEN regexp_matches(text, '[{_SIGNS}]') THEN array_to_string(list_transform(regexp_extract_all(text, '[{_SIGNS}]|[^{_SIGNS}]+'),
            lambda p: coalesce(map({_FORMS[0]}, {_FORMS[1]})[p], p)), '') ELSE text END, '[\x00\x{{11A7}}]|[^\x00\x{{11A7}}]+'), lambda p: nfc_normalize(p)), '')"""


@query(rf"""SELECT doc_id, trim(regexp_replace(regexp_replace({_NFKC}, '[\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}]', '', 'g'),
            '[\s\x0B\x{{1680}}\x{{2028}}\x{{2029}}]+', ' ', 'g')) AS line FROM documents""")
def k22_single_line(spark, d):
    return table(spark, d, "documents").select("doc_id", text.single_line(F.col("text")).alias("line"))
