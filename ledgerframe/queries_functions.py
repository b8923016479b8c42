"""Registered queries of functions and choices that no larger query meets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerframe.functions import parsers, schema_org, text, url
from ledgerframe.operators import criteria, discovery, reads, resolve, state
from ledgerframe.queries import _CANONICAL, _SITE, query, table

_POSTING = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'https://job-boards.greenhouse.io/' WHEN 1 THEN 'https://jobs.ashbyhq.com/' WHEN 2 THEN 'https://jobs.lever.co/' WHEN 3 THEN 'https://apply.workable.com/' ELSE 'https://other.example/' END || 'Co' || o_custkey || '/jobs/' || o_orderkey AS url,
    CASE o_orderkey % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'ashby' WHEN 2 THEN 'lever' WHEN 3 THEN 'workable' END AS kind, 'co' || o_custkey AS slug FROM orders"""


def _postings(spark, d):
    k = F.col("o_orderkey") % 5
    host = F.when(k == 0, "job-boards.greenhouse.io").when(k == 1, "jobs.ashbyhq.com").when(k == 2, "jobs.lever.co").when(k == 3, "apply.workable.com").otherwise("other.example")
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("https://"), host, F.lit("/Co"), F.col("o_custkey").cast("string"), F.lit("/jobs/"), F.col("o_orderkey").cast("string")).alias("url"))


@query(f"SELECT o_orderkey, kind, CASE WHEN kind IS NOT NULL THEN slug END AS slug FROM ({_POSTING})")
def k09_board_of(spark, d):
    return _postings(spark, d).select("o_orderkey", url.board_of(F.col("url")).alias("b")).select("o_orderkey", "b.kind", "b.slug")


@query(f"""WITH f AS (SELECT kind, slug, min(o_orderkey) AS first_at, count(*) AS hits FROM ({_POSTING}) WHERE kind IS NOT NULL GROUP BY 1, 2) SELECT kind, slug, hits FROM f WHERE NOT (kind = 'lever' AND length(slug) = 4) ORDER BY first_at LIMIT 15""")
def dsc05_boards_from_hits(spark, d):
    rows = _postings(spark, d).select("url", F.lit(0).alias("query_ord"), F.col("o_orderkey").alias("hit_ord"))
    seen = rows.select(url.board_of(F.col("url")).alias("b")).filter("b.kind = 'lever' and length(b.slug) = 4").select("b.kind", "b.slug").distinct()
    return discovery.boards_from_hits(rows, seen, 15)


@query(f"""SELECT page_id, substr({_SITE} || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/$', ''), 1, 48) AS label FROM pages""")
def k07_page_label(spark, d):
    return table(spark, d, "pages").select("page_id", url.page_label(F.col("url")).alias("label"))


@query("""SELECT o_orderkey, 'https://a.example/' || o_orderkey || '?x=1&y' AS target FROM orders""")
def k08_unwrapped_links(spark, d):
    wrapped = F.concat(F.lit("https://go.example/l/?kh=-1&u=https%3A%2F%2Fa.example%2F"), F.col("o_orderkey").cast("string"), F.lit("%3Fx%3D1%26y&rut=z"))
    return table(spark, d, "orders").select("o_orderkey", url.parameter(wrapped, "u").alias("target"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'onsite' WHEN 2 THEN 'hybrid' END AS arrangement FROM customer""")
def k44_workplace(spark, d):
    k = F.col("c_custkey") % 4
    return table(spark, d, "customer").select("c_custkey", parsers.workplace(F.when(k == 0, "Remote").when(k == 1, "In-Office").when(k == 2, "HYBRID ").otherwise("elsewhere")).alias("arrangement"))


@query("""SELECT p_partkey, p_type || CASE WHEN p_type <> p_brand THEN '; ' || p_brand ELSE '' END AS places FROM part""")
def k45_join_locations(spark, d):
    places = F.array(F.col("p_type"), F.lower("p_type"), F.lit(None).cast("string"), F.concat(F.lit(" "), F.col("p_brand"), F.lit("  ")), F.lit(""))
    return table(spark, d, "part").select("p_partkey", parsers.join_locations(places).alias("places"))


@query("""SELECT p_partkey, CAST(p_size AS DOUBLE) AS n FROM part""")
def k48_first_number(spark, d):
    return table(spark, d, "part").select("p_partkey", parsers.first_number(F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit(" of "), F.col("p_partkey").cast("string"))).alias("n"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Part-time' WHEN 2 THEN 'Contract' END AS kind FROM orders""")
def k49_employment_type(spark, d):
    k = F.col("o_orderkey") % 4
    return table(spark, d, "orders").select("o_orderkey", parsers.employment_type(F.when(k == 0, "FullTime").when(k == 1, "part_time").when(k == 2, "CONTRACT")).alias("kind"))


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders""")
def k51_iso_date(spark, d):
    at = F.col("o_orderdate").cast("timestamp")
    said = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "orders").select("o_orderkey", parsers.iso_date(said).alias("day"))


@query("""SELECT o_orderkey, 'USD ' || CASE WHEN o_orderkey % 3 = 0 THEN '90,000–' || (91 + o_orderkey % 50) || ',000' WHEN o_orderkey % 3 = 1 THEN '90,000' ELSE (91 + o_orderkey % 50) || ',000' END || CASE WHEN o_orderkey % 2 = 0 THEN ' / month' ELSE ' / year' END AS salary FROM orders""")
def k50_stated_pay(spark, d):
    k = F.col("o_orderkey")
    low, high = F.when(k % 3 != 2, 90_000.0), F.when(k % 3 != 1, (91 + k % 50) * 1_000.0)
    return table(spark, d, "orders").select("o_orderkey", parsers.stated_pay(low, high, F.lit("USD"), F.when(k % 2 == 0, "1 MONTH")).alias("salary"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 120000.0::DOUBLE WHEN o_orderkey % 4 = 1 THEN 55.0::DOUBLE WHEN o_orderkey % 4 = 2 THEN (10 + o_orderkey % 90) * 1000.0::DOUBLE END AS least,
            CASE WHEN o_orderkey % 4 = 0 THEN 150000.0::DOUBLE WHEN o_orderkey % 4 = 1 THEN 55.0::DOUBLE WHEN o_orderkey % 4 = 2 THEN (10 + o_orderkey % 90) * 1000.0::DOUBLE END AS most, CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' END AS currency, CASE o_orderkey % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'hour' WHEN 2 THEN 'year' END AS period FROM orders""")
def k40_pay_of_postings(spark, d):
    k = F.col("o_orderkey")
    said = F.when(k % 4 == 0, "we pay $120k-150 and a 401(k)").when(k % 4 == 1, "€55 / hour").when(k % 4 == 2, F.concat((10 + k % 90).cast("string"), F.lit(",000 GBP. Hourly standups"))).otherwise("a $100 stipend, 2,000 people")
    rows = table(spark, d, "orders").select("o_orderkey", parsers.pay(said).alias("p"))
    return rows.select("o_orderkey", "p.least", "p.most", "p.currency", "p.period")


@query("""SELECT c_custkey, c_mktsegment AS company, CASE WHEN c_custkey % 2 = 0 THEN 'Engineer; Lead' END AS role, CASE WHEN c_custkey % 3 = 0 THEN 'Remote (Oslo)' ELSE 'Rome' END AS location, CASE WHEN c_custkey % 3 = 0 THEN 'remote' END AS arrangement FROM customer""")
def k46_headers_of_companies(spark, d):
    from ledgerframe.functions.header import header

    k = F.col("c_custkey")
    line = F.concat_ws(" | ", F.concat(F.col("c_mktsegment"), F.lit(" (YC)")), F.when(k % 2 == 0, "*Engineer* | Lead").otherwise("Full-time"), F.when(k % 3 == 0, "Remote (Oslo)").otherwise("Rome"))
    rows = table(spark, d, "customer").select("c_custkey", header(line).alias("h"))
    return rows.select("c_custkey", "h.company", "h.role", "h.location", "h.arrangement")


@query("""SELECT o_orderkey, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'Oslo, NO' END AS location, o_totalprice AS salary_low, CASE WHEN o_orderkey % 3 = 0 THEN 'remote' END AS arrangement FROM orders""")
def k73_job_postings(spark, d):
    place = F.when(F.col("o_orderkey") % 2 == 0, F.struct(F.struct(F.lit("Oslo").alias("addressLocality"), F.lit("NO").alias("addressCountry")).alias("address")))
    thing = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.col("o_orderpriority").alias("title"), place.alias("jobLocation"), F.when(F.col("o_orderkey") % 3 == 0, "TELECOMMUTE").alias("jobLocationType"), F.struct(F.struct(F.col("o_totalprice").alias("value")).alias("value")).alias("baseSalary")))
    read = schema_org.job_posting(F.get(schema_org.of_type(F.array(F.lit('{"@type":"Person"}'), F.col("thing")), "JobPosting"), F.lit(0)))
    return table(spark, d, "orders").withColumn("thing", thing).select("o_orderkey", *[read[f].alias(f) for f in ("title", "location", "salary_low", "arrangement")])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, pos - 1 AS pos, l_returnflag || pos AS name FROM lineitem, range(1, 3) r(pos)""")
def k75_item_lists(spark, d):
    entry = lambda n: F.struct(F.concat("l_returnflag", F.lit(n)).alias("name"))
    thing = F.to_json(F.struct(F.array(F.lit("Thing"), F.lit("ItemList")).alias("@type"), F.array(entry("1"), entry("2")).alias("itemListElement")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.posexplode(schema_org.item_list(F.array(thing))).alias("pos", "x"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("pos").cast("long").alias("pos"), F.get_json_object("x", "$.name").alias("name"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'named' WHEN c_nationkey % 2 = 0 THEN 'hinted' END AS value FROM customer""")
def k74_by_name(spark, d):
    thing = F.to_json(F.struct(F.when(F.col("c_acctbal") > 0, "named").alias("companySize"), F.when(F.col("c_nationkey") % 2 == 0, "hinted").alias("numberOfEmployees")))
    return table(spark, d, "customer").select("c_custkey", schema_org.by_name(thing, "company_size", {"size": ("numberOfEmployees",)}).alias("value"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand IN ('Brand#1', 'Brand#2') OR p_type = 'Brand#1' END AS passed FROM part""")
def prd05_tags(spark, d):
    rows = table(spark, d, "part").withColumn("tags", F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", "p_type")))
    return rows.select("p_partkey", criteria.outcome(criteria.Criterion("t", "t", "tag", ("tags",), ("Brand#1", "Brand#2"))).alias("passed"))


@query("""SELECT p_name AS name FROM part WHERE lower(p_name) IN ('cold widget', 'small gear', 'red ring') AND p_size <> 7""")
def dsc02_select_sources(spark, d):
    rows = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("slug"), F.array("p_type").alias("tags"), "p_size")
    names = rows.filter("lower(name) in ('cold widget', 'small gear', 'red ring')").select("name").distinct()
    out = discovery.select_sources(rows.filter("p_size <> 7"), names, ["ECONOMY"], rows.filter("false").select("name"))
    return out.select("name")


@query("""WITH q AS (SELECT lower(trim(p_name)) AS k, min(p_partkey) AS ord FROM part GROUP BY 1) SELECT ord FROM q WHERE k NOT IN (SELECT lower(p_name) FROM part WHERE p_size > 45) ORDER BY ord LIMIT 3""")
def dsc15_fresh_queries(spark, d):
    part = table(spark, d, "part")
    wanted = part.select(F.col("p_partkey").alias("ord"), F.concat(F.lit(" "), F.initcap("p_name")).alias("query"))
    return discovery.fresh_queries(wanted, part.filter("p_size > 45").select(F.upper("p_name").alias("query"))).select("ord")


@query(f"""SELECT engine, page_id FROM (SELECT page_id, page_id % 3 AS engine, row_number() OVER (PARTITION BY canonical ORDER BY page_id % 3, page_id) AS n FROM ({_CANONICAL})) WHERE n = 1 ORDER BY engine, page_id LIMIT 20""")
def src29_merged_engines(spark, d):
    rows = table(spark, d, "pages").select((F.col("page_id") % 3).alias("query_ord"), F.col("page_id").alias("hit_ord"), "url")
    return discovery.merge_hits(rows, 20).select(F.col("query_ord").alias("engine"), F.col("hit_ord").alias("page_id"))


@query("""SELECT c_custkey AS id, 'c_name+c_mktsegment:' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) || '|' || lower(c_mktsegment) AS key FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 5 = 0""")
def ded01_record_keys(spark, d):
    rows = table(spark, d, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).otherwise(" "))
    return rows.select(F.col("c_custkey").alias("id"), resolve.record_key(("c_name", "c_mktsegment")).alias("key"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 9 WHEN c_custkey % 2 = 0 THEN 0 ELSE 4 END AS rank FROM customer""")
def ded06_method_rank(spark, d):
    methods = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).when(F.col("c_custkey") % 2 == 0, F.array(F.lit("DOM"), F.lit("API"))).otherwise(F.array(F.lit("SEARCH"), F.lit("DOM")))
    return table(spark, d, "customer").select("c_custkey", resolve.method_rank(methods).alias("rank"))


@query(r"""SELECT c_custkey, trim(regexp_replace(lower(c_mktsegment) || ' ', '\b(?:inc|incorporated|llc|ltd|limited|gmbh|corp|corporation|co|plc|sa|ag|bv)\b\.?', '', 'g')) AS form FROM customer""")
def ded10_company_form(spark, d):
    name = F.concat(F.initcap("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, " Inc.").otherwise(" GmbH"))
    return table(spark, d, "customer").select("c_custkey", F.trim(discovery.company_form(name)).alias("form"))


@query("""SELECT n_nationkey AS id, n_name AS name, CASE WHEN s.k IS NOT NULL THEN s.n ELSE 0 END AS jobs FROM nation LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON k = n_nationkey""")
def mut04_registry_upsert(spark, d):
    old = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(0).cast("long").alias("jobs"), F.lit(0).alias("at"))
    counts = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.count("*").alias("jobs"))
    return state.upsert(old, old.drop("jobs", "at").join(counts, "id").withColumn("at", F.lit(1)), ["id"], "at").drop("at")


@query(r"""SELECT doc_id, contains(lower(text), '100%_sure') AS found FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' 100%_Sure' ELSE text || ' 100 xsure' END AS text FROM documents WHERE text IS NOT NULL)""")
def prd22_literal_search(spark, d):
    """Wildcards in what is looked for are plain characters."""
    rows = table(spark, d, "documents").filter("text is not null")
    rows = rows.select("doc_id", F.concat("text", F.when(F.col("doc_id") % 3 == 0, " 100%_Sure").otherwise(" 100 xsure")).alias("text"), F.lit(None).cast("long").alias("duplicate_of"))
    hit = reads.filtered(rows, reads.Filters(text="100%_sure"), ["text"]).select("doc_id", F.lit(True).alias("hit"))
    return rows.select("doc_id").join(hit, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("found"))


@query("""SELECT doc_id, replace(replace(nfc_normalize(text), chr(8203), ''), chr(65279), '') || CASE WHEN doc_id % 3 = 0 THEN ' fi 12 TM' ELSE '' END AS clean FROM documents""")
def k20_normalize_chars(spark, d):
    """Whole texts, some with signs that have a plain form: ligatures, wide digits, trade marks, marks that can't be seen."""
    odd = F.when(F.col("doc_id") % 3 == 0, "\u200b \ufb01\u200b \uff11\uff12\ufeff \u2122").otherwise("")
    return table(spark, d, "documents").select("doc_id", text.normalize_chars(F.concat("text", odd)).alias("clean"))


@query("""SELECT doc_id, text AS decoded FROM documents""")
def k25_decode_entities(spark, d):
    coded = F.col("text")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), ("é", "&eacute;"), ("'", "&#39;")):
        coded = F.replace(coded, F.lit(sign), F.lit(entity))
    return table(spark, d, "documents").select("doc_id", text.decode_entities(coded).alias("decoded"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1000 * (o_orderkey % 900) WHEN 1 THEN CAST(epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1994-01-01') AS BIGINT) * CAST(o_orderdate > TIMESTAMP '1994-01-01' AS BIGINT) WHEN 2 THEN 0 END AS wait FROM orders""")
def k54_retry_after(spark, d):
    """Seconds, dates before and after now, a negative number and words."""
    key, day = F.col("o_orderkey"), F.date_format(F.date_trunc("second", F.col("o_orderdate").cast("timestamp")), "EEE, d MMM yyyy HH:mm:ss 'GMT'")
    said = F.when(key % 4 == 0, (key % 900).cast("string")).when(key % 4 == 1, day).when(key % 4 == 2, "-5").otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", parsers.retry_after(said, F.lit("1994-01-01").cast("timestamp")).alias("wait"))


@query("""SELECT p_partkey, p_name AS title, p_name AS from_name, CASE WHEN p_partkey % 3 < 2 THEN p_name || '.pdf' END AS stated FROM part""")
def k52_file_titles(spark, d):
    """Titles with the marks of search engines, names of files, and names in headers: quoted, coded and missing ones."""
    key, name = F.col("p_partkey"), F.col("p_name")
    title = F.when(key % 4 == 0, F.concat(F.lit("[PDF] "), name)).when(key % 4 == 1, F.concat(name, F.lit(" (pdf)"))).when(key % 4 == 2, F.concat(name, F.lit(" - PDF"))).otherwise(F.concat(name, F.lit(".PDF")))
    file = F.concat(F.replace(name, F.lit(" "), F.lit("_")), F.lit(".pdf"))
    coded = F.concat(F.lit("inline; filename*=UTF-8''"), F.replace(name, F.lit(" "), F.lit("%20")), F.lit(".pdf"))
    header = F.when(key % 3 == 0, F.concat(F.lit('attachment; filename="'), name, F.lit('.pdf"'))).when(key % 3 == 1, coded).otherwise("inline")
    return table(spark, d, "part").select("p_partkey", parsers.file_title(title).alias("title"), parsers.name_title(file).alias("from_name"), parsers.disposition_name(header).alias("stated"))


@query("""SELECT c_custkey, array_to_string(list_filter(['name:' || c_name, CASE WHEN c_acctbal > 0 THEN 'balance:yes' END, CASE WHEN c_nationkey % 2 = 0 THEN 'segment:' || c_mktsegment END], lambda x: x IS NOT NULL), ';') AS fields FROM customer""")
def k63_compact_fields(spark, d):
    """Fields that a customer has; absent ones are no part of the map."""
    from ledgerframe.functions.evidence import compact

    kept = compact({"name": F.col("c_name"), "balance": F.when(F.col("c_acctbal") > 0, "yes"), "segment": F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment"))})
    said = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat_ws(":", e["key"], e["value"])), ";")
    return table(spark, d, "customer").select("c_custkey", said.alias("fields"))
