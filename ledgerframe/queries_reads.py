"""Registered queries of the store and the read path, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerframe.operators import criteria, reads, reports, resolve, store
from ledgerframe.queries import _RECORDS, _RUNS, _records, _runs, query, table
from ledgerframe.sources import export

# An event is a candidate of its user; a line of an order is a value of the order's record, its part the page it was read from.

_EVENTS = "SELECT event_id AS ord, user_id AS source, event_type AS external_id, user_id || ':' || event_type AS key, value, props FROM events"


def _candidates(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("external_id"), "value", "props")
    return rows.withColumn("key", store.candidate_key(F.col("source"), F.col("external_id")))


@query(f"SELECT key, ord, value, 'r1' AS run FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord DESC) AS n FROM ({_EVENTS})) WHERE n = 1")
def snk01_stored_records(spark, d):
    return store.stored(_candidates(spark, d), "r1").select("key", "ord", "value", "run")


def _evidence(spark, d):
    """Two values of each order, one method for both."""
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    way = F.when(F.col("o_orderstatus") == "F", "API").when(F.col("o_orderstatus") == "O", "DOM").otherwise("LLM")
    rows = o.withColumns({"method": way, "verified": F.col("o_totalprice") > 50_000, "url": F.concat(F.lit("https://orders/"), F.col("id").cast("string")), "page_id": F.col("id") % 97})
    return store.evidence_rows(rows, ["o_orderpriority", "o_orderstatus"], ["id"])


@query("""SELECT id, field, value, method, verified, CASE WHEN verified THEN CASE method WHEN 'API' THEN 0.99::DOUBLE WHEN 'DOM' THEN 0.88::DOUBLE ELSE 0.75::DOUBLE END ELSE 0.0::DOUBLE END AS confidence FROM (
            SELECT o_orderkey AS id, unnest(['o_orderpriority', 'o_orderstatus']) AS field, unnest([o_orderpriority, o_orderstatus]) AS value,
                   CASE WHEN o_orderstatus = 'F' THEN 'API' WHEN o_orderstatus = 'O' THEN 'DOM' ELSE 'LLM' END AS method, o_totalprice > 50000 AS verified FROM orders) WHERE trim(value) <> ''""")
def snk02_evidence_rows(spark, d):
    return _evidence(spark, d).select("id", "field", "value", "method", "verified", "confidence")


@query("""WITH e AS (SELECT o_orderkey AS id, o_orderpriority AS value FROM orders), n AS (SELECT o_orderkey AS id, 'again' AS value FROM orders WHERE o_orderkey % 5 = 0)
          SELECT id, value FROM e WHERE id % 5 <> 0 UNION ALL SELECT id, value FROM n""")
def mut02_replaced_evidence(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("value"))
    new = old.filter("id % 5 = 0").withColumn("value", F.lit("again"))
    return store.replaced(old, new, new, ["id"])


@query("""SELECT o_orderkey, CASE WHEN l.k IS NOT NULL THEN l.mode ELSE o_orderpriority END AS o_orderpriority FROM orders LEFT JOIN (SELECT l_orderkey AS k, min(l_returnflag) AS mode FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) l ON k = o_orderkey""")
def mut03_bulk_update(spark, d):
    values = table(spark, d, "lineitem").filter("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_returnflag").alias("o_orderpriority"))
    return store.updated(table(spark, d, "orders"), values, "o_orderkey", ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


_COPIES = """c AS (SELECT user_id::VARCHAR AS url, event_type AS via, props AS hash, 'f' AS final_url, 'b' || event_id AS body, event_id AS t FROM events WHERE event_id % 2 = 0),
             n AS (SELECT user_id::VARCHAR AS url, event_type AS via, props AS hash, 'f' AS final_url, 'b' || event_id AS body, event_id + 1000000000 AS t FROM events WHERE event_id % 2 = 1),
             l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url, via ORDER BY t DESC) AS r FROM n) WHERE r = 1), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url, via ORDER BY t DESC) AS r FROM c) WHERE r = 1),
             s AS (SELECT l.url, l.via, l.t AS moved, k.t AS old FROM l JOIN k ON l.url = k.url AND l.via = k.via AND l.hash = k.hash AND l.final_url = k.final_url)"""


@query(f"""WITH {_COPIES} SELECT c.url, c.via, c.hash, c.body, coalesce(s.moved, c.t) AS "at" FROM c LEFT JOIN s ON s.url = c.url AND s.via = c.via AND s.old = c.t
          UNION ALL SELECT l.url, l.via, l.hash, l.body, l.t FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.url = l.url AND s.via = l.via)""")
def snk09_page_copies(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("url"), F.col("event_type").alias("via"), F.col("props").alias("hash"), F.lit("f").alias("final_url"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("body"), F.col("event_id").alias("at"))
    return store.page_copies(e.filter("at % 2 = 0"), e.filter("at % 2 = 1").withColumn("at", F.col("at") + 1_000_000_000)).select("url", "via", "hash", "body", "at")


@query(f"SELECT count(*) FILTER (WHERE status = 'valid') AS valid, count(*) FILTER (WHERE status = 'incomplete') AS incomplete, count(*) FILTER (WHERE status = 'invalid') AS invalid FROM ({_RECORDS})")
def agg18_status_counts(spark, d):
    return store.status_counts(_records(spark, d))


@query("SELECT user_id, event_type, count(*) AS uses, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def agg17_use_totals(spark, d):
    return store.metric_totals(table(spark, d, "events"), ["user_id", "event_type"], ["value"]).withColumn("value", F.round("value", 4))


@query("SELECT count(*) AS pages, CAST(coalesce(sum(length(o_orderpriority)), 0) AS BIGINT) AS bytes FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def agg22_pruned(spark, d):
    cited = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return store.pruned(table(spark, d, "orders"), cited, "o_orderkey", "o_orderdate", F.lit("1996-01-01").cast("timestamp_ntz"), F.length("o_orderpriority"))


@query("SELECT l_orderkey AS run, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01') GROUP BY 1")
def jon08_events_of_unfinished_runs(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("finished_at"))
    events = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "run")
    return store.without_finished(events, runs, F.lit("1996-01-01").cast("timestamp_ntz")).groupBy("run").agg(F.count("*").alias("n"))


_SOURCES = """SELECT o_custkey AS ref, min(o_orderkey) AS ord, max(o_orderpriority) AS label, list_sort(list_distinct(list(o_orderstatus))) AS hits FROM orders WHERE year(o_orderdate) = {} GROUP BY 1"""


@query(f"""SELECT coalesce(a.ref, b.ref) AS ref, coalesce(a.label, b.label) AS label, a.ref IS NULL AS old, coalesce(a.ord, b.ord) AS ord, len(list_distinct(list_concat(coalesce(b.hits, []), coalesce(a.hits, [])))) AS n_hits
          FROM ({_SOURCES.format(1997)}) a FULL JOIN ({_SOURCES.format(1996)}) b ON a.ref = b.ref""")
def dsc12_merged_sources(spark, d):
    def of(year):
        rows = table(spark, d, "orders").filter(F.year("o_orderdate") == year)
        return rows.groupBy(F.col("o_custkey").alias("ref")).agg(F.min("o_orderkey").alias("ord"), F.max("o_orderpriority").alias("label"), F.array_sort(F.collect_set("o_orderstatus")).alias("hits"))

    found = store.merged_sources(of(1996), of(1997))
    return found.select("ref", "label", "old", "ord", F.size("hits").alias("n_hits"))


@query("""SELECT c_custkey AS ref, coalesce(w.included, true) AS included, coalesce(w.most, 40) AS most FROM customer LEFT JOIN (SELECT o_custkey, bool_and(o_orderstatus = 'F') AS included, CAST(count(*) AS INTEGER) AS most FROM orders GROUP BY 1) w ON o_custkey = c_custkey""")
def set03_kept_drafts(spark, d):
    drafts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("ref")).agg(F.every(F.col("o_orderstatus") == "F").alias("included"), F.count("*").cast("int").alias("most"))
    return store.kept_drafts(table(spark, d, "customer").select(F.col("c_custkey").alias("ref")), drafts, {"included": F.lit(True), "most": F.lit(40)})


@query("SELECT DISTINCT l_partkey AS ref FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def set02_new_refs(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("ref"), "l_returnflag")
    return store.new_refs([lines.filter("l_returnflag = 'R'"), lines.filter("l_returnflag <> 'R'")], table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("ref")))


# The read path

_WANTED = reads.Filters(status="valid", least_confidence=0.2, text="#00000", has={"balance": True})
_SHOWN = f"""SELECT * FROM ({_RECORDS}) WHERE duplicate_of IS NULL AND status = 'valid' AND confidence >= 0.2 AND contains(lower(name || ' ' || priority), '#00000') AND balance IS NOT NULL"""


@query(f"""SELECT id, name, confidence, total FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY confidence DESC, created_at, id) AS n FROM ({_SHOWN})) WHERE n > 20 AND n <= 70""")
def rdp01_record_page(spark, d):
    rows = _records(spark, d).withColumn("match_score", F.lit(0.0))
    return reads.page_of(reads.filtered(rows, _WANTED, ["name", "priority"]), 20, 50).select("id", "name", "confidence", "total")


@query(f"SELECT source, count(*) AS n, round(sum(price), 2) AS price FROM ({_SHOWN}) GROUP BY source")
def prd21_filtered_records(spark, d):
    rows = reads.filtered(_records(spark, d), _WANTED, ["name", "priority"])
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))


@query(f"SELECT id, count(*) FILTER (WHERE duplicate_of IS NULL) AS n FROM ({_RECORDS}) WHERE lower(priority) = '1-urgent' AND source = 'BUILDING' GROUP BY id")
def prd21_equal_fields(spark, d):
    wanted = reads.Filters(source="BUILDING", duplicates=True, equals={"priority": "1-URGENT"})
    return reads.filtered(_records(spark, d), wanted, ["name"]).groupBy("id").agg(F.count_if(F.col("duplicate_of").isNull()).alias("n"))


_LINES = "SELECT l_orderkey AS id, l_returnflag AS field, l_linestatus AS method, l_partkey AS page_id, l_quantity AS value FROM lineitem"


def _lines(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("field"), F.col("l_linestatus").alias("method"), F.col("l_partkey").alias("page_id"), F.col("l_quantity").alias("value"))


def _part_pages(spark, d):
    return table(spark, d, "part").filter("p_size <= 30").select(F.col("p_partkey").alias("page_id"), F.col("p_brand").alias("via"), F.col("p_size").alias("fetched_at"), F.col("p_type").alias("url"))


@query(f"""SELECT id, field, value, page_id, p_brand AS via, p_size AS fetched_at FROM ({_LINES}) LEFT JOIN (SELECT * FROM part WHERE p_size <= 30) ON p_partkey = page_id WHERE id IN (SELECT id FROM ({_RECORDS}) WHERE status = 'valid')""")
def rdp02_values_with_proof(spark, d):
    return reads.with_proof(_records(spark, d).filter("status = 'valid'"), _lines(spark, d), _part_pages(spark, d)).select("id", "field", "value", "page_id", "via", "fetched_at")


@query(f"SELECT field, count(*) AS n, round(sum(value), 2) AS value FROM ({_LINES}) WHERE id IN (SELECT id FROM ({_SHOWN})) GROUP BY field")
def jon04_export_values(spark, d):
    rows = reads.export_values(_records(spark, d), _lines(spark, d), _WANTED, ["name", "priority"])
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query(f"""WITH m AS (SELECT id, array_to_string(list_sort(list_distinct(list(field || ':' || method))), '; ') AS evidence_methods FROM ({_LINES}) GROUP BY id),
          s AS (SELECT *, CASE WHEN status = 'valid' THEN CAST(floor(50 * (0.5::DOUBLE + confidence) + 0.5::DOUBLE) AS INTEGER) END AS lead_score FROM ({_RECORDS}))
          SELECT name, CASE WHEN lead_score >= 80 THEN 'strong' WHEN lead_score >= 60 THEN 'good' WHEN lead_score IS NOT NULL THEN 'possible' END AS lead_tier, lead_score, status, '0.50' AS match_score, printf('%.2f', ((CAST(CAST(confidence * 1152921504606846976 AS BIGINT) AS HUGEINT) * 100 + 576460752303423488) // 1152921504606846976) / 100.0::DOUBLE) AS confidence, source, coalesce(evidence_methods, '') AS evidence_methods
          FROM s LEFT JOIN m ON m.id = s.id""")
def snk04_export_columns(spark, d):
    score = criteria.lead_score(F.col("status"), F.lit(0.5), F.col("confidence"))
    rows = _records(spark, d).withColumns({"match_score": F.lit(0.5), "lead_score": score}).withColumn("lead_tier", criteria.lead_tier(F.col("lead_score")))
    pairs = _lines(spark, d).select("id", F.concat_ws(":", "field", "method").alias("m")).distinct()
    methods = pairs.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("m")), "; ").alias("evidence_methods"))
    return reads.export_columns(rows, ["name"], methods)


@query(f"SELECT id, coalesce(nullif(concat_ws(', ', nullif(trim(priority), ''), CASE WHEN balance IS NOT NULL THEN name END), ''), id::VARCHAR) AS label FROM ({_RECORDS})")
def rdp03_labels(spark, d):
    rows = _records(spark, d)
    return rows.select("id", reads.label(F.col("priority"), F.when(F.col("balance").isNotNull(), F.col("name")), F.col("id").cast("string")).alias("label"))


_PHRASES = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in reads.SOURCE_WORDS.items())


@query(f"""SELECT event_id, CASE method {_PHRASES} ELSE method END AS said, CASE WHEN value >= 9 THEN 'Sure' WHEN value >= 7.5 THEN 'Likely' ELSE 'Check this' END AS certainty
          FROM (SELECT event_id, value, CASE event_type WHEN 'click' THEN 'API' WHEN 'view' THEN 'DOM' WHEN 'signup' THEN 'LLM' ELSE event_type END AS method FROM events)""")
def rdp04_phrases(spark, d):
    kind = F.col("event_type")
    rows = table(spark, d, "events").withColumn("method", F.when(kind == "click", "API").when(kind == "view", "DOM").when(kind == "signup", "LLM").otherwise(kind))
    return rows.select("event_id", reads.words_for(F.col("method"), reads.SOURCE_WORDS).alias("said"), reads.words_for(criteria.certainty(F.col("value") / 10), reads.CERTAINTY_WORDS).alias("certainty"))


@query("""WITH c AS (SELECT o_custkey AS request, o_orderkey AS version, o_orderpriority AS title FROM orders), n AS (SELECT request, max_by(title, version) AS title, max(version) AS version FROM c GROUP BY 1)
          SELECT event_id AS run, e.user_id AS request, title, version, c_name AS prompt FROM events e LEFT JOIN n ON n.request = e.user_id JOIN customer ON c_custkey = e.user_id""")
def rdp06_run_summaries(spark, d):
    runs = table(spark, d, "events").select(F.col("event_id").alias("run"), F.col("user_id").alias("request"))
    contracts = table(spark, d, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("title"))
    requests = table(spark, d, "customer").select(F.col("c_custkey").alias("request"), F.col("c_name").alias("prompt"))
    return reads.run_summaries(runs, contracts, requests).select("run", "request", "title", "version", "prompt")


@query("SELECT o_orderkey AS run, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def srt04_run_list(spark, d):
    return reads.run_list(table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("created_at")))


@query("SELECT event_id AS seq, event_type AS type FROM events WHERE user_id = (SELECT min(user_id) FROM events) AND event_id > 10 ORDER BY event_id LIMIT 500")
def srt03_event_cursor(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("run"), F.col("event_type").alias("type"))
    first = rows.agg(F.min("run")).first()[0]
    return reads.events_after(rows, F.lit(first), F.lit(10)).select("seq", "type")


_SAID = {"click": "Opened a page", "signup": "Found a lead", "error": "A source failed"}


@query("""SELECT user_id AS run, max(event_id) AS seq, max_by(CASE event_type WHEN 'click' THEN 'Opened a page' WHEN 'signup' THEN 'Found a lead' ELSE 'A source failed' END, event_id) AS line FROM events WHERE event_type IN ('click', 'signup', 'error') GROUP BY 1""")
def rdp08_latest_meaning(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("run"), F.col("event_type").alias("type"))
    return reads.latest_meaning(rows, _SAID)


@query("""SELECT source, reason, n FROM (SELECT source, priority AS reason, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, priority) AS k FROM (""" + _RECORDS + """) WHERE status <> 'valid' GROUP BY source, priority) WHERE k = 1""")
def agg11_top_reason(spark, d):
    return reads.top_reason(_records(spark, d).filter("status <> 'valid'"), "source", "priority")


@query("""WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'direct' WHEN 'view' THEN 'read' WHEN 'signup' THEN 'ai' WHEN 'error' THEN 'read' ELSE 'search' END AS trust FROM events)
          SELECT t.trust, count(e.trust) AS n, round(CAST(count(e.trust) AS DOUBLE) / (SELECT count(*) FROM e), 6) AS share FROM (VALUES ('direct'), ('read'), ('derived'), ('ai'), ('search')) t(trust) LEFT JOIN e ON e.trust = t.trust GROUP BY t.trust""")
def agg20_trust_split(spark, d):
    kind = F.col("event_type")
    return reads.trust_split(table(spark, d, "events").select(F.when(kind == "click", "API").when(kind == "view", "DOM").when(kind == "signup", "LLM").when(kind == "error", "REGEX").otherwise("SEARCH").alias("method")))


@query(f"""SELECT p_type AS url, max_by(p_partkey, CAST(p_size AS BIGINT) * 1000000000 + p_partkey) AS page_id FROM part WHERE p_size <= 30 AND p_partkey IN (SELECT page_id FROM ({_LINES}) WHERE method = 'F') GROUP BY 1""")
def jon07_page_last_read(spark, d):
    return reads.page_last_read(_part_pages(spark, d), _lines(spark, d), "F")


@query("""SELECT o_custkey AS plan, round(CAST(count(*) FILTER (WHERE l_orderkey IS NOT NULL) AS DOUBLE) / count(*), 6) AS ratio FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY 1""")
def set05_source_overlap(spark, d):
    plans = table(spark, d, "orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("ref"))
    return reads.overlap(plans, table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("ref")))


# Differences of runs, and who saw a record

_BOTH = f"""WITH {_RUNS}, b AS (SELECT * FROM r WHERE run = 1996), a AS (SELECT * FROM r WHERE run = 1997)"""


def _two_runs(spark, d):
    runs = _runs(spark, d)
    return runs.filter("run = 1996"), runs.filter("run = 1997")


@query(f"""{_BOTH} SELECT count(*) FILTER (WHERE b.item IS NULL) AS added, count(*) FILTER (WHERE a.item IS NULL) AS removed, count(*) FILTER (WHERE a.item IS NOT NULL AND b.item IS NOT NULL AND (a.price <> b.price OR a.n <> b.n)) AS changed,
          count(*) FILTER (WHERE a.item IS NOT NULL AND b.item IS NOT NULL AND a.price = b.price AND a.n = b.n) AS unchanged FROM a FULL JOIN b ON a.item = b.item""")
def agg08_difference_counts(spark, d):
    return reports.difference_counts(reports.difference(*_two_runs(spark, d), "item", ["price", "n"]))


@query(f"""{_BOTH} SELECT a.item, 'n' AS field, b.n::VARCHAR AS before, a.n::VARCHAR AS after FROM a JOIN b ON a.item = b.item WHERE a.n <> b.n""")
def agg08_difference_values(spark, d):
    return reports.difference_values(*_two_runs(spark, d), "item", ["n"])


@query(f"""{_BOTH}, k AS (SELECT coalesce(a.item, b.item) AS item, CASE WHEN b.item IS NULL THEN 'added' WHEN a.item IS NULL THEN 'removed' ELSE 'changed' END AS kind, CASE WHEN a.item IS NULL OR b.item IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.price IS DISTINCT FROM b.price THEN 'price' END, CASE WHEN a.n IS DISTINCT FROM b.n THEN 'n' END) END AS fields
          FROM a FULL JOIN b ON a.item = b.item WHERE a.item IS NULL OR b.item IS NULL OR a.price <> b.price OR a.n <> b.n)
          SELECT * FROM (SELECT kind, item, fields, CAST(row_number() OVER (PARTITION BY kind ORDER BY item) AS INTEGER) AS place FROM k) WHERE place <= 50""")
def agg08_difference_lists(spark, d):
    return reports.difference_lists(reports.difference(*_two_runs(spark, d), "item", ["price", "n"]), "item", "item")


@query(f"""WITH k AS (SELECT id, source, duplicate_of FROM ({_RECORDS})), o AS (SELECT duplicate_of AS keeper, list_sort(list_distinct(list(source))) AS labels FROM k WHERE duplicate_of IS NOT NULL GROUP BY 1)
          SELECT id, array_to_string(list_concat([source], list_filter(coalesce(labels, []), lambda x: x <> source)), ', ') AS seen_on FROM k LEFT JOIN o ON keeper = id""")
def ded07_seen_on(spark, d):
    rows = _records(spark, d).withColumn("label", F.col("source"))
    return resolve.seen_on(rows).select("id", F.array_join("seen_on", ", ").alias("seen_on"))


@query(f"""SELECT id, '{{"name":"' || name || '","_status":"' || status || '","_lead_tier":null,"_lead_score":null,"_evidence":[{{"field":"name","value":"' || name || '","method":"API"}}]}}' AS value FROM ({_RECORDS})""")
def snk05_json_records(spark, d):
    rows = _records(spark, d).withColumns({"lead_tier": F.lit(None).cast("string"), "lead_score": F.lit(None).cast("int")})
    proof = rows.select("id", F.lit("name").alias("field"), F.col("name").alias("value"), F.lit("API").alias("method"))
    return export.json_records(rows, proof, ["name"])


@query("""SELECT c_custkey AS id, 'c_mktsegment+place:' || lower(c_mktsegment) || '|' || CASE WHEN c_nationkey % 3 = 0 THEN 'remote' ELSE 'city ' || c_nationkey END AS key FROM customer""")
def ded02_key_forms(spark, d):
    """Places are compared by their city, whatever stands after it."""
    from ledgerframe.functions.parsers import location_bucket

    place = F.when(F.col("c_nationkey") % 3 == 0, "Fully remote").otherwise(F.concat(F.lit("City "), F.col("c_nationkey").cast("string"), F.lit(", Region; Elsewhere")))
    rows = table(spark, d, "customer").withColumn("place", place)
    return rows.select(F.col("c_custkey").alias("id"), resolve.record_key(("c_mktsegment", "place"), (), {"place": location_bucket}).alias("key"))


_KEPT = "SELECT CAST(o_custkey AS VARCHAR) AS key, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS priority, max(o_orderkey) AS ord FROM orders"


@query(f"""WITH a AS (SELECT 'all' AS run, * FROM ({_KEPT} GROUP BY o_custkey)), f AS (SELECT 'finished/1996' AS run, * FROM ({_KEPT} WHERE o_orderstatus = 'F' GROUP BY o_custkey)), r AS (SELECT * FROM a UNION ALL SELECT * FROM f)
          SELECT run, key, status, priority, ord, CASE WHEN run = 'all' THEN 2 ELSE 1 END AS n_values FROM r""")
def snk01_written_store(spark, d):
    """Two runs as readers find them: one was stored before with other rows, then killed while it was written again, and stored at last."""
    from ledgerframe.session import scratch

    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("ord"), F.lit("API").alias("method"), F.lit(True).alias("verified"))
    written = store.RunStore(spark, scratch(spark, "run-store"))
    proof = lambda rows, fields: store.evidence_rows(rows, fields, ["key"])
    old, every, some = store.stored(o.filter("ord % 3 = 0"), "all"), store.stored(o, "all"), store.stored(o.filter("status = 'F'"), "finished/1996")
    written.write("all", old, proof(old, ["status"]))
    written.write_attempt("all", "killed", old.limit(5), proof(old.limit(5), ["priority"]))
    written.write("finished/1996", some, proof(some, ["status"]))
    written.write("all", every, proof(every, ["status", "priority"]))
    values = written.read("evidence").groupBy("run", "key").agg(F.count("*").cast("int").alias("n_values"))
    return written.read("records").join(values, ["run", "key"]).select("run", "key", "status", "priority", "ord", "n_values")
