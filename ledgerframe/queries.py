"""The registered queries of the library's own operators, with the SQL that each must equal.

Names start with the operator's row in the survey. All run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ledgerframe.functions import dom, header, parsers, text, url
from ledgerframe.operators import criteria, discovery, elements, recipes, reports, resolve, state
from ledgerframe.plans import compiler
from ledgerframe.sources import export
from ledgerframe.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# URLs

_TRACKED = "'" + "', '".join(url.TRACKING) + "'"
_SITE = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), ':[0-9]*$', ''), '^www\.', '')"
_CANONICAL = rf"""
    SELECT page_id, url, {_SITE} AS site,
           'https://' || {_SITE} || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '')
           || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical
    FROM (SELECT page_id, url, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
            lambda p: p <> '' AND NOT (starts_with(lower(string_split(p, '=')[1]), 'utm_') OR lower(string_split(p, '=')[1]) IN ({_TRACKED})))), '&') AS q
          FROM pages)"""


@query(f"SELECT page_id, canonical FROM ({_CANONICAL})")
def k01_canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", url.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT site, CAST(count(*) AS BIGINT) AS n_pages, CAST(count(DISTINCT canonical) AS BIGINT) AS n_canonical FROM ({_CANONICAL}) GROUP BY site")
def k04_host_rollup(spark, d):
    rows = table(spark, d, "pages").select(url.site_of(F.col("url")).alias("site"), url.canonical_url(F.col("url")).alias("c"))
    return rows.groupBy("site").agg(F.count("*").alias("n_pages"), F.count_distinct("c").alias("n_canonical"))


@query(f"SELECT canonical, min(page_id) AS page_id FROM ({_CANONICAL}) GROUP BY canonical")
def ded12_first_url_wins(spark, d):
    rows = table(spark, d, "pages").withColumn("canonical", url.canonical_url(F.col("url")))
    return resolve.first_wins(rows, F.col("canonical"), ["page_id"]).select("canonical", "page_id")


@query(r"""SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1))
             || repeat('/*', len(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> ''))) AS pattern FROM pages""")
def k06_url_pattern(spark, d):
    return table(spark, d, "pages").select("page_id", url.url_pattern(F.col("url")).alias("pattern"))


# Text

@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(text), '&', ' and '), '\\bsr\\b\\.?', 'senior', 'g'), '\\bjr\\b\\.?', 'junior', 'g'),
            '[^a-z0-9]+', ' ', 'g')) AS normal FROM documents""".replace("\\\\", "\\"))
def ded03_normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE
            (CASE WHEN contains(cut, ' ') AND 79 - instr(reverse(cut), ' ') > 48 THEN substr(cut, 1, CAST(79 - instr(reverse(cut), ' ') AS BIGINT)) ELSE cut END) || '…' END AS short
          FROM (SELECT doc_id, text, substr(text, 1, 79) AS cut FROM documents)""")
def k26_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 80).alias("short"))


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda t: trim(regexp_replace(t, '[ \t]+', ' ', 'g'))), lambda t: t <> ''), chr(10)) AS clean FROM documents""")
def k21_collapse_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", text.collapse_lines(F.col("text")).alias("clean"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(cell, '[",\r\n]') THEN '"' || replace(cell, '"', '""') || '"' ELSE cell END AS cell
          FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '^(?:[\t\r]|\s*[=+\-@])') THEN '''' || text ELSE text END AS cell FROM documents)""")
def snk03_csv_cell(spark, d):
    return table(spark, d, "documents").select("doc_id", text.csv_cell(F.col("text")).alias("cell"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(t, '\bhybrid\b') THEN 'hybrid' WHEN regexp_matches(t, '\b(?:no|not|non)[\s-]+remote\b') THEN 'onsite'
             WHEN regexp_matches(t, '\b(?:remote|wfh|work from home|work from anywhere|distributed|anywhere)\b') THEN 'remote'
             WHEN regexp_matches(t, '\b(?:on[\s-]?site|in[\s-]office|in person|office[\s-]based)\b') THEN 'onsite' END AS arrangement
          FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def k43_arrangement(spark, d):
    return table(spark, d, "documents").select("doc_id", parsers.arrangement(F.col("text")).alias("arrangement"))


@query(r"""SELECT event_id, CASE event_type WHEN 'click' THEN k * 1000 WHEN 'view' THEN k * 1000000 WHEN 'signup' THEN k * 1000 WHEN 'error' THEN k * 1000000000 + 500000000 ELSE k END AS n
          FROM (SELECT event_id, event_type, CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k FROM events)""")
def k47_parse_count(spark, d):
    """Counts with a letter, a word, commas, a fraction, and bare ones."""
    k, kind = F.regexp_extract("props", r"(\d+)", 1), F.col("event_type")
    said = F.concat(F.lit("about "), k, F.when(kind == "click", "K followers").when(kind == "view", " million").when(kind == "signup", ",000 subscribers").when(kind == "error", ".5b").otherwise(" posts"))
    return table(spark, d, "events").select("event_id", parsers.parse_count(said).alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def k76_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT p_partkey, CASE WHEN p_name IS NULL OR p_name = '' THEN 'unknown' ELSE coalesce(nullif(regexp_replace(regexp_replace(lower(trim(string_split(p_name, ',')[1])), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g'), ''), 'unknown') END AS bucket
          FROM part""".replace("\\\\", "\\"))
def ded09_location_bucket(spark, d):
    return table(spark, d, "part").select("p_partkey", parsers.location_bucket(F.col("p_name")).alias("bucket"))


_GRAMS = """g AS (SELECT DISTINCT name, substr('  ' || w || ' ', CAST(i AS BIGINT), 3) AS gram FROM (SELECT name, unnest(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM n) t, range(1, 60) r(i) WHERE i <= length(w) + 1),
            c AS (SELECT name, count(*) AS n FROM g GROUP BY name)"""


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), {_GRAMS}
          SELECT a, b, similarity FROM (SELECT a.name AS a, b.name AS b, round(CAST(count(*) AS DOUBLE) / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS similarity
          FROM g a JOIN g b ON a.gram = b.gram AND a.name < b.name JOIN c x ON x.name = a.name JOIN c y ON y.name = b.name GROUP BY a.name, b.name) WHERE similarity >= 0.4""")
def k64_trigram_pairs(spark, d):
    """Pairs of part names that are at least 0.4 alike."""
    names = table(spark, d, "part").select(F.col("p_name").alias("text")).distinct().withColumn("grams", text.trigrams(F.col("text")))
    pairs = discovery.similar_texts(names, names, 0.4).filter("text < other")
    return pairs.select(F.col("text").alias("a"), F.col("other").alias("b"), F.round("similarity", 6).alias("similarity"))


# Criteria and scores

_WISHES = (
    criteria.Criterion("c1", "a widget or ring", "keyword_any", ("p_name",), ("widget", "ring"), hard=True),
    criteria.Criterion("c2", "not economy", "keyword_none", ("p_type",), ("economy",), weight=2.0),
    criteria.Criterion("c3", "brand 1x", "regex", ("p_brand",), (r"brand#1\d",), weight=1.0),
    criteria.Criterion("c4", "standard", "equals", ("p_type",), ("STANDARD", "promo"), weight=1.0),
)
_MATCH = r"""
    SELECT p_partkey, c1, c2, c3, c4, (CASE WHEN c2 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN c3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN c4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 4.0::DOUBLE AS match_score
    FROM (SELECT p_partkey, regexp_matches(coalesce(p_name, ''), '(?i)(?:^|[^a-z0-9])(?:widget|ring)') AS c1,
                 NOT regexp_matches(coalesce(p_type, ''), '(?i)(?:^|[^a-z0-9])(?:economy)') AS c2,
                 regexp_matches(coalesce(p_brand, ''), '(?i)brand#1\d') AS c3,
                 CASE WHEN trim(coalesce(p_type, '')) <> '' THEN lower(trim(p_type)) IN ('standard', 'promo') END AS c4 FROM part)"""


def _matched(spark, d):
    rows = criteria.match(table(spark, d, "part"), _WISHES)
    return rows.withColumns({c.id: F.get("signals", F.lit(i))["passed"] for i, c in enumerate(_WISHES)})


@query(f"SELECT * FROM ({_MATCH})")
def prd10_criteria_match(spark, d):
    return _matched(spark, d).select("p_partkey", "c1", "c2", "c3", "c4", "match_score")


@query(f"""SELECT p_partkey, coalesce(nullif(concat_ws(' ', CASE WHEN good <> '' THEN 'Matches: ' || good || '.' END, CASE WHEN bad <> '' THEN 'Not confirmed: ' || bad || '.' END), ''), 'No criteria confirmed.') AS reason
          FROM (SELECT p_partkey, concat_ws('; ', CASE WHEN c1 THEN 'a widget or ring' END, CASE WHEN c2 THEN 'not economy' END, CASE WHEN c3 THEN 'brand 1x' END, CASE WHEN c4 THEN 'standard' END) AS good,
                       concat_ws('; ', CASE WHEN NOT c2 THEN 'not economy' END, CASE WHEN NOT c3 THEN 'brand 1x' END, CASE WHEN NOT c4 THEN 'standard' END) AS bad FROM ({_MATCH}))""")
def prd11_match_reason(spark, d):
    return _matched(spark, d).select("p_partkey", F.col("match_reason").alias("reason"))


@query("""SELECT p_partkey, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part
          WHERE regexp_matches(p_name, '(?i)(?:^|[^a-z0-9])(?:widget|ring|gear)') AND NOT regexp_matches(p_name, '(?i)(?:^|[^a-z0-9])(?:red)')) WHERE n <= 40""")
def stp04_prefilter(spark, d):
    return criteria.prefilter(table(spark, d, "part"), ("p_name",), ("widget", "ring", "gear"), ("red",), 40, by="p_type", order="p_partkey").select("p_partkey", "p_type")


# Records for the reports: an order is a record of its customer's segment, its status and price stand for what was found.

_RECORDS = """
    SELECT o_orderkey AS id, c_mktsegment AS source, o_orderkey AS ord, o_custkey AS item, o_orderdate AS created_at,
           CASE o_orderstatus WHEN 'F' THEN 'valid' WHEN 'O' THEN 'incomplete' ELSE 'invalid' END AS status,
           least(o_totalprice / 500000.0::DOUBLE, 1.0::DOUBLE) AS confidence, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey - 1 END AS duplicate_of, o_orderpriority AS priority,
           o_totalprice AS price, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance
    FROM orders JOIN customer ON o_custkey = c_custkey"""


def _records(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.when(F.col("o_orderstatus") == "F", "valid").when(F.col("o_orderstatus") == "O", "incomplete").otherwise("invalid")
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("source"), F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("item"), F.col("o_orderdate").alias("created_at"), status.alias("status"),
        F.least(F.col("o_totalprice") / 500_000.0, F.lit(1.0)).alias("confidence"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") - 1).alias("duplicate_of"), F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"),
    )


@query(f"""SELECT id, score, CASE WHEN score >= 80 THEN 'strong' WHEN score >= 60 THEN 'good' WHEN score IS NOT NULL THEN 'possible' END AS tier, sure
          FROM (SELECT id, CASE WHEN status = 'valid' THEN CAST(floor(50 * (0.5::DOUBLE + confidence) + 0.5::DOUBLE) AS INTEGER) END AS score,
                       CASE WHEN confidence >= 0.9 THEN 'sure' WHEN confidence >= 0.75 THEN 'likely' ELSE 'check' END AS sure FROM ({_RECORDS}))""")
def prd20_lead_tiers(spark, d):
    rows = _records(spark, d)
    score = criteria.lead_score(F.col("status"), F.lit(0.5), F.col("confidence"))
    return rows.select("id", score.alias("score"), criteria.lead_tier(score).alias("tier"), criteria.certainty(F.col("confidence")).alias("sure"))


@query(f"""SELECT CAST(count(*) FILTER (WHERE duplicate_of IS NULL) AS BIGINT) AS n_unique, CAST(count(*) FILTER (WHERE duplicate_of IS NULL AND status = 'valid') AS BIGINT) AS n_valid,
            CAST(count(*) FILTER (WHERE duplicate_of IS NULL AND status = 'incomplete') AS BIGINT) AS n_incomplete, CAST(count(*) FILTER (WHERE duplicate_of IS NULL AND status = 'invalid') AS BIGINT) AS n_invalid,
            CAST(count(*) FILTER (WHERE duplicate_of IS NOT NULL) AS BIGINT) AS n_duplicates FROM ({_RECORDS})""")
def agg01_quality_totals(spark, d):
    return reports.quality_totals(_records(spark, d))


@query(f"""WITH k AS (SELECT * FROM ({_RECORDS}) WHERE duplicate_of IS NULL AND status <> 'invalid')
          SELECT field, filled, total, CASE WHEN total > 0 THEN round(CAST(filled AS DOUBLE) / total, 6) ELSE 0.0::DOUBLE END AS rate FROM (
            SELECT 'name' AS field, count(name) AS filled, count(*) AS total FROM k UNION ALL SELECT 'balance', count(balance), count(*) FROM k UNION ALL SELECT 'price', count(price), count(*) FROM k)""")
def agg02_completeness(spark, d):
    return reports.completeness(_records(spark, d), ["name", "balance", "price"])


_EVIDENCE = "SELECT CASE event_type WHEN 'click' THEN 'API' WHEN 'view' THEN 'DOM' WHEN 'error' THEN 'REGEX' WHEN 'signup' THEN 'LLM' ELSE 'SEARCH' END AS method, value > 5 AS verified FROM events"


@query(f"""SELECT m.method, count(e.method) AS n, round(coalesce(avg(CAST(e.verified AS DOUBLE)), 0), 6) AS verified_rate
          FROM (VALUES {', '.join(f"('{m}')" for m in criteria.METHODS)}) m(method) LEFT JOIN ({_EVIDENCE}) e ON e.method = m.method GROUP BY m.method""")
def agg03_method_mix(spark, d):
    kind = F.col("event_type")
    rows = table(spark, d, "events").select(F.when(kind == "click", "API").when(kind == "view", "DOM").when(kind == "error", "REGEX").when(kind == "signup", "LLM").otherwise("SEARCH").alias("method"), (F.col("value") > 5).alias("verified"))
    return reports.method_mix(rows, criteria.METHODS)


@query(f"""SELECT low, high, n FROM (SELECT r.low, r.high, (SELECT count(*) FROM ({_RECORDS}) k WHERE duplicate_of IS NULL AND status <> 'invalid' AND confidence >= r.low AND confidence < r.upto) AS n
          FROM (VALUES (0.0::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE), (0.5::DOUBLE, 0.75::DOUBLE, 0.75::DOUBLE), (0.75::DOUBLE, 0.9::DOUBLE, 0.9::DOUBLE), (0.9::DOUBLE, 1.0::DOUBLE, 1.0001::DOUBLE)) r(low, high, upto))""")
def agg05_confidence_histogram(spark, d):
    return reports.histogram(_records(spark, d))


@query(f"""SELECT reason, n FROM (SELECT priority AS reason, count(*) AS n, min(ord) AS first FROM ({_RECORDS}) WHERE duplicate_of IS NULL AND status <> 'valid' GROUP BY priority) ORDER BY n DESC, first LIMIT 10""")
def agg06_reject_reasons(spark, d):
    return reports.reject_reasons(_records(spark, d).withColumn("reasons", F.array("priority")))


@query(f"""SELECT source, count(*) FILTER (WHERE duplicate_of IS NULL AND status <> 'invalid') AS kept, count(*) FILTER (WHERE duplicate_of IS NULL AND status = 'valid') AS valid,
            count(*) FILTER (WHERE duplicate_of IS NOT NULL) AS duplicates FROM ({_RECORDS}) GROUP BY source""")
def agg07_by_source(spark, d):
    return reports.by_source(_records(spark, d))


_RUNS = """r AS (SELECT o_custkey AS item, year(o_orderdate) AS run, max(o_totalprice) AS price, count(*) AS n FROM orders GROUP BY ALL)"""


def _runs(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("item"), F.year("o_orderdate").alias("run")).agg(F.max("o_totalprice").alias("price"), F.count("*").alias("n"))


@query(f"""WITH {_RUNS}, b AS (SELECT * FROM r WHERE run = 1996), a AS (SELECT * FROM r WHERE run = 1997)
          SELECT coalesce(a.item, b.item) AS item, CASE WHEN b.item IS NULL THEN 'added' WHEN a.item IS NULL THEN 'removed' WHEN a.price IS DISTINCT FROM b.price OR a.n IS DISTINCT FROM b.n THEN 'changed' ELSE 'unchanged' END AS kind,
                 CASE WHEN a.item IS NULL OR b.item IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.price IS DISTINCT FROM b.price THEN 'price' END, CASE WHEN a.n IS DISTINCT FROM b.n THEN 'n' END) END AS fields
          FROM a FULL JOIN b ON a.item = b.item""")
def agg08_run_diff(spark, d):
    runs = _runs(spark, d)
    return reports.difference(runs.filter("run = 1996"), runs.filter("run = 1997"), "item", ["price", "n"])


@query(f"""WITH {_RUNS}, k AS (SELECT DISTINCT item FROM r WHERE run = 1996 AND n > 1)
          SELECT a.item, a.n > 1 AND k.item IS NULL AS is_new FROM r a LEFT JOIN k ON k.item = a.item WHERE a.run = 1997""")
def jon05_is_new(spark, d):
    runs = _runs(spark, d).withColumn("kept", F.col("n") > 1)
    return state.is_new(runs.filter("run = 1997"), runs.filter("run = 1996"), "item").select("item", "is_new")


@query("""SELECT o_orderkey AS id, (SELECT max_by(p.o_orderkey, p.o_orderdate::VARCHAR || lpad(p.o_orderkey::VARCHAR, 12, '0')) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'F'
             AND (p.o_orderdate < o.o_orderdate OR (p.o_orderdate = o.o_orderdate AND p.o_orderkey < o.o_orderkey))) AS previous FROM orders o""")
def agg09_previous_run(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate", "o_orderstatus")
    return state.previous_run(rows, "o_custkey", ["o_orderdate", "id"], F.col("o_orderstatus") == "F").select("id", "previous")


@query(f"""WITH s AS (SELECT source AS "group", count(*) AS stored, count(*) FILTER (WHERE price > 50000) AS qualified, count(*) FILTER (WHERE price > 50000 AND status = 'valid') AS complete,
              count(*) FILTER (WHERE price > 50000 AND status = 'valid' AND duplicate_of IS NULL) AS ready FROM ({_RECORDS}) GROUP BY source),
          c AS (SELECT c_mktsegment AS "group", count(*) * 12 AS raw FROM customer GROUP BY 1),
          x AS (SELECT s.*, greatest(coalesce(raw, 0), stored) AS collected, stored - qualified AS l1, qualified - complete AS l2, complete - ready AS l3 FROM s LEFT JOIN c USING ("group"))
          SELECT "group", collected, qualified, complete, ready, CASE WHEN greatest(l1, l2, l3) = 0 THEN NULL WHEN l1 = greatest(l1, l2, l3) THEN 'qualified' WHEN l2 = greatest(l1, l2, l3) THEN 'complete' ELSE 'ready' END AS loss_step, greatest(l1, l2, l3) AS loss FROM x""")
def agg10_funnel(spark, d):
    rows = _records(spark, d).withColumn("failed_hard", F.col("price") <= 50_000).withColumn("group", F.col("source"))
    raw = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("group")).agg((F.count("*") * 12).alias("raw"))
    return reports.funnel(rows, raw)


_DECISIONS = """SELECT event_id, event_type AS task, CASE WHEN value > 50 THEN 'RULE' WHEN value > 20 THEN 'CACHE' WHEN value >= 8 OR value <= 2 THEN 'MODEL' ELSE 'DEFAULT' END AS tier,
    CASE WHEN value > 50 THEN 'yes' WHEN value > 20 THEN 'no' WHEN value >= 8 THEN 'yes' WHEN value <= 2 THEN 'no' ELSE 'unknown' END AS label FROM events"""


def _decisions(spark, d):
    v = F.col("value")
    tiers = [("RULE", F.when(v > 50, "yes")), ("CACHE", F.when(v > 20, "no")), ("MODEL", state.band(v / 10, 0.8, 0.2))]
    return state.decide(table(spark, d, "events").withColumn("task", F.col("event_type")), tiers)


@query(f"SELECT event_id, tier, label FROM ({_DECISIONS})")
def dec01_decide(spark, d):
    return _decisions(spark, d).select("event_id", "tier", "label")


@query(f"""SELECT task, count(*) AS n, count(*) FILTER (WHERE tier = 'RULE') AS "n_RULE", count(*) FILTER (WHERE tier = 'CACHE') AS "n_CACHE", count(*) FILTER (WHERE tier = 'MODEL') AS "n_MODEL",
            count(*) FILTER (WHERE tier = 'DEFAULT') AS "n_DEFAULT" FROM ({_DECISIONS}) GROUP BY task""")
def agg12_decision_summary(spark, d):
    return reports.decision_summary(_decisions(spark, d), ("RULE", "CACHE", "MODEL", "DEFAULT"))


@query("""WITH b AS (SELECT event_id, event_type, user_id, value, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 20 AS INTEGER) AS batch FROM events),
          f AS (SELECT user_id, min(batch) AS first FROM b WHERE value > 40 GROUP BY user_id)
          SELECT event_id, batch, coalesce(batch < first, true) AS judged FROM b LEFT JOIN f USING (user_id)""")
def dec05_judge_batches(spark, d):
    return state.judged(table(spark, d, "events"), "user_id", ["event_id"], F.col("value") > 40).select("event_id", "batch", "judged")


@query("""WITH s AS (SELECT 0.55::DOUBLE * least(n_chars / 3000.0::DOUBLE, 1.0::DOUBLE) + 0.45::DOUBLE * quality AS p, quality = 1 AS t FROM documents JOIN labels USING (doc_id)),
          g AS (SELECT y, n FROM (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) a(y), (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) b(n)),
          c AS (SELECT y, n, count(*) AS total, count(*) FILTER (WHERE p >= y) AS cy, count(*) FILTER (WHERE p >= y AND t) AS ty, count(*) FILTER (WHERE p <= n) AS cn, count(*) FILTER (WHERE p <= n AND NOT t) AS tn FROM g, s GROUP BY y, n)
          SELECT y AS yes, n AS "no", round(CAST(cy + cn AS DOUBLE) / total, 6) AS coverage, cy AS n_yes, cn AS n_no FROM c
          WHERE cy + cn >= 5 AND ty >= 0.9 * cy AND tn >= 0.9 * cn AND cy > 0 AND cn > 0 ORDER BY coverage DESC, y, n DESC LIMIT 1""")
def agg19_calibration(spark, d):
    """Probabilities that lean to the label and are blurred by a text's length, at the default precision."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    samples = rows.select((0.55 * F.least(F.col("n_chars") / 3_000.0, F.lit(1.0)) + 0.45 * F.col("quality")).alias("probability"), (F.col("quality") == 1).alias("truth"))
    return reports.calibration(samples, [0.5, 0.6, 0.7, 0.8, 0.9], [0.02, 0.05, 0.1, 0.2])


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW), 4) AS spent FROM events""")
def str14_rolling_spend(spark, d):
    return reports.rolling_spend(table(spark, d, "events").withColumnRenamed("user_id", "account")).select("event_id", "spent")


@query("""SELECT c_custkey, round(coalesce(o.cost, 0) + coalesce(e.cost, 0), 4) AS cost FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS cost FROM orders GROUP BY 1) o ON o_custkey = c_custkey
          LEFT JOIN (SELECT user_id, sum(value) AS cost FROM events GROUP BY 1) e ON user_id = c_custkey""")
def agg13_run_cost(spark, d):
    calls, searches = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_totalprice").alias("cost")), table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("value").alias("cost"))
    return reports.run_costs(table(spark, d, "customer").select(F.col("c_custkey").alias("run")), [calls, searches]).select(F.col("run").alias("c_custkey"), "cost")


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) <= 200 AS allowed FROM events""")
def str12_budget(spark, d):
    return reports.within_budget(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 200).select("event_id", "allowed")


# Entity resolution

_KEYED = """k AS (SELECT doc_id AS id, md5(text) AS key FROM documents UNION ALL SELECT doc_id, source || '|' || n_chars::VARCHAR FROM documents)"""


@query(f"""WITH RECURSIVE {_KEYED}, h AS (SELECT key, min(id) AS head FROM k GROUP BY key), e AS (SELECT DISTINCT k.id AS a, h.head AS b FROM k JOIN h USING (key)),
          e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c(id, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e2.a, c.label FROM c JOIN e2 ON e2.b = c.id WHERE c.label < e2.a)
          SELECT id, min(label) AS cluster FROM c GROUP BY id""")
def ded04_clusters(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    return resolve.clusters(docs, [F.md5("text"), F.concat_ws("|", "source", F.col("n_chars").cast("string"))])


@query("""WITH r AS (SELECT c_custkey AS id, c_nationkey::VARCHAR || c_mktsegment AS cluster, c_nationkey % 3 AS rank, c_acctbal AS confidence, length(c_name) AS completeness FROM customer),
          b AS (SELECT *, first_value(id) OVER (PARTITION BY cluster ORDER BY rank, confidence DESC, completeness DESC, id) AS keeper FROM r)
          SELECT id, CASE WHEN keeper <> id THEN keeper END AS duplicate_of FROM b""")
def ded05_keepers(spark, d):
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("cluster"), (F.col("c_nationkey") % 3).alias("method_rank"), F.col("c_acctbal").alias("confidence"),
        F.length("c_name").alias("completeness"), F.lit(0).alias("created_at"),
    )
    return resolve.keepers(rows).select("id", "duplicate_of")


# State

@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def str08_latest(spark, d):
    return reports.latest(table(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "value")


@query("""SELECT user_id, event_type, event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 6 HOURS""")
def str08_ttl(spark, d):
    rows = table(spark, d, "events").withColumnRenamed("event_id", "id")
    return state.fresh(rows, ["user_id", "event_type"], "ts", F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), "6 hours").select("user_id", "event_type", "id")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def mut07_retention(spark, d):
    cited = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return state.retained(table(spark, d, "orders"), cited, "o_orderkey", "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query("""SELECT o_orderkey AS id, CAST(row_number() OVER w AS INTEGER) AS version, lag(o_orderkey) OVER w AS parent, lead(o_orderkey) OVER w IS NULL AS active FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def mut05_versions(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate")
    return state.versions(rows, "o_custkey", ["o_orderdate", "id"]).select("id", "version", "parent", "active")


@query("""WITH n AS (SELECT user_id, event_type, value, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'), o AS (SELECT user_id, event_type, value, event_id FROM events WHERE ts < TIMESTAMP '2024-01-20'),
          a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM o) WHERE r = 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM n) WHERE r = 1)
          SELECT user_id, event_type, value, event_id FROM b UNION ALL SELECT user_id, event_type, value, event_id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND b.event_type = a.event_type)""")
def mut01_upsert(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "value", "event_id", "ts")
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    old = reports.latest(rows.filter(F.col("ts") < cut), ["user_id", "event_type"], [F.desc("event_id")])
    return state.upsert(old, rows.filter(F.col("ts") >= cut), ["user_id", "event_type"], "event_id").drop("ts")


# Events in time

@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def str02_tumbling(spark, d):
    return streams.tumbling(table(spark, d, "events"), "1 hour")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS opens FROM events),
          s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
          SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, session""")
def str02_sessions(spark, d):
    return streams.sessions(table(spark, d, "events"), "2 hours")


@query("""SELECT date_trunc('second', ts) AS start, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS topics FROM events GROUP BY 1""")
def str02_changes(spark, d):
    return streams.changes(table(spark, d, "events"))


@query("""SELECT event_id, user_id, gap AS gap_seconds, coalesce(gap > 3600, false) AS stale FROM (SELECT event_id, user_id,
            CAST(epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS BIGINT) AS gap FROM events)""")
def str05_stale_leases(spark, d):
    return streams.stale(table(spark, d, "events"), 3_600)


@query("""WITH i AS (SELECT *, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM events)
          SELECT user_id, arg_min(event_id, ts) AS first_event, count(*) AS length, count(*) >= 5 AS opened FROM i WHERE event_type = 'error' GROUP BY user_id, island""")
def str09_failure_runs(spark, d):
    return streams.failure_runs(table(spark, d, "events"))


# Read path and exports

@query(f"""SELECT id, CAST(row_number() OVER (ORDER BY CASE status WHEN 'valid' THEN 0 WHEN 'incomplete' THEN 1 ELSE 2 END, confidence DESC, created_at, id) AS INTEGER) AS place FROM ({_RECORDS}) ORDER BY place LIMIT 200""")
def srt01_top_leads(spark, d):
    top = _records(spark, d).withColumn("match_score", F.lit(0.0)).orderBy(*criteria.lead_order()).limit(200)  # a page of leads is the feature
    return _placed(top)


def _placed(top: DataFrame) -> DataFrame:
    """Places of a bounded page."""
    rank = F.when(F.col("status") == "valid", 0).when(F.col("status") == "incomplete", 1).otherwise(2)
    return top.select("id", F.row_number().over(W.orderBy(rank, F.desc("confidence"), "created_at", "id")).alias("place"))


@query("""SELECT c_custkey, c_name || ',' || c_mktsegment || ',' || CASE WHEN c_acctbal < 0 THEN chr(39) ELSE '' END || CAST(CAST(c_acctbal AS DECIMAL(15, 2)) AS VARCHAR) AS line FROM customer""")
def snk03_csv_lines(spark, d):
    rows = table(spark, d, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(15,2)"))
    return rows.select("c_custkey", export.csv_lines(rows, ["c_name", "c_mktsegment", "c_acctbal"]).alias("line"))


@query(f"""SELECT id, field, sheet_row FROM (SELECT id, status, priority, source, 1 + row_number() OVER (ORDER BY confidence DESC, id) AS sheet_row FROM ({_RECORDS})) UNPIVOT (value FOR field IN (status, source))""")
def snk08_receipts(spark, d):
    rows = _records(spark, d)
    values = rows.select("id", F.explode(F.array(F.lit("status"), F.lit("source"))).alias("field"))
    return export.receipts(rows, values, ["status", "source"], [F.desc("confidence"), F.col("id")]).select("id", "field", "sheet_row")


@query(f"""SELECT item, string_agg(DISTINCT status || ':' || priority, '; ' ORDER BY status || ':' || priority) AS methods FROM ({_RECORDS}) GROUP BY item""")
def snk07_export_methods(spark, d):
    rows = _records(spark, d).select("item", F.concat_ws(":", "status", "priority").alias("m")).distinct()
    return rows.groupBy("item").agg(F.array_join(F.array_sort(F.collect_list("m")), "; ").alias("methods"))


# Pages, quotes and similarity: no SQL says the same

@query()
def l01_page_state(spark, d):
    s = dom.page_facets("title", "text", "headings", "links", "next_page", "owner")(F.col("html"), F.col("url"))
    rows = table(spark, d, "pages").select("page_id", s.alias("s"))
    best = elements.groups(elements.elements(table(spark, d, "pages")), 1).select("page_id", F.col("selector").alias("best_group"))
    found = rows.select("page_id", "s.title", F.length("s.text").alias("text_length"), F.size("s.headings").alias("n_headings"), F.size("s.links").alias("n_links"), "s.next_page", "s.owner")
    return found.join(best, "page_id", "left")


@query()
def k23_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query()
def k60_verify_quote(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", F.upper(F.substring("text", 5, 40)).alias("quote"))
    return rows.select("doc_id", text.verify_quote(F.col("quote"), F.col("text")).alias("s")).select("doc_id", "s.start", "s.stop")


@query()
def k66_sequence_ratio(spark, d):
    rows = table(spark, d, "part").select("p_partkey", text.sequence_ratio(F.col("p_name"), F.lower("p_type")).alias("ratio"))
    return rows.select("p_partkey", F.round("ratio", 6).alias("ratio"))


@query()
def k40_pay(spark, d):
    rows = table(spark, d, "documents").select("doc_id", parsers.pay(F.col("text")).alias("p"))
    return rows.select("doc_id", "p.least", "p.most", "p.currency", "p.period")


PAGES = criteria.Contract(
    fields=("title", "url", "text"), required=("title", "url"), keys=(("url",), ("title",)), urls=("url",),
    criteria=(
        criteria.Criterion("long", "has a sentence", "regex", ("text",), (r"\w+ \w+ \w+",), hard=True),
        criteria.Criterion("http", "is a web page", "keyword_any", ("url",), ("http",), hard=True),
        criteria.Criterion("english", "reads as English", "keyword_any", ("text",), ("the", "and"), weight=2.0),
        criteria.Criterion("plain", "no shouting", "keyword_none", ("title",), ("!!",), weight=1.0),
    ),
)


@query()
def pln05_page_dataset(spark, d):
    """Distinct pages of a contract, scored, with what they were judged by."""
    s = dom.page_facets("title", "text")(F.col("html"), F.col("url"))
    rows = table(spark, d, "pages").select("page_id", "url", s.alias("s")).select(
        F.col("page_id").alias("id"), F.col("page_id").alias("ord"), F.lit("pages").alias("source"), F.lit("DOM").alias("method"), F.lit(True).alias("verified"), F.lit(0).alias("created_at"), "url", "s.title", "s.text"
    )
    out = compiler.run(PAGES, [rows])
    return out.select("id", "title", "status", F.round("match_score", 6).alias("match_score"), "match_reason", F.round("confidence", 6).alias("confidence"), "duplicate_of", "lead_score", "lead_tier")


# Discovery

@query(f"""SELECT canonical, query_ord, hit_ord, url FROM (SELECT canonical, page_id % 7 AS query_ord, page_id AS hit_ord, url, row_number() OVER (PARTITION BY canonical ORDER BY page_id % 7, page_id) AS n FROM ({_CANONICAL})) WHERE n = 1""")
def dsc08_merge_hits(spark, d):
    hits = table(spark, d, "pages").select((F.col("page_id") % 7).alias("query_ord"), F.col("page_id").alias("hit_ord"), "url")
    return discovery.merge_hits(hits)


@query(r"""SELECT page_id, CASE WHEN page_id % 6 = 1 THEN 'profile' WHEN page_id % 6 = 2 THEN 'document' WHEN page_id % 6 = 3 THEN 'list'
             WHEN regexp_matches(url, '(?i)(?:\btop\b|\bbest\b|\blist of\b|\bdirectory\b|/(?:tags?|category|directory|list|search)(?:/|$))') THEN 'list' END AS kind FROM pages""")
def dsc09_hit_kind(spark, d):
    """Pages' addresses as hits; some on a site of profiles, some files, some with the title of a list."""
    case = F.col("page_id") % 6
    address = F.when(case == 1, F.concat(F.lit("https://www.linkedin.com/in/"), F.col("page_id").cast("string"))).when(case == 2, F.lit("https://a.example/report.PDF?x=1")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", discovery.hit_kind(address, F.when(case == 3, "The best of them all").otherwise("A page")).alias("kind"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), """ + _GRAMS + """,
          p AS (SELECT p_name AS name, min(p_partkey) AS plan_id FROM part WHERE p_size > 10 GROUP BY p_name),
          s AS (SELECT a.name, p.plan_id, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS shared FROM g a JOIN g b ON b.gram = a.gram JOIN p ON p.name = b.name JOIN c x ON x.name = a.name JOIN c y ON y.name = p.name GROUP BY a.name, p.plan_id),
          r AS (SELECT name, plan_id, CAST(shared AS DOUBLE) / (n + m - shared) AS similarity FROM s),
          k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, plan_id) AS k FROM r WHERE similarity >= 0.7) WHERE k = 1)
          SELECT p_partkey AS id, plan_id, round(similarity, 6) AS similarity FROM part JOIN k ON name = p_name""")
def jon14_plan_recall(spark, d):
    """Every part's name asks for a plan; a name's parts of size over 10 are its valid runs."""
    part = table(spark, d, "part")
    requests = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    plans = part.select(F.col("p_name").alias("text"), F.col("p_partkey").alias("plan_id"), F.when(F.col("p_size") > 10, 20).otherwise(0).alias("n_valid"))
    return discovery.recall(requests, plans).withColumn("similarity", F.round("similarity", 6))


@query()
def k46_headers(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", header.header(F.split("text", "\n")[0]).alias("h"))
    return rows.select("conv_id", "turn", "h.company", "h.role", "h.location", "h.arrangement", "h.pay", "h.employment", "h.url")


# Recipes and schema.org

@query(r"""WITH k AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, lower(regexp_extract(url, '^https?://([^/?#]+)', 1))
             || repeat('/*', len(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> ''))) AS pattern FROM pages),
          r AS (SELECT host, pattern, page_id AS recipe_id, page_id % 10 AS version FROM k WHERE page_id % 3 > 0), b AS (SELECT *, row_number() OVER (PARTITION BY host, pattern ORDER BY version DESC, recipe_id DESC) AS n FROM r)
          SELECT k.page_id, k.host, k.pattern, b.recipe_id, b.version FROM k LEFT JOIN b ON k.host = b.host AND k.pattern = b.pattern AND b.n = 1""")
def l07_newest_recipe(spark, d):
    pages = table(spark, d, "pages")
    known = pages.select(F.col("page_id").alias("recipe_id"), url.host_of(F.col("url")).alias("host"), url.url_pattern(F.col("url")).alias("pattern"), (F.col("page_id") % 10).alias("version"), (F.col("page_id") % 3 > 0).alias("active"))
    return recipes.newest_recipe(pages, known)
