"""Registered queries of streams with state and timers, and of branches, rounds, phrases and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerframe.functions import text
from ledgerframe.operators import criteria
from ledgerframe.plans import branches
from ledgerframe.queries import query, table
from ledgerframe.session import scratch
from ledgerframe.streaming import runs

_SETTING = "spark.sql.streaming.stateStore.providerClass"


def _streamed(spark, d, make) -> DataFrame:
    """What a stream over all events has written when it has taken all of them."""
    old = spark.conf.get(_SETTING)
    runs.with_state(spark)
    try:
        events = table(spark, d, "events")
        source = spark.readStream.schema(events.schema).parquet(f"{d}/events[.]parquet")  # a pattern, as the table is one file or a folder of them
        out = make(source)
        folder = scratch(spark, "stream")
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{folder}/out")
    finally:
        spark.conf.set(_SETTING, old)


@query()
def str07_run_states(spark, d):
    """Users' events as those of their runs."""
    said = {"view": "claim", "click": "ready", "purchase": "complete", "signup": "approve", "error": "heartbeat"}
    event = F.coalesce(F.create_map(*[F.lit(x) for kv in said.items() for x in kv])[F.col("event_type")], F.lit("heartbeat"))
    return _streamed(spark, d, lambda s: runs.run_states(s.select(F.col("user_id").cast("string").alias("run"), "ts", "event_id", event.alias("event")), lease=3_600))


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run, date_trunc('second', ts) AS s, event_type AS topic, CAST(arg_max(CAST(floor(value) AS BIGINT) % 3, struct_pack(t := ts, i := event_id)) AS VARCHAR) AS value FROM events GROUP BY ALL),
          c AS (SELECT *, lag(value) OVER (PARTITION BY run, topic ORDER BY s) AS old, row_number() OVER (PARTITION BY run, topic ORDER BY s) AS n, min(s) OVER (PARTITION BY run) AS first FROM e),
          a AS (SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS every FROM events)
          SELECT run, s AS "at", CASE WHEN s = any_value(first) THEN any_value(every) ELSE string_agg(topic, ',' ORDER BY topic) END AS topics FROM c, a WHERE n = 1 OR old IS DISTINCT FROM value GROUP BY run, s""")
def str04_changed_topics(spark, d):
    """Users' events as values of topics; the signs of life are left out."""
    topics = tuple(r[0] for r in table(spark, d, "events").select("event_type").distinct().collect())  # few types
    value = (F.floor("value") % 3).cast("string")
    make = lambda s: runs.changed_topics(s.select(F.col("user_id").cast("string").alias("run"), "ts", "event_id", F.col("event_type").alias("topic"), value.alias("value")), topics, alive=10**6)
    return _streamed(spark, d, make).filter("topics <> ''")


@query("""SELECT user_id % 3 AS branch, count(*) AS n FROM events WHERE user_id % 3 < 2 AND NOT (user_id % 3 = 1 AND event_type = 'error') GROUP BY 1""")
def stp10_branches(spark, d):
    """Three branches of events: one whole, one with rows that carry an error, one that can't be read."""
    e = table(spark, d, "events").select((F.col("user_id") % 3).alias("branch"), "event_type")
    part = lambda k: e.filter(F.col("branch") == k)
    made = {
        "whole": lambda: part(0),
        "some": lambda: branches.broken(part(1), F.when(F.col("event_type") == "error", "an error")),
        "gone": lambda: part(2).select("branch", F.when(F.col("branch") == 2, F.raise_error(F.lit("no such board"))).cast("string").alias("event_type")),
    }
    return branches.collect(spark, made).rows.groupBy("branch").agg(F.count("*").alias("n"))


_PHRASES = ("the", "the th", "and", "in", "de la", "ing", "on the", "mit license", "e t")


@query(f"""WITH p AS (SELECT unnest({list(_PHRASES)!r}) AS phrase, generate_subscripts({list(_PHRASES)!r}, 1) - 1 AS k),
          s AS (SELECT doc_id, list(struct_pack(start := position(phrase IN lower(text)) - 1, k := k, stop := position(phrase IN lower(text)) - 1 + length(phrase)) ORDER BY position(phrase IN lower(text)), k) AS l FROM documents, p WHERE text IS NOT NULL AND position(phrase IN lower(text)) > 0 GROUP BY doc_id),
          f AS (SELECT doc_id, list_reduce(l, lambda a, x: struct_pack(stop := CASE WHEN x.start >= a.stop THEN x.stop ELSE a.stop END, said := CASE WHEN x.start >= a.stop THEN a.said || ';' || x.k || ':' || x.start ELSE a.said END), struct_pack(stop := CAST(0 AS BIGINT), said := '')) AS r FROM (SELECT doc_id, [struct_pack(start := CAST(x.start AS BIGINT), k := x.k, stop := CAST(x.stop AS BIGINT)) for x in l] AS l FROM s))
          SELECT doc_id, substr(r.said, 2) AS places FROM f""")
def rdp07_located_phrases(spark, d):
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", text.located_phrases(F.col("text"), _PHRASES).alias("p")).filter("size(p) > 0")
    return rows.select("doc_id", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["k"].cast("string"), x["start"].cast("string"))), ";").alias("places"))


@query(r"""SELECT doc_id, nullif(regexp_replace(regexp_extract(text, '(?i)(?:^|[^a-z0-9])(?:theat|and t|la de|ing\.)'), '(?i)^[^a-z0-9]', ''), '') AS keyword FROM documents WHERE text IS NOT NULL""")
def prd08_first_keyword(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", criteria.first_keyword(F.col("text"), ("theat", " and t ", "la de", "ing.", "")).alias("keyword"))
