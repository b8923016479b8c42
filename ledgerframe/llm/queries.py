"""The registered queries of these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerframe.llm.automaton import encode_decode
from ledgerframe.llm.dedup import exact_dedup
from ledgerframe.llm.licences import scan
from ledgerframe.llm.mixing import mix
from ledgerframe.llm.neardup import near_duplicates
from ledgerframe.llm.packing import pack
from ledgerframe.llm.periods import periodic_runs, repeat_tail
from ledgerframe.llm.quality import classify
from ledgerframe.llm.search import ranked_search
from ledgerframe.llm.sharding import shard
from ledgerframe.llm.token_files import token_files
from ledgerframe.llm.vectors import near_vectors
from ledgerframe.llm.warc import archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two batches, so that the second one meets an index that the first has filled."""
    return exact_dedup(table(spark, sf_dir, "documents"), batches=2)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), whole=False)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), change=repeat_tail, whole=False)


_ALL = (
    op1_near_dedup,
    op2_mixing,
    op3_licences,
    op4_exact_dedup,
    op5_sharding,
    op6_quality,
    op7_token_files,
    op8_warc,
    op9_packing,
    op10_near_vectors,
    op11_ranked_search,
    op12_token_automaton,
    op13_periodic_runs,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    "op2_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12) AS h,
                 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
          FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
        c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS point, sum(source_size) OVER () AS total FROM w),
        v AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY point, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(weight) OVER (ORDER BY point, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
        t AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM v WHERE level <= point ORDER BY point, source LIMIT 1)) AS target FROM v),
        b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
        g AS (SELECT source, h, sum(size) AS sum, count(*) AS rows FROM d GROUP BY source, h),
        u AS (SELECT *, sum(sum) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
        e AS (SELECT b.source, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget FROM b),
        x AS (SELECT e.*, u.h, CASE WHEN budget <= 0 OR u.upto - u.sum > budget THEN 0 WHEN u.upto <= budget THEN u.rows
                                    ELSE greatest(ceil((budget - (u.upto - u.sum)) * u.rows / u.sum - 0.5), 0) END AS more
              FROM e JOIN u ON e.source IS NOT DISTINCT FROM u.source),
        n AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS number FROM d)
        SELECT n.doc_id, CAST(n.size AS BIGINT) AS size, x.source_size, x.target,
               CAST((x.whole + CASE WHEN n.number <= x.more THEN 1 ELSE 0 END) * n.size AS BIGINT) AS taken
        FROM n JOIN x ON n.source IS NOT DISTINCT FROM x.source AND n.h = x.h""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op8_warc": """
        WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT page_id, octet_length(h) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS first,
                     row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, url) > 1 AS again FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND again THEN first END AS refers_to
        FROM f""",
    "op11_ranked_search": r"""
        WITH d AS (
          SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
        q AS (
          SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        c AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS terms FROM d),
        m AS (SELECT doc_id, 100 - 75 + ((75 * count(*) * (SELECT docs FROM c)) // (SELECT terms FROM c)) AS m FROM d GROUP BY doc_id),
        f AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY doc_id, t),
        w AS (SELECT t, CAST(floor(1000 * ln((2 * (SELECT docs FROM c) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f GROUP BY t),
        s AS (
          SELECT q.item_id, f.doc_id, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * m.m))) AS BIGINT) AS score
          FROM q JOIN f USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY q.item_id, f.doc_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
}
