"""Exact dedup against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerframe.operators.scale import join_groups
from ledgerframe.session import materialise, scratch

#: Digests of one bucket on average, and buckets at least.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 20, 64


def digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def identity(doc_id: Column, text: Column) -> Column:
    """What tells a row's document and text, never null: a join on it sends no two documents to one key, nor all null ids."""
    return F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.lit(":"), F.sha2(F.coalesce(text, F.lit("")), 256))


class DigestIndex:
    """Digests seen so far, with the document that stands for each.

    The index is a Parquet table at `path`, bucketed and sorted by digest, so that a new batch is shuffled to the
    buckets once and merged with them while the index itself never moves. A new index takes as many buckets as the
    rows it is made for need, BUCKET_ROWS each; opening the same path again, in any session, goes on with the same
    index and its buckets. Each batch adds one file to a bucket at most; `compacted` joins them.

    Digests carry the batch that brought them. A batch that comes again, after a lost driver or in a job that runs
    anew, sees the index without itself and appends only what it has not appended yet, so its outcome is the same.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, rows: int = 0):
        self.spark = spark
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_buckets")  # readers of the table pass over it
        files = mark.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(mark):
            self.buckets = spark.read.schema("buckets int").json(f"{path}/_buckets").first()["buckets"]
        else:
            self.buckets = buckets or max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.json(f"{path}/_buckets")
        self.table = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def append(self, rows: DataFrame) -> None:
        """Add (digest, keep_id, batch), one file a bucket."""
        rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)

    def compacted(self, path: str, buckets: int | None = None) -> DigestIndex:
        """The same index at a new path, one file a bucket, with as many buckets as its rows need if not given."""
        known = self.spark.table(self.table)
        new = DigestIndex(self.spark, path, buckets, known.count())
        new.append(known)
        return new

    def close(self) -> None:
        """Take the table out of the session's catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def ingest(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Deduplicate `docs` (doc_id, text) among themselves and against the index, and append what is new.

        One row per input row: doc_id, keep_id (the document that stands for the text), group_size (rows of this
        batch with the text), kept, text_sha256. Null text equals empty text; texts of any length are hashed whole. Of
        equal texts in a batch the largest doc_id stays, null ids below all others; of rows that repeat both id and
        text one stays. A text that an earlier batch has brought keeps that batch's document, and no row of this
        batch. Other columns don't matter. An empty batch gives no rows. `batch` names the batch; without a name the
        same ids and texts are the same batch.
        """
        keyed = materialise(docs.select(F.col("doc_id").cast("long"), digest(F.col("text")).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")
        if batch is None:
            rows, mark = keyed.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("doc_id", "digest")), F.lit(0))).first()
            also = keyed.agg(F.coalesce(F.sum(F.pmod(F.xxhash64("digest", "doc_id"), F.lit(1 << 31))), F.lit(0))).first()[0]
            batch = f"{rows}-{mark & (1 << 64) - 1:016x}-{also}"
        groups = keyed.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
        groups = materialise(groups, "digest-groups").repartition(self.buckets, "digest")
        known = self.spark.table(self.table).select("digest", F.col("keep_id").alias("known_id"), F.col("batch").alias("known_batch"))
        met = groups.hint("merge").join(known, "digest", "left")  # as an anti-join does, and says as well what is known
        own = F.col("known_batch").isNull() | (F.col("known_batch") == batch)
        decided = met.select(
            "digest",
            "group_size",
            F.when(own, F.col("keep.doc_id")).otherwise(F.col("known_id")).alias("keep_id"),
            F.when(own, F.col("keep.row")).alias("keep_row"),
            F.col("known_batch").isNull().alias("fresh"),
        )
        decided = materialise(decided, "digest-decided")
        self.append(decided.filter("fresh").withColumn("batch", F.lit(batch)))
        return join_groups(keyed, decided, "digest", "group_size").select(
            "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
        )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 1) -> DataFrame:
    """`DigestIndex.ingest` with the index given, or with a new one in the shared folder.

    In several batches the documents are ingested by ranges of doc_id, the largest first and null ids last, so that the
    outcome is that of one batch; group_size then counts the rows of all of them.
    """
    spark = docs.sparkSession
    if index is None:
        own = DigestIndex(spark, scratch(spark, "digest-index"), rows=docs.count())
        try:
            return exact_dedup(docs, own, batches)  # what it returns reads written tables, the index no more
        finally:
            own.close()
    if batches == 1:
        return index.ingest(docs)
    id = F.col("doc_id").cast("long")
    edges = docs.select(F.percentile_approx(id, [k / batches for k in range(1, batches)]).alias("x")).first()["x"] or []
    edges = sorted(set(edges), reverse=True)
    ranges = [id > e if k == 0 else (id > e) & (id <= edges[k - 1]) for k, e in enumerate(edges)]
    ranges.append(id.isNull() | (id <= edges[-1]) if edges else F.lit(True))
    done = materialise(reduce(DataFrame.unionByName, [materialise(index.ingest(docs.filter(part)), "digest-batch") for part in ranges]), "digest-batches")
    sizes = done.groupBy("text_sha256").agg(F.count("*").alias("group_size"))
    return join_groups(done.drop("group_size"), sizes, "text_sha256", "group_size").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of `docs`, with all its columns, for each identity in `kept` (identity); whole rows are shuffled once."""
    keyed = docs.select(identity(F.col("doc_id"), F.col("text")).alias("identity"), F.struct("*").alias("row"))
    return keyed.join(kept, "identity", "left_semi").dropDuplicates(["identity"]).select("row.*")


def without_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    kept = exact_dedup(docs, index).filter("kept")
    return rows_of(docs, kept.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text_sha256")).alias("identity")))
