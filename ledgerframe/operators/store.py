"""Storing what a run found: records and their evidence as new tables, page copies, updates, what a clean-up removes."""

from __future__ import annotations

import json
import uuid
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerframe.operators.criteria import field_confidence

#: Fields of a piece of evidence besides the record's key, field and value.
PROOF = ("method", "verified", "quote", "url", "page_id")


def candidate_key(source: Column, external: Column) -> Column:
    """'source:id', the key of a candidate within its run."""
    return F.concat_ws(":", source, external)


def last_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, with all its columns; an aggregate, so that no key's rows have to be sorted."""
    return rows.groupBy(*[F.col(k).alias(k) for k in key]).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_row")).select("_row.*")


def stored(candidates: DataFrame, run: str, key: str = "key", order: str = "ord") -> DataFrame:
    """The records that a run keeps: the last candidate of each key, with the run's name."""
    return last_of_each(candidates, [key], [order]).withColumn("run", F.lit(run))


def evidence_rows(records: DataFrame, fields: list[str], key: list[str]) -> DataFrame:
    """One row for each value of a record: its key, field, value, method, verified, quote, url, page_id and confidence.

    A record says where its values come from in `evidence` (field, method, verified ...), else for all of them in columns of
    those names; what it doesn't say is null.
    """
    own = "evidence" in records.columns
    known = [f.name for f in records.schema["evidence"].dataType.elementType.fields] if own else records.columns
    kinds = {"verified": "boolean", "page_id": "long"}
    entries = []
    for f in fields:
        of_field = F.get(F.filter("evidence", lambda e: e["field"] == f), F.lit(0)) if own else None  # noqa: B023
        proof = [((of_field[p] if own else F.col(p)) if p in known else F.lit(None)).cast(kinds.get(p, "string")).alias(p) for p in PROOF]
        value = F.col(f).cast("string")
        entries.append(F.when(F.coalesce(F.trim(value), F.lit("")) != "", F.struct(F.lit(f).alias("field"), value.alias("value"), *proof)))
    rows = records.select(*key, F.explode(F.array_compact(F.array(*entries))).alias("e")).select(*key, "e.*")
    return rows.withColumn("confidence", field_confidence(F.col("method"), F.coalesce("verified", F.lit(False))))


def replaced(children: DataFrame, new: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Child rows with those of `parents` replaced by the new ones: none of the old ones of a stored record stays."""
    return children.join(parents.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def updated(rows: DataFrame, values: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`rows` with the columns that `values` (one row a key) has for them; rows without values keep theirs, nulls in values count."""
    given = values.select(F.col(key), F.lit(True).alias("_given"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(given, key, "left")
    return joined.select(*[F.when(F.col("_given"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def page_copies(copies: DataFrame, fetched: DataFrame) -> DataFrame:
    """Stored copies (url, via, hash, final_url, body, at) after newly fetched ones.

    A page that equals the newest copy of its (url, via), by hash and final URL, only moves that copy's time; any other
    is a copy of its own. Zero characters are dropped from bodies, raw ones and those escaped in JSON.
    """
    clean = F.regexp_replace(F.replace(F.col("body"), F.lit("\0"), F.lit("")), r"(?<!\\)\\u0000", "")
    new = last_of_each(fetched.withColumn("body", clean), ["url", "via"], ["at"])
    newest = last_of_each(copies, ["url", "via"], ["at"]).select("url", "via", F.col("at").alias("_at"), F.col("hash").alias("_hash"), F.col("final_url").alias("_final"))
    met = new.join(newest, ["url", "via"], "left").withColumn("_same", (F.col("hash").eqNullSafe(F.col("_hash"))) & F.col("final_url").eqNullSafe(F.col("_final")) & F.col("_at").isNotNull())
    moved = met.filter("_same").select("url", "via", "_at", F.col("at").alias("_moved"))
    kept = copies.join(moved, (copies["url"] == moved["url"]) & (copies["via"] == moved["via"]) & (copies["at"] == moved["_at"]), "left").select(*[copies[c] if c != "at" else F.coalesce(F.col("_moved"), copies["at"]).alias("at") for c in copies.columns])
    return kept.unionByName(met.filter("not _same").select(*copies.columns))


def status_counts(records: DataFrame) -> DataFrame:
    """Records by status, one row with a column for each."""
    return records.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("valid", "incomplete", "invalid")])


def metric_totals(uses: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Counters from an append-only log of uses: how often, and the columns' sums."""
    return uses.groupBy(*by).agg(F.count("*").alias("uses"), *[F.sum(c).alias(c) for c in columns])


def pruned(pages: DataFrame, cited: DataFrame, key: str, at: str, cutoff: Column, size: Column) -> DataFrame:
    """What a clean-up removes: pages older than the cutoff that nothing cites, and their bytes, one row."""
    gone = pages.filter(F.col(at) < cutoff).join(cited.select(key).distinct(), key, "left_anti")
    return gone.agg(F.count("*").alias("pages"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def without_finished(events: DataFrame, runs: DataFrame, cutoff: Column) -> DataFrame:
    """Events whose run hasn't finished before the cutoff; unfinished runs keep theirs."""
    return events.join(runs.filter(F.col("finished_at") < cutoff).select("run"), "run", "left_anti")


def merged_sources(earlier: DataFrame, found: DataFrame) -> DataFrame:
    """Sources (ref, ord, label, hits: array of url) of two searches: new ones first, and one that both know has the hits of both, each once."""
    a, b = (d.select("ref", F.col("ord").alias(f"{x}_ord"), F.col("label").alias(f"{x}_label"), F.col("hits").alias(f"{x}_hits")) for x, d in (("a", found), ("b", earlier)))
    both = a.join(b, "ref", "full_outer")
    empty = F.array().cast("array<string>")
    hits = F.array_distinct(F.concat(F.coalesce("b_hits", empty), F.coalesce("a_hits", empty)))
    return both.select("ref", F.coalesce("a_label", "b_label").alias("label"), F.col("a_ord").isNull().alias("old"), F.coalesce("a_ord", "b_ord").alias("ord"), hits.alias("hits"))


def kept_drafts(valid: DataFrame, drafts: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """A draft's entries (ref ...) for the refs that are still valid, and defaults for those it doesn't know."""
    joined = valid.select("ref").join(drafts.withColumn("_known", F.lit(True)), "ref", "left")
    return joined.select("ref", *[F.when(F.col("_known"), F.col(c)).otherwise(d).alias(c) for c, d in defaults.items()])


def new_refs(candidates: list[DataFrame], known: DataFrame) -> DataFrame:
    """Refs of all candidates that aren't known, each once."""
    return reduce(DataFrame.unionByName, [c.select("ref") for c in candidates]).distinct().join(known.select("ref"), "ref", "left_anti")


class RunStore:
    """Records and evidence of runs, written: Parquet tables by run and attempt under one folder, and a commit for each run.

    A run is written as an attempt of its own; only when both tables are there does a commit name that attempt, as a small
    file that appears by one rename. Readers follow the newest commit of each run, so they see all of an attempt or
    nothing, also while a run is written again. A run that was killed leaves an attempt that no commit names; the run that
    repeats it writes anew, and then takes away what the commits don't name. Writing an attempt again replaces it.
    """

    TABLES = ("records", "evidence")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write_attempt(self, run: str, attempt: str, records: DataFrame, evidence: DataFrame) -> None:
        """Write both tables of an attempt; no reader sees them before `commit`."""
        for name, rows in zip(self.TABLES, (records, evidence)):
            marked = rows.drop("run", "attempt").withColumn("run", F.lit(run)).withColumn("attempt", F.lit(attempt))
            marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "attempt").parquet(f"{self.folder}/{name}")

    def commit(self, run: str, attempt: str) -> None:
        """Make an attempt the one that readers see of its run."""
        files, place = self._files(), self._path("commits", f"of={quote(run, safe='')}")
        files.mkdirs(place)
        known = [int(f.getPath().getName().split(".")[0]) for f in files.listStatus(place) if f.getPath().getName().endswith(".json")]
        draft, final = self._path("drafts", uuid.uuid4().hex), self._path("commits", f"of={quote(run, safe='')}", f"{max(known, default=0) + 1:09d}.json")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps({"run": run, "attempt": attempt, "number": max(known, default=0) + 1}), "utf-8"))
        out.close()
        if not files.rename(draft, final):
            raise RuntimeError(f"run {run} was committed by another writer meanwhile")

    def clean(self, run: str, attempt: str) -> None:
        """Delete what other attempts of the run have written."""
        files = self._files()
        for name in self.TABLES:
            if not files.exists(self._path(name)):
                continue
            own = [f.getPath() for f in files.listStatus(self._path(name)) if unquote(f.getPath().getName()) == f"run={run}"]
            for old in [f.getPath() for place in own for f in files.listStatus(place) if f.getPath().getName() != f"attempt={attempt}"]:
                files.delete(old, True)

    def write(self, run: str, records: DataFrame, evidence: DataFrame) -> None:
        """Store a run: records, one a key, and their evidence. What the run had stored before is replaced as a whole."""
        attempt = uuid.uuid4().hex
        self.write_attempt(run, attempt, records, evidence)
        self.commit(run, attempt)
        self.clean(run, attempt)

    def committed(self) -> DataFrame:
        """The attempt that counts of each run: run, attempt; a row a run."""
        schema = "run string, attempt string, number long"
        if not self._files().exists(self._path("commits")):
            return self.spark.createDataFrame([], "run string, attempt string")
        commits = self.spark.read.schema(schema).option("recursiveFileLookup", "true").json(f"{self.folder}/commits")
        return commits.groupBy("run").agg(F.max_by("attempt", "number").alias("attempt"))

    def read(self, name: str, *runs: str) -> DataFrame:
        """The committed rows of a table, of the runs named or of all, with the run's name; columns of all runs, null where one lacks them."""
        chosen = self.committed()
        chosen = chosen.filter(F.col("run").isin(*runs)) if runs else chosen
        if not self._files().exists(self._path(name)):
            return chosen.drop("attempt").limit(0)
        rows = self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")
        kept = rows.withColumn("run", F.col("run").cast("string")).withColumn("attempt", F.col("attempt").cast("string"))
        return kept.join(chosen, ["run", "attempt"], "left_semi").drop("attempt")
