"""Entity resolution: keys, clusters and the row that stands for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerframe.functions.text import normalize_text
from ledgerframe.functions.url import canonical_url
from ledgerframe.operators.components import connected_components
from ledgerframe.operators.criteria import METHODS
from ledgerframe.operators.scale import join_groups
from ledgerframe.session import materialise


def record_key(fields: tuple[str, ...], urls: tuple[str, ...] = (), forms: dict | None = None) -> Column:
    """'f1+f2:part1|part2' in comparable form, null where a part is empty; links by their canonical form.

    `forms` says for some fields what is compared in place of their text (a column function), such as a place's city.
    """
    form = lambda f: F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) != "", (forms or {}).get(f, lambda c: c)(F.col(f).cast("string")))
    parts = [canonical_url(F.col(f)) if f in urls else normalize_text(form(f)) for f in fields]
    kept = [F.when(p != "", p) for p in parts]  # null makes the key null
    return F.concat(F.lit("+".join(fields) + ":"), kept[0], *[x for p in kept[1:] for x in (F.lit("|"), p)])


def clusters(records: DataFrame, keys: list[Column], id: str = "id") -> DataFrame:
    """(id, cluster) for every record: those that share any key, directly or through others; the smallest id names it.

    Each key links its records to its smallest one, so a popular key gives as many links as it has records. Ids and
    keys alone are written and shuffled, not the records.
    """
    keyed = materialise(records.select(F.col(id).alias("id"), F.explode(F.array_compact(F.array(*keys))).alias("key")), "resolve-keys")
    heads = keyed.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    links = join_groups(keyed, heads, "key", "n").select(F.col("head").alias("a"), F.col("id").alias("b"))
    found = connected_components(links)
    return records.select(F.col(id).alias("id")).join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cluster"))


def method_rank(methods: Column) -> Column:
    """Place of the best way among a record's evidence, 9 without any."""
    places = F.create_map(*[x for i, m in enumerate(METHODS) for x in (F.lit(m), F.lit(i))])
    return F.coalesce(F.array_min(F.transform(methods, lambda m: places[m])), F.lit(9))


def keepers(records: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Add `duplicate_of`: null for the record that stands for its cluster, else that record's id.

    The best way comes first, then the surer, then the fuller, then the older record, then the smaller id.
    """
    rank = F.struct("method_rank", (-F.col("confidence")).alias("c"), (-F.col("completeness")).alias("f"), "created_at", "id")
    best = records.groupBy(cluster).agg(F.min(rank).alias("best"), F.count("*").alias("_size")).select(cluster, F.col("best.id").alias("keeper"), "_size")
    return join_groups(records, best, cluster, "_size").drop("_size").withColumn("duplicate_of", F.when(F.col("keeper") != F.col("id"), F.col("keeper"))).drop("keeper")


def seen_on(records: DataFrame) -> DataFrame:
    """Add `seen_on` to records (id, duplicate_of, label): a keeper's own label, then its duplicates', each once; a duplicate's own."""
    copies = records.filter("duplicate_of is not null").select(F.col("duplicate_of").alias("_keeper"), "label").distinct()
    others = copies.groupBy("_keeper").agg(F.array_sort(F.collect_set("label")).alias("_others"))  # as many as there are sources
    met = records.join(others, F.col("id") == F.col("_keeper"), "left")
    return met.withColumn("seen_on", F.array_distinct(F.concat(F.array("label"), F.coalesce("_others", F.array().cast("array<string>"))))).drop("_keeper", "_others")


def first_wins(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key, rows without a key left out."""
    kept = rows.select(key.alias("key"), F.struct(*order).alias("place"), F.struct("*").alias("row")).filter("key is not null")
    return kept.groupBy("key").agg(F.min_by("row", "place").alias("row")).select("row.*")
