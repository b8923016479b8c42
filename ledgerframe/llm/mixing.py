"""Mix sources to target weights by hash thresholds found in histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerframe.operators.scale import join_groups, numbered
from ledgerframe.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the hash that one histogram level resolves, and the levels.
DIGITS, LEVELS = 3, 4


def words(text: Column) -> Column:
    """Words of the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Add `target` to (source, source_size): the total shared by weight, at most `most` times a source's size.

    Weights go to the sources by code point, null last, and repeat. Sharing a cap's excess again and again by weight
    ends where every source gets min(most * size, level * weight) with one common level; sorting by size over
    weight gives that level directly.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("point", F.col("cap") / F.col("weight"))
    total = F.sum("source_size").over(W.partitionBy())
    order = W.orderBy("point", "source")
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", (total - full) / open_weight)
    level = F.min(F.when(F.col("level") <= F.col("point"), F.struct("point", "source", "level"))).over(W.partitionBy())["level"]  # the first that fits
    return s.withColumn("level", level).withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap")).drop("weight", "cap", "point", "level")


def thresholds(keyed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Add `threshold` and `at_it` to (key, budget): rows of `keyed` (key, hash, size) below the threshold, and so many of those at it, come near the budget.

    Each level sums sizes by hash prefix and looks on only in the bucket that holds the boundary, so each level
    after the first reads one part in 4,096 of the one before. Rows that share the whole hash have equal ids and texts,
    so any of them can be taken. Hash order is never sorted.
    """
    edge = budgets.select("key", "budget", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    rows = keyed
    for level in range(1, LEVELS + 1):
        length = DIGITS * level
        if level > 1:
            rows = rows.withColumn("prefix", F.substring("hash", 1, length - DIGITS)).join(edge.select("key", "prefix"), ["key", "prefix"], "left_semi").drop("prefix")
        sums = rows.groupBy("key", F.substring("hash", 1, length).alias("bucket")).agg(F.sum("size").alias("sum"), F.count("*").alias("rows"))
        upto = F.sum("sum").over(W.partitionBy("key").orderBy("bucket"))
        edge = edge.select("key", "budget", "before")
        cut = edge.join(sums.withColumn("upto", upto), "key").filter(F.col("before") + F.col("upto") > F.col("budget"))
        found = cut.groupBy("key").agg(F.min(F.struct("bucket", "upto", "sum", "rows", "before", "budget")).alias("x"))
        edge = found.select("key", "x.budget", F.col("x.bucket").alias("prefix"), (F.col("x.before") + F.col("x.upto") - F.col("x.sum")).alias("before"), "x.sum", "x.rows")
        edge = materialise(edge, "mix-edge")
    nearest = F.ceil((F.col("budget") - F.col("before")) * F.col("rows") / F.col("sum") - 0.5)
    found = edge.select("key", F.col("prefix").alias("threshold"), F.greatest(nearest, F.lit(0)).cast("long").alias("at_it"))
    return budgets.join(found, "key", "left").withColumn("threshold", F.coalesce("threshold", F.lit("g"))).withColumn("at_it", F.coalesce("at_it", F.lit(0).cast("long")))


def _keys() -> tuple[Column, Column]:
    """A document's source as a key that is never null, and the hash of id and text that the thresholds cut."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    both = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    return key.alias("key"), F.substring(F.md5(both), 1, DIGITS * LEVELS).alias("hash")


def plan(keyed: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """One row per source of `keyed` (key, source, hash, size): key, n, source_size, target, whole, budget, threshold, at_it."""
    sums = keyed.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    shares = targets(sums, weights, most).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    shares = materialise(shares.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-shares")
    return materialise(thresholds(keyed.select("key", "hash", "size"), shares.drop("source")), "mix-plan")


def copies(rows: DataFrame) -> DataFrame:
    """Add `copies`, how often a row (key, hash, whole, budget, threshold, at_it) is taken.

    Rows at their source's threshold, which is one hash of the source and so one row unless rows repeat, are numbered
    in blocks; all others stay where they are.
    """
    cut = F.col("budget") > 0
    others = rows.filter(~(cut & (F.col("hash") == F.col("threshold")))).withColumn("copies", F.col("whole") + (cut & (F.col("hash") < F.col("threshold"))).cast("long"))
    edge = rows.filter(cut & (F.col("hash") == F.col("threshold"))).withColumn("_id", F.monotonically_increasing_id())
    edge = materialise(edge, "mix-repeats")
    edge = numbered(edge, ["key"], [F.col("_id")], [F.col("_id")], "_number", edge.count())
    edge = edge.withColumn("copies", F.col("whole") + (F.col("_number") < F.col("at_it")).cast("long")).drop("_id", "_number")
    return others.unionByName(edge)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """How often each document (doc_id, text, source) goes into the mix.

    One row per input row: doc_id, source_key, size, source_size, target, copies, taken (copies * size). A source is
    taken whole as often as its target holds its size, and once more for documents whose hash of doc_id and text lies
    below the source's threshold; the taken words miss the target by half the boundary document at most. Of rows that
    repeat id and text, null ids too, as many are taken as come nearest. Null and empty texts have size 0; texts of any
    length are counted whole. A null source is a source of its own. Other columns don't matter. No rows give no rows.
    The choice depends on ids, texts and sources only.
    """
    keyed = materialise(docs.select("doc_id", "source", *_keys(), words(F.col("text")).alias("size")), "mix-sizes")
    joined = copies(join_groups(keyed.drop("source"), plan(keyed, weights, most), "key", "n"))
    return joined.select("doc_id", F.col("key").alias("source_key"), "size", "source_size", "target", "copies").withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """The rows of the mix with all columns of `docs`, each as often as it is taken; no row has to meet itself in a join."""
    keyed = materialise(docs.select("source", *_keys(), words(F.col("text")).alias("size")), "mix-sizes")
    known = plan(keyed, weights, most).select("key", "n", "whole", "budget", "threshold", "at_it")
    joined = copies(join_groups(docs.select(*_keys(), F.struct("*").alias("row")), known, "key", "n"))
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("copies") > 0, F.col("copies")))).alias("copy")).select("row.*")
