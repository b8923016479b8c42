"""Building blocks for keys of any weight: joins that spread hot keys, and numbering in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerframe.session import materialise

#: A key is hot with more than one part in HOT_KEYS of all rows (and LEAST_HOT at least), so there are fewer hot keys than
#: that, whatever the input's size. Tables of no more keys are broadcast.
HOT_KEYS, LEAST_HOT = 5_000, 200
#: Rows that one numbering block holds on average.
BLOCK_ROWS = 20_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int | None = None) -> DataFrame:
    """Inner join of many rows with one row per key, where a key may hold any share of the rows.

    `size` in `groups` counts the key's rows. Few groups (HOT_KEYS at most) are broadcast, and the rows stay where they
    are. Of more groups, the hot ones are split into parts of about the size of what isn't hot: their rows take a part
    each, and the group is repeated for every part, 2 * HOT_KEYS repeats in all at most per doubling. The driver holds
    the hot keys only. `total`, the number of rows, saves the look at the groups where it shows that none is hot. Rows
    whose key is null find no partner.
    """
    if total is not None and total <= LEAST_HOT:
        return rows.join(groups, key)
    count, largest, all_rows = groups.agg(F.count("*"), F.coalesce(F.max(size), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()
    if count <= HOT_KEYS:
        return rows.join(F.broadcast(groups), key)
    limit = max(all_rows // HOT_KEYS, LEAST_HOT)
    if largest <= limit:
        return rows.join(groups, key)
    split: dict[int, list] = {}
    for k, n in groups.filter(F.col(size) > limit).select(key, size).collect():  # fewer than HOT_KEYS
        split.setdefault(((n - 1) // limit).bit_length(), []).append(k)
    parts = F.coalesce(*[F.when(F.col(key).isin(keys), 1 << doublings) for doublings, keys in split.items()], F.lit(1))
    salted = rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), parts).cast("int"))
    repeated = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return salted.join(repeated, [key, "_part"]).drop("_part")


def numbered(df: DataFrame, by: list[str], order: list[Column], spread: list[Column], out: str, rows: int, first: Column | None = None) -> DataFrame:
    """Add `out`: 0, 1, 2 ... without gaps within each `by`, without sorting any `by` group in one task.

    Rows fall into blocks by a hash of `spread`; blocks are numbered within their group and rows within their
    block by `order`. `first`, a small whole number, ranks above the hash: rows with a smaller value come first.
    `rows` is the count of df. The table of block counts has (groups x blocks) rows.
    """
    blocks = max(16, -(-rows // BLOCK_ROWS))
    block = F.pmod(F.xxhash64(F.lit("block"), *spread), F.lit(blocks))  # a hash of its own: callers often group by one of `spread`
    if first is not None:
        block = first.cast("long") * blocks + block
    keyed = df.withColumn("_block", block)
    counts = keyed.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*by, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy(*by, "_block").orderBy(*order)
    placed = keyed.withColumn("_row", F.row_number().over(within))
    same = [placed[c].eqNullSafe(starts[c]) for c in by] + [placed["_block"] == starts["_block"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return placed.join(starts, on).select(*[placed[c] for c in df.columns], (F.col("_before") + F.col("_row") - 1).alias(out))


def placed(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add `out`: 0, 1, 2 ... in the order of all rows, ranges of which are sorted side by side and counted."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    written = materialise(ordered.select("*", F.shiftright("_at", 33).alias("_range")), "placed")
    upto = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = written.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))  # one row a range
    return written.join(F.broadcast(starts), "_range").withColumn(out, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_range", "_before")
