"""A page's text within a budget: its repeated groups with samples first, then content blocks by relevance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerframe.operators import elements, paths
from ledgerframe.session import spread

#: Groups and samples of each that are shown, characters of a block at most, and a sample's share of the budget.
GROUPS, SAMPLES, BLOCK, SHARE = 3, 2, 400, 4


def shown_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The page's best groups that don't repeat a better one, and all their items: (page_id, place, selector), (page_id, place, i, last).

    A group repeats a better one that is shown if an item of it is one of that one's, lies in one, or holds one. Items are
    all elements that the group's selector finds on the page. `rows` have `nth`, and no page furniture.
    """
    best = spread(elements.groups(rows, GROUPS).select("page_id", "place", "selector"), "fit-groups")
    asks = best.select("page_id", F.col("place").alias("key"), F.lit(-1).alias("i"), F.lit(1 << 30).alias("last"), F.array(paths.own_step("selector")).alias("steps"))
    items = spread(paths.select(rows, asks).withColumnRenamed("key", "place"), "fit-items")
    # Intervals nest or lie apart: two groups touch where an item of one starts within one of the other.
    marks = items.select("page_id", "i", "last", "place")
    before = W.partitionBy("page_id").orderBy("i", "place").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("page_id").orderBy("i", "place").rowsBetween(1, W.unboundedFollowing)
    ends = [F.max(F.when(F.col("place") == p, F.col("last"))).over(before) for p in range(1, GROUPS + 1)]
    starts = [F.min(F.when(F.col("place") == p, F.col("i"))).over(after) for p in range(1, GROUPS + 1)]  # the same element is a later row
    touched = F.array(*[F.coalesce(e >= F.col("i"), F.lit(False)) | F.coalesce(s <= F.col("last"), F.lit(False)) for e, s in zip(ends, starts)])
    met = marks.withColumn("touched", touched).groupBy("page_id", "place").agg(*[F.max(F.get("touched", F.lit(p))).alias(f"t{p + 1}") for p in range(GROUPS)])
    wide = met.groupBy("page_id").agg(F.max(F.col("place")).alias("n"), *[F.max(F.when(F.col("place") == p, F.col(f"t{q}"))).alias(f"t{p}{q}") for p in range(2, GROUPS + 1) for q in range(1, p)])
    kept = {1: F.lit(True)}
    for p in range(2, GROUPS + 1):
        kept[p] = reduce(lambda a, b: a & b, [~(F.coalesce(F.col(f"t{p}{q}"), F.lit(True)) & kept[q]) for q in range(1, p)])
    places = wide.select("page_id", F.explode(F.array_compact(F.array(*[F.when(kept[p] & (F.col("n") >= p), F.lit(p)) for p in range(1, GROUPS + 1)]))).alias("place"))
    return best.join(places, ["page_id", "place"]), items.join(places, ["page_id", "place"], "left_semi")


def fit_text(pages: DataFrame, query: str, most: int = 8_000) -> DataFrame:
    """One text for each page (page_id, html) with visible text, `most` characters at most: page_id, text.

    Repeated groups come first, each a heading with its size and selector and the text of its first items, if it still
    fits as a whole. Then come content blocks outside those items, most relevant to the query first, up to the first
    that doesn't fit. Page furniture is left out of both.
    """
    found = elements.parts(pages.select("page_id", "html"))
    every = elements.rows_of(found)
    every = every.withColumn("_out", F.col("tag").isin(*elements.CHROME)).withColumn("_in", elements.inside(F.col("tag").isin(*elements.CHROME)))
    rows = spread(paths.placed(every.filter("not _out and not _in").drop("_out", "_in")), "fit-elements")
    best, items = shown_groups(rows)
    best, items = spread(best, "fit-shown"), spread(items, "fit-shown-items")
    numbered = items.withColumn("n", F.row_number().over(W.partitionBy("page_id", "place").orderBy("i")))
    size = numbered.groupBy("page_id", "place").agg(F.count("*").alias("size"))
    sample = numbered.filter(F.col("n") <= SAMPLES).join(rows.select("page_id", "i", "start", "stop"), ["page_id", "i"]).join(found.select("page_id", "text"), "page_id")
    cut = F.substring(F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start")), 1, most // SHARE)
    samples = sample.groupBy("page_id", "place").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", cut.alias("s")))), lambda x: x["s"]).alias("samples"))
    heading = F.concat(F.lit("## "), F.col("size").cast("string"), F.lit(" alike items ("), "selector", F.lit("), the first "), F.size("samples").cast("string"), F.lit(":"))
    parts = best.join(size, ["page_id", "place"]).join(samples, ["page_id", "place"]).select("page_id", "place", F.concat_ws("\n", heading, F.col("samples")).alias("part"))
    listed = parts.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]).alias("parts"))  # GROUPS at most
    state = F.struct(F.lit(0).alias("size"), F.array().cast("array<string>").alias("parts"))
    taken = F.aggregate("parts", state, lambda a, p: F.when(a["size"] + F.length(p) > most, a).otherwise(F.struct((a["size"] + F.length(p) + 1).alias("size"), F.array_append(a["parts"], p).alias("parts"))))
    lists = listed.withColumn("t", taken).select("page_id", F.col("t.size").alias("size"), F.col("t.parts").alias("parts"))
    shown = rows.join(items.select("page_id", "i").distinct().withColumn("_shown", F.lit(True)), ["page_id", "i"], "left").withColumn("_shown", F.coalesce("_shown", F.lit(False)))
    free = shown.withColumn("_in", elements.inside(F.col("_shown"))).filter("not _shown and not _in")
    blocks = elements.content(free, query, 1 << 30).select("page_id", "place", F.concat(F.lit("<"), "tag", F.lit("> "), F.substring("text", 1, BLOCK)).alias("line"))
    upto = F.sum(F.length("line") + 1).over(W.partitionBy("page_id").orderBy("place")) - 1
    fitting = blocks.withColumn("upto", upto).join(lists.select("page_id", "size"), "page_id", "left").filter(F.coalesce("size", F.lit(0)) + F.col("upto") <= most)
    lines = fitting.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("lines"))  # within the budget
    both = lists.join(lines, "page_id", "full_outer")
    return both.select("page_id", F.concat_ws("\n", F.coalesce("parts", F.array().cast("array<string>")), F.coalesce("lines", F.array().cast("array<string>"))).alias("text")).filter("text <> ''")
