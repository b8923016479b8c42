"""Recipes that moved: items of two versions of a page met through rare pieces of text, fields checked by their values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ledgerframe.operators import elements, paths, recipes, seeds
from ledgerframe.session import spread

#: Share of an item's and its new place's distinct pieces of text that both show.
LEAST = 0.3


def pieces(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The distinct pieces of text that each item (page_id, i, last) shows, one of each element with text of its own: page_id, item, piece."""
    own = rows.filter("text <> ''").select("page_id", F.col("i").alias("e"), "text")
    held = items.select("page_id", F.col("i").alias("item"), "last").join(own, "page_id").filter((F.col("e") >= F.col("item")) & (F.col("e") <= F.col("last")))
    return held.select("page_id", "item", F.col("text").alias("piece")).distinct()


def alike_pairs(old: DataFrame, new: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs of old items and new places (page_id, item, piece) of a page whose shared pieces are `least` of both's: page_id, item, moved, shared, similarity.

    A pair that shares so many shares one of the item's rarest pieces (all but that share, and one), so items and places
    meet through these alone; pieces that stand everywhere bring nothing together.
    """
    often = new.groupBy("page_id", "piece").agg(F.count("*").alias("often"))
    ranked = old.join(often, ["page_id", "piece"], "left").groupBy("page_id", "item").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "piece"))).alias("p"))  # an item's own
    n = F.size("p")
    rare = ranked.select("page_id", "item", n.alias("n"), F.explode(F.slice("p", F.lit(1), (n - F.ceil(n * F.lit(least) - F.lit(1e-9)) + 1).cast("int"))).alias("p")).select("page_id", "item", "n", "p.piece")
    there = new.select("page_id", F.col("item").alias("moved"), "piece")
    met = rare.join(there, ["page_id", "piece"]).select("page_id", "item", "moved", "n").distinct()
    both = met.join(old, ["page_id", "item"]).join(there, ["page_id", "moved", "piece"]).groupBy("page_id", "item", "moved", "n").agg(F.count("*").alias("shared"))
    sized = both.join(there.groupBy("page_id", "moved").agg(F.count("*").alias("m")), ["page_id", "moved"])
    either = F.col("n") + F.col("m") - F.col("shared")
    return sized.filter(F.col("shared") >= either * least - 1e-9).select("page_id", "item", "moved", "shared", F.round(F.col("shared") / either, 9).alias("similarity"))


def assigned(pairs: DataFrame) -> DataFrame:
    """Pairs (page_id, item, moved, shared, similarity) of which none has an item or a place twice: the most similar first, then by item and place.

    A pair that is the best of both its sides is taken, what meets either is left out, and so on; this gives what taking
    the best pair of the page again and again gives. Every round is a job on what is left.
    """
    left, taken = spread(pairs, "moves"), []
    rank = lambda *rest: F.min(F.struct((-F.col("similarity")).alias("s"), "item", "moved", *rest)).alias("x")
    while not left.isEmpty():
        by_item = left.groupBy("page_id", "item").agg(rank("shared", "similarity")).select("page_id", "item", "x.moved", "x.shared", "x.similarity")
        by_place = left.groupBy("page_id", "moved").agg(rank()).select("page_id", "moved", "x.item")
        best = spread(by_item.join(by_place, ["page_id", "item", "moved"]), "moves-taken")
        taken.append(best.select("page_id", "item", "moved", "shared", "similarity"))
        left = left.join(best.select("page_id", "item"), ["page_id", "item"], "left_anti").join(best.select("page_id", "moved"), ["page_id", "moved"], "left_anti")
        left = spread(left, "moves")
    return reduce(DataFrame.unionByName, taken) if taken else left


def moved_items(old: DataFrame, old_items: DataFrame, new: DataFrame, places: DataFrame, least: float = LEAST) -> DataFrame:
    """Where old items (page_id, i, last) of a page are among the new version's places (page_id, i, last): page_id, item, moved, shared, similarity; no place twice."""
    return assigned(alike_pairs(spread(pieces(old, old_items), "old-pieces"), spread(pieces(new, places), "new-pieces"), least))


def relocated(before: DataFrame, after: DataFrame, items: str, fields: recipes.Fields, least: float = LEAST) -> DataFrame:
    """A recipe (items, fields) of the pages `before` written anew for the same pages `after` (page_id, url, html): page_id, items, f1, shared, fields.

    Items read on the old page meet the new page's elements; of the best assignment the pair that shares most text, the
    first of equal ones, shows the same record. A field is where that record reads the same value as before:
    of the elements with it the one of the old one's tag, then the innermost. Fields without such an element are left
    out; pages without a record on both versions, or without a field, have no row. The item's selector is written for
    the elements alike to the record.
    """
    old_found, new_found = (elements.parts(d.select("page_id", "url", "html")) for d in (before, after))
    old, new = recipes.element_rows(old_found), recipes.element_rows(new_found)
    recipe = old_found.select("page_id", F.lit("r").alias("recipe"), paths.steps(items).alias("items"), recipes.field_steps({f: [v] for f, v in fields.items()}).alias("fields"))
    listed, values = recipes.read(old_found, old, recipe)
    moves = moved_items(old, listed, new, new.filter(~F.col("tag").isin(*seeds.AROUND)).select("page_id", "i", "last"), least)
    first = moves.groupBy("page_id").agg(F.min(F.struct((-F.col("shared")).alias("s"), "item", "moved")).alias("x")).select("page_id", "x.item", "x.moved", (-F.col("x.s")).alias("shared"))
    first = spread(first, "moved-records")
    attribute = F.create_map(*[x for f, (_, a) in fields.items() for x in (F.lit(f), F.lit(a).cast("string"))])
    wanted = first.join(values.withColumnRenamed("i", "item"), ["page_id", "item"]).select("page_id", "moved", "field", "value", attribute[F.col("field")].alias("attribute"))
    within = new.select("page_id", "i", "attributes", "start", "stop", "tag").join(first.join(new.select("page_id", F.col("i").alias("moved"), F.col("last").alias("end")), ["page_id", "moved"]).select("page_id", "moved", "end"), "page_id").filter((F.col("i") >= F.col("moved")) & (F.col("i") <= F.col("end")))
    shown = within.join(new_found.select("page_id", "url", "text"), "page_id").join(wanted, ["page_id", "moved"])
    raw = F.when(F.col("attribute").isNull(), F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start"))).otherwise(F.element_at("attributes", F.col("attribute")))
    read = F.when(F.col("attribute").isin(*recipes.LINKS), recipes.absolute_url(F.col("url"), F.trim(raw))).otherwise(F.trim(raw))
    tags = {f: paths.parse(s)[-1][1] if s else None for f, (s, _) in fields.items()}
    tag = F.create_map(*[x for f, t in tags.items() for x in (F.lit(f), F.lit(t).cast("string"))])[F.col("field")]
    same = shown.filter(read == F.col("value")).groupBy("page_id", "moved", "field", "attribute").agg(F.min(F.struct((~F.coalesce(F.col("tag") == tag, F.lit(False))).alias("other"), (-F.col("i")).alias("up"))).alias("x"))
    targets = same.select("page_id", F.struct("field", "attribute").alias("key"), F.col("moved").alias("item"), (-F.col("x.up")).alias("i"))
    spelled = F.concat("selector", F.coalesce(F.concat(F.lit("@"), F.col("key.attribute")), F.lit("")))
    written = seeds.relative_selectors(new, spread(targets, "moved-fields")).groupBy("page_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key.field", spelled.alias("s"))))).alias("fields"))
    item = first.select("page_id", F.col("moved").alias("i"))
    members = elements.alike(new, item).select("page_id", F.lit(0).alias("group"), F.col("other").alias("i")).unionByName(item.select("page_id", F.lit(0).alias("group"), "i"))
    named = seeds.group_selectors(new, members)
    return named.join(written, "page_id").join(first, "page_id").select("page_id", F.col("selector").alias("items"), "f1", "shared", "fields")
