"""Recipes from one example record: quotes located on the page, the repeated unit around them, selectors written and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerframe.functions.url import absolute_url
from ledgerframe.operators import elements, paths
from ledgerframe.session import spread

#: Places of the rarest value that are tried, alike elements that make a unit a repeated one, and characters from which a
#: quote may be a part of an attribute.
ANCHORS, LEAST_ITEMS, PART = 20, 3, 8
# Attributes that a value may be read from; tags around all records.
ATTRIBUTES = ("href", "src", "datetime", "content", "title", "aria-label")
AROUND = ("html", "body")


def located(found: DataFrame, rows: DataFrame, quotes: DataFrame) -> DataFrame:
    """Where quotes (page_id, field, quote, link) stand: page_id, field, i, attribute (null for text).

    A place in the page's text belongs to the innermost element whose interval of text covers it, without those that hold
    another such element, and from there to the outermost element of the same text. A quote that no text has may be an
    attribute's value, or from PART characters on a part of it, or the same address. A field that is a link takes the
    link whose address is quoted, or the link around the quoted text, or else the first in it.
    """
    line = F.translate("text", "\n", " ")  # as long as the text
    wanted = quotes.select("page_id", "field", "link", F.trim(F.regexp_replace("quote", r"\s+", " ")).alias("quote")).filter("quote <> ''")
    pages = found.select("page_id", "url", line.alias("line"))
    asked = spread(wanted.join(pages, "page_id").withColumn("pieces", F.split("line", F.concat(F.lit("\\Q"), F.replace("quote", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)), "seed-quotes")
    # The k-th place comes after k pieces and k - 1 quotes.
    size = F.length("quote")
    upto = F.aggregate(F.slice("pieces", F.lit(1), F.size("pieces") - 1), F.array().cast("array<int>"), lambda acc, p: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)) + size, F.lit(0)) + F.length(p)))
    places = asked.select("page_id", "field", "link", F.explode(upto).alias("at"), size.alias("size"))
    spans = rows.filter(~F.col("tag").isin(*AROUND)).select("page_id", "i", "last", "start", "stop")
    inner = places.join(spans, "page_id").filter((F.col("start") <= F.col("at")) & (F.col("at") + F.col("size") <= F.col("stop")))
    inner = inner.groupBy("page_id", "field", "link", "at").agg(F.max(F.struct("i", "last", "start", "stop")).alias("e")).select("page_id", "field", "link", "e.*").distinct()
    below = F.min("i").over(W.partitionBy("page_id", "field").orderBy("i").rowsBetween(1, W.unboundedFollowing))
    inner = inner.withColumn("_below", below).filter(F.col("_below").isNull() | (F.col("_below") > F.col("last")))
    outer = spans.filter("start < stop").groupBy("page_id", "start", "stop").agg(F.min("i").alias("i"))
    by_text = spread(inner.select("page_id", "field", "link", "start", "stop").join(outer, ["page_id", "start", "stop"]).select("page_id", "field", "link", "i"), "seed-texts")
    each = rows.select("page_id", "i", F.explode(F.map_filter("attributes", lambda k, v: k.isin(*ATTRIBUTES) & (F.trim(v) != ""))).alias("attribute", "value"))
    value = F.trim("value")
    same = (value == F.col("quote")) | ((F.length("quote") >= PART) & F.contains(value, F.col("quote"))) | (absolute_url(F.col("url"), F.col("quote")) == absolute_url(F.col("url"), value))
    by_value = each.join(asked.select("page_id", "field", "link", "quote", "url"), "page_id").filter(same).select("page_id", "field", "link", "i", "attribute")
    plain = by_text.filter("not link").select("page_id", "field", "i", F.lit(None).cast("string").alias("attribute"))
    other = by_value.filter("not link").join(by_text.select("page_id", "field").distinct(), ["page_id", "field"], "left_anti").select("page_id", "field", "i", "attribute")
    # Links around or in a quoted text: the innermost around it, else the first below.
    links = rows.filter((F.col("tag") == "a") & (F.coalesce(F.col("attributes")["href"], F.lit("")) != "")).select("page_id", F.col("i").alias("a"), F.col("last").alias("a_last"))
    texts = by_text.filter("link").join(rows.select("page_id", "i", "last"), ["page_id", "i"]).join(links, "page_id")
    around, within = (F.col("a") <= F.col("i")) & (F.col("a_last") >= F.col("i")), (F.col("a") > F.col("i")) & (F.col("a") <= F.col("last"))
    near = texts.filter(around | within).groupBy("page_id", "field", "i").agg(F.coalesce(F.max(F.when(around, F.col("a"))), F.min("a")).alias("a"))
    linked = near.select("page_id", "field", F.col("a").alias("i")).union(by_value.filter("link and attribute = 'href'").select("page_id", "field", "i")).distinct().withColumn("attribute", F.lit("href"))
    return spread(plain.unionByName(other).unionByName(linked), "seed-places")


def innermost(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Add `i` and `last` of the innermost element that holds all from `low` to `high` (page_id, key, low, high), which is their lowest common ancestor."""
    held = spans.join(rows.select("page_id", "i", "last"), "page_id").filter((F.col("i") <= F.col("low")) & (F.col("last") >= F.col("high")))
    return held.groupBy("page_id", "key").agg(F.max(F.struct("i", "last")).alias("e")).select("page_id", "key", "e.i", "e.last")


def records(rows: DataFrame, places: DataFrame, order: list[str]) -> DataFrame:
    """The record around each page's places (page_id, field, i, attribute): page_id, item, size, picks (field, i, attribute).

    The field with fewest places is the anchor, by `order` (identifying fields first) on ties. For each of its first ANCHORS
    places every other field takes the place that shares the deepest common ancestor with it; the record is the
    nearest element from all picks' common ancestor upwards that has LEAST_ITEMS - 1 alike ones at least. The anchor
    whose record has most alike ones wins, the first of equal ones. Pages whose fields were more than one and left but
    one pick have no record.
    """
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("field"))
    counts = places.groupBy("page_id", "field").agg(F.count("*").alias("n"))
    anchor = counts.groupBy("page_id").agg(F.min(F.struct("n", rank.alias("rank"), "field")).alias("x")).select("page_id", F.col("x.field").alias("field"))
    tried = places.join(anchor, ["page_id", "field"]).withColumn("key", F.row_number().over(W.partitionBy("page_id").orderBy("i", "attribute"))).filter(F.col("key") <= ANCHORS)
    tried = spread(tried.select("page_id", "key", F.col("field").alias("a_field"), F.col("i").alias("a"), F.col("attribute").alias("a_attribute")), "seed-anchors")
    pairs = tried.join(places, "page_id").filter("field <> a_field").select("page_id", F.struct("key", "field", "i", "attribute", ((F.col("i") == F.col("a")) & F.col("attribute").eqNullSafe(F.col("a_attribute"))).alias("same")).alias("key"), F.least("i", "a").alias("low"), F.greatest("i", "a").alias("high"))
    common = innermost(rows, pairs)  # intervals nest, so a deeper common ancestor of one anchor has the larger number
    best = common.groupBy("page_id", "key.key", "key.field").agg(F.min(F.struct("key.same", (-F.col("i")).alias("up"), F.col("key.i").alias("i"), F.col("key.attribute").alias("attribute"))).alias("x"))
    picks = best.select("page_id", "key", "field", "x.i", "x.attribute").unionByName(tried.select("page_id", "key", F.col("a_field").alias("field"), F.col("a").alias("i"), F.col("a_attribute").alias("attribute")))
    picks = spread(picks, "seed-picks")
    all_of = picks.groupBy("page_id", "key").agg(F.min("i").alias("low"), F.max("i").alias("high"), F.sort_array(F.collect_list(F.struct("field", "i", "attribute"))).alias("picks"))  # one a field
    start = innermost(rows, all_of).select("page_id", "key", F.col("i").alias("from"))
    up = start.join(rows.select("page_id", "i", "last", "tag"), "page_id").filter((F.col("i") <= F.col("from")) & (F.col("last") >= F.col("from")) & ~F.col("tag").isin(*AROUND)).select("page_id", "key", "i")
    up = spread(up, "seed-units")
    size = elements.alike(rows, up.select("page_id", "i").distinct()).groupBy("page_id", "i").agg((F.count("*") + 1).alias("size"))
    units = up.join(size.filter(F.col("size") >= LEAST_ITEMS), ["page_id", "i"]).groupBy("page_id", "key").agg(F.max(F.struct("i", "size")).alias("u"))
    won = units.join(all_of, ["page_id", "key"]).groupBy("page_id").agg(F.max_by(F.struct("u.i", "u.size", "picks"), F.struct("u.size", -F.col("key"))).alias("x"))
    many = places.groupBy("page_id").agg(F.count_distinct("field").alias("fields"))
    out = won.join(many, "page_id").select("page_id", F.col("x.i").alias("item"), F.col("x.size").alias("size"), F.col("x.picks").alias("picks"))
    return out.filter((F.size("picks") > 1) | F.lit(len(order) == 1))


def group_selectors(rows: DataFrame, members: DataFrame) -> DataFrame:
    """For each group (page_id, group, i) the selector that fits it best: page_id, group, selector, f1.

    Candidates are the members' own selectors, the tag with the steady classes that all members share (two at most), and
    the first one's own below its parent's, and below its parent's and grandparent's. All are evaluated on the page; the
    best by F1 wins, the simplest of equal ones. `rows` have `nth`.
    """
    size = members.groupBy("page_id", "group").agg(F.count("*").alias("size"), F.min("i").alias("i"))
    steady = F.filter(elements.classes_of(F.col("attributes")), lambda c: ~elements.generated(c))
    classes = members.join(rows.select("page_id", "i", F.posexplode(F.array_distinct(steady)).alias("at", "class")), ["page_id", "i"])
    shared = classes.groupBy("page_id", "group", "class").agg(F.count("*").alias("n"), F.min_by("at", "i").alias("at")).join(size.select("page_id", "group", "size"), ["page_id", "group"]).filter("n = size")
    shared = shared.groupBy("page_id", "group").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("at", "class"))), lambda x: x["class"]), 1, 2).alias("classes"))
    up = lambda n: rows.select("page_id", F.col("i").alias(f"i{n}"), F.col("parent").alias(f"i{n + 1}"), F.col("selector").alias(f"s{n}"))
    named = size.join(rows.select("page_id", "i", "tag", F.col("parent").alias("i1"), F.col("selector").alias("s0")), ["page_id", "i"]).join(up(1), ["page_id", "i1"], "left").join(up(2), ["page_id", "i2"], "left").join(shared, ["page_id", "group"], "left")
    own = lambda n, child: paths.own_step(f"s{n}", child)
    choice = lambda rank, name, steps: F.struct(F.lit(rank).alias("rank"), name.alias("name"), steps.alias("steps"))
    common = F.concat_ws(".", F.col("tag"), F.col("classes"))
    candidates = [
        F.when(F.size("classes") > 0, choice(1, common, F.array(paths.own_step(common)))),
        F.when(F.col("s1").isNotNull(), choice(2, F.concat_ws(" > ", "s1", "s0"), F.array(own(1, False), own(0, True)))),
        F.when(F.col("s1").isNotNull() & F.col("s2").isNotNull(), choice(3, F.concat_ws(" > ", "s2", "s1", "s0"), F.array(own(2, False), own(1, True), own(0, True)))),
    ]
    each = named.select("page_id", "group", "size", F.explode(F.array_compact(F.array(*candidates))).alias("c"))
    selves = members.join(rows.select("page_id", "i", F.col("selector").alias("s0")), ["page_id", "i"]).select("page_id", "group", "s0").distinct().join(size.drop("i"), ["page_id", "group"])
    each = spread(each.unionByName(selves.select("page_id", "group", "size", choice(0, F.col("s0"), F.array(own(0, False))).alias("c"))), "selector-candidates")
    asks = each.select("page_id", F.struct("group", "c.rank", "c.name").alias("key"), F.lit(-1).alias("i"), F.lit(1 << 30).alias("last"), "c.steps")
    met = paths.select(rows, asks).select("page_id", "key.group", "key.rank", "key.name", "i").join(members.withColumn("_in", F.lit(1)), ["page_id", "group", "i"], "left")
    met = met.groupBy("page_id", "group", "rank", "name").agg(F.count("*").alias("matched"), F.count("_in").alias("hits"))
    f1 = F.round(2 * F.col("hits") / (F.col("matched") + F.col("size")), 6)
    best = each.select("page_id", "group", "size", "c.rank", "c.name").join(met, ["page_id", "group", "rank", "name"]).groupBy("page_id", "group").agg(F.min(F.struct((-f1).alias("f"), "rank", "name")).alias("x"))
    return best.select("page_id", "group", F.col("x.name").alias("selector"), (-F.col("x.f")).alias("f1"))


def relative_selectors(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target (page_id, key, item, i) in an item the shortest selector that finds it first there: page_id, key, selector.

    Tried are the target's own, the path from the item to it, and that path from the item's children on with each step's
    place among the siblings of its tag, which always leads there. The item itself is ''. `rows` have `nth`.
    """
    away = targets.filter("i <> item")
    ends = away.join(rows.select("page_id", F.col("i").alias("item"), F.col("last").alias("item_last")), ["page_id", "item"])
    on = rows.select("page_id", F.col("i").alias("e"), F.col("last").alias("e_last"), "selector", "nth")
    path = ends.join(on, "page_id").filter((F.col("e") > F.col("item")) & (F.col("e") <= F.col("i")) & (F.col("e_last") >= F.col("i")))
    path = path.groupBy("page_id", "key", "item", "item_last", "i").agg(F.sort_array(F.collect_list(F.struct("e", "selector", "nth"))).alias("path"))  # as many as the page is deep
    step = lambda x, k, place: paths.own_step(x["selector"], True, x["nth"] if place else None).withField("child", F.lit(True) if place else k > 0)
    pinned = F.transform("path", lambda x: F.concat(x["selector"], F.lit(":nth-of-type("), x["nth"].cast("string"), F.lit(")")))
    own = F.element_at("path", -1)["selector"]
    choices = F.array(
        F.struct(F.lit(0).alias("rank"), own.alias("name"), F.array(paths.own_step(own)).alias("steps")),
        F.struct(F.lit(1).alias("rank"), F.array_join(F.transform("path", lambda x: x["selector"]), " > ").alias("name"), F.transform("path", lambda x, k: step(x, k, False)).alias("steps")),
        F.struct(F.lit(2).alias("rank"), F.concat(F.lit("> "), F.array_join(pinned, " > ")).alias("name"), F.transform("path", lambda x, k: step(x, k, True)).alias("steps")),
    )
    each = spread(path.select("page_id", "key", "item", "item_last", "i", F.explode(choices).alias("c")), "selector-paths")
    asks = each.select("page_id", F.struct("key", "c.rank").alias("key"), F.col("item").alias("i"), F.col("item_last").alias("last"), "c.steps")
    first = paths.select(rows, asks).groupBy("page_id", "key").agg(F.min("i").alias("first")).select("page_id", "key.key", "key.rank", "first")
    met = each.select("page_id", "key", "i", "c.rank", "c.name").join(first, ["page_id", "key", "rank"], "left")
    best = met.groupBy("page_id", "key").agg(F.min(F.struct(F.when((F.col("first") == F.col("i")) | (F.col("rank") == 2), F.col("rank")).otherwise(9).alias("rank"), "name")).alias("x"))
    return best.select("page_id", "key", F.col("x.name").alias("selector")).unionByName(targets.filter("i = item").select("page_id", "key", F.lit("").alias("selector")))


def recipes_from_examples(pages: DataFrame, quotes: DataFrame, order: list[str]) -> DataFrame:
    """A recipe for each page (page_id, url, html) from one record of it, quoted as (page_id, field, quote, link): page_id, items, f1, size, fields.

    `fields` maps each field that was found to its selector below the item, and '@' with its attribute if it isn't the
    text. `order` has all fields, identifying ones first. Pages on which no repeated unit holds the quotes have no row.
    """
    found = elements.parts(pages.select("page_id", "url", "html"))
    rows = spread(paths.placed(elements.rows_of(found)), "page-elements")
    unit = spread(records(rows, located(found, rows, quotes), order), "seed-records")
    item = unit.select("page_id", F.col("item").alias("i"))
    members = elements.alike(rows, item).select("page_id", F.lit(0).alias("group"), F.col("other").alias("i")).unionByName(item.select("page_id", F.lit(0).alias("group"), "i"))
    named = group_selectors(rows, members)
    targets = unit.select("page_id", "item", F.explode("picks").alias("p")).select("page_id", F.struct("p.field", "p.attribute").alias("key"), "item", "p.i")
    spelled = lambda attribute: F.concat("selector", F.coalesce(F.concat(F.lit("@"), attribute), F.lit("")))
    fields = relative_selectors(rows, targets).groupBy("page_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key.field", spelled(F.col("key.attribute")).alias("s"))))).alias("fields"))
    return unit.select("page_id", "size").join(named, "page_id").join(fields, "page_id").select("page_id", F.col("selector").alias("items"), "f1", "size", "fields")
