"""Recipes for list pages: replay as joins on element rows, fill, acceptance, repair from the page itself, the newest one for an address."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerframe.functions.url import absolute_url, host_of, url_pattern
from ledgerframe.operators import elements, paths
from ledgerframe.operators.reports import latest
from ledgerframe.session import spread

#: Items that a page must give, and shares of them that must have a field: titles and links, other required fields.
LEAST_ITEMS, KEY_FILL, REQUIRED_FILL = 3, 0.8, 0.25
#: Groups of a page that may take the place of its items.
MOST_GROUPS = 5
# Where a field of a role tends to stand in an item, (selector, attribute or None for text), in order.
PLACES = {
    "title": (("h1", None), ("h2", None), ("h3", None), ("h4", None), ("a", None), ('[class*="title"]', None)),
    "url": (("a[href]", "href"), ("", "href")),
    "location": (('[class*="location"]', None),),
    "department": (('[class*="department"]', None), ('[class*="team"]', None)),
}
LINKS = ("href", "src")

Fields = dict[str, tuple[str, str | None]]


def field_steps(fields: dict[str, list[tuple[str, str | None]]]) -> Column:
    """Fields with their variants, each (selector, attribute), as the column that `read` takes."""
    one = lambda f, k, v: F.struct(F.lit(f).alias("field"), F.lit(k).alias("variant"), paths.steps(v[0]).alias("steps"), F.lit(v[1]).cast("string").alias("attribute"))
    return F.array(*[one(f, k, v) for f, variants in fields.items() for k, v in enumerate(variants)])


def element_rows(found: DataFrame) -> DataFrame:
    """The elements of `elements.parts`, with their places among siblings, written once."""
    return spread(paths.placed(elements.rows_of(found)), "page-elements")


def read(found: DataFrame, rows: DataFrame, recipes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and values of recipes (page_id, recipe, items: steps, fields: see `field_steps`) on pages, all in one pass.

    Returns (page_id, recipe, ord, i, last) for each item, and (page_id, recipe, i, field, variant, value) for each value:
    the first element of a field's selector below the item, its attribute or text; links are made absolute. Blank
    values are left out.
    """
    asks = recipes.select("page_id", F.col("recipe").alias("key"), F.lit(-1).alias("i"), F.lit(1 << 30).alias("last"), F.col("items").alias("steps"))
    items = paths.select(rows, asks).withColumn("ord", F.row_number().over(W.partitionBy("page_id", "key").orderBy("i")) - 1)
    items = spread(items.select("page_id", F.col("key").alias("recipe"), "ord", "i", "last"), "recipe-items")
    each = items.join(recipes.select("page_id", "recipe", F.explode("fields").alias("f")), ["page_id", "recipe"])
    asks = each.select("page_id", F.struct("recipe", F.col("i").alias("item"), "f.field", "f.variant", "f.attribute").alias("key"), "i", "last", "f.steps")
    first = paths.select(rows, spread(asks, "recipe-asks")).groupBy("page_id", "key").agg(F.min("i").alias("i"))
    held = first.join(rows.select("page_id", "i", "attributes", "start", "stop"), ["page_id", "i"]).join(found.select("page_id", "url", "text"), "page_id")
    attribute = F.col("key.attribute")
    raw = F.when(attribute.isNull(), F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start"))).otherwise(F.element_at("attributes", attribute))
    value = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    values = held.withColumn("value", value).filter("value <> ''")
    values = values.withColumn("value", F.when(attribute.isin(*LINKS), absolute_url(F.col("url"), F.col("value"))).otherwise(F.col("value")))
    return items, values.select("page_id", "key.recipe", F.col("key.item").alias("i"), "key.field", "key.variant", "value")


def replay_parts(found: DataFrame, items: str, fields: Fields) -> DataFrame:
    """`replay` on pages that `elements.parts` has read."""
    recipe = found.select("page_id", F.lit("r").alias("recipe"), paths.steps(items).alias("items"), field_steps({f: [v] for f, v in fields.items()}).alias("fields"))
    listed, values = read(found, element_rows(found), recipe)
    wide = values.groupBy("page_id", "i").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    return listed.join(wide, ["page_id", "i"], "left").select("page_id", "ord", *fields)


def replay(pages: DataFrame, items: str, fields: Fields) -> DataFrame:
    """One row for each item of each page (page_id, url, html): page_id, ord, and the fields, (selector, attribute or None for text) each."""
    return replay_parts(elements.parts(pages.select("page_id", "url", "html")), items, fields)


def fill(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Items of each page, and the share of them that has each field."""
    return rows.groupBy("page_id").agg(F.count("*").alias("items"), *[F.avg(F.col(f).isNotNull().cast("double")).alias(f"fill_{f}") for f in fields])


def needs(fields: list[str], required: list[str]) -> dict[str, float]:
    """The share of items that must have each field that is needed."""
    return {f: KEY_FILL if f in ("title", "url") else REQUIRED_FILL for f in fields if f in ("title", "url") or f in required}


def accepted(filled: DataFrame, fields: list[str], required: list[str]) -> DataFrame:
    """Add `accepted`: enough items, and enough of them with what is needed."""
    enough = [F.col(f"fill_{f}") >= share for f, share in needs(fields, required).items()]
    return filled.withColumn("accepted", reduce(lambda a, b: a & b, enough, F.col("items") >= LEAST_ITEMS))


def newest_recipe(pages: DataFrame, recipes: DataFrame) -> DataFrame:
    """Each page (page_id, url) with the newest active recipe (recipe_id, host, pattern, version, active) for its host and pattern, null without."""
    best = latest(recipes.filter("active"), ["host", "pattern"], [F.desc("version"), F.desc("recipe_id")])
    keyed = pages.select("page_id", host_of(F.col("url")).alias("host"), url_pattern(F.col("url")).alias("pattern"))
    return keyed.join(best, ["host", "pattern"], "left").select("page_id", "host", "pattern", "recipe_id", "version")


def without_hashes(selector: str) -> str:
    """The selector with its generated class names matched by what is readable of them; names without that stay."""

    def readable(m: re.Match) -> str:
        name = m[1]
        start = re.match(r".{3,}?(?:--|__)(?=.)", name)
        return f'[class*="{start[0]}"]' if start and any(re.search(form, name) for form in elements.GENERATED) else m[0]

    return re.sub(r"\.(-?[A-Za-z_][\w-]*)(?![^\[]*\])", readable, selector)


def variants(fields: Fields, roles: dict[str, str]) -> dict[str, list[tuple[str, str | None]]]:
    """For each field the places where it may stand now: its own, that without hashes, those of its role; each once."""
    return {f: list(dict.fromkeys([v, (without_hashes(v[0]), v[1]), *PLACES.get(roles.get(f, ""), ())])) for f, v in fields.items()}


def relaxed(pages: DataFrame, items: str, fields: Fields, roles: dict[str, str], required: list[str]) -> DataFrame:
    """For each page (page_id, url, html) the recipe that the given one becomes there: page_id, recipe, items, mean_fill, fields.

    Items may stand where they did, there without generated names, or be one of the page's best groups; each field is read
    where it fills most items, its earlier places first. Of the candidates that are accepted, the one that fills
    most on average stays, the first of equal ones. `fields` says for each field its selector and attribute. Pages
    without an accepted candidate have no row. All candidates and places of all pages are read in one pass.
    """
    found = elements.parts(pages.select("page_id", "url", "html"))
    rows = element_rows(found)
    given = list(dict.fromkeys([items, without_hashes(items)]))
    literal = F.explode(F.array(*[F.struct(F.lit(s).alias("recipe"), F.lit(k).alias("ord"), paths.steps(s).alias("items")) for k, s in enumerate(given)]))
    own = found.select("page_id", literal.alias("c")).select("page_id", "c.*")
    groups = elements.groups(rows, MOST_GROUPS).select("page_id", F.col("selector").alias("recipe"), (F.col("place") + 1).alias("ord"), F.array(paths.own_step("selector")).alias("items"))
    choice = own.unionByName(groups).groupBy("page_id", "recipe").agg(F.min("ord").alias("ord"), F.min_by("items", "ord").alias("items"))
    places = variants(fields, roles)
    choice = spread(choice.withColumn("fields", field_steps(places)), "recipe-candidates")
    listed, values = read(found, rows, choice)
    sizes = listed.groupBy("page_id", "recipe").agg(F.count("*").alias("items")).filter(F.col("items") >= LEAST_ITEMS)
    filled = values.groupBy("page_id", "recipe", "field", "variant").agg(F.count("*").alias("n"))
    best = filled.groupBy("page_id", "recipe", "field").agg(F.max(F.struct("n", (-F.col("variant")).alias("v"))).alias("x"))
    wide = best.groupBy("page_id", "recipe").agg(*[F.max(F.when(F.col("field") == f, F.col("x"))).alias(f"_{f}") for f in fields])
    judged = sizes.join(wide, ["page_id", "recipe"], "left").join(choice.select("page_id", "recipe", "ord"), ["page_id", "recipe"])
    share = {f: F.coalesce(F.col(f"_{f}.n"), F.lit(0)) / F.col("items") for f in fields}
    for f, least in needs(list(fields), required).items():
        judged = judged.filter(share[f] >= least)
    mean = reduce(lambda a, b: a + b, share.values()) / len(fields)
    spelled = {f: F.array(*[F.lit(s if a is None else f"{s}@{a}") for s, a in v]) for f, v in places.items()}
    chosen = F.create_map(*[x for f in fields for x in (F.lit(f), F.get(spelled[f], -F.coalesce(F.col(f"_{f}.v"), F.lit(0))))])
    won = judged.groupBy("page_id").agg(F.min_by(F.struct("recipe", "items", mean.alias("fill"), chosen.alias("fields")), F.struct((-mean).alias("m"), "ord")).alias("x"))
    return won.select("page_id", "x.recipe", "x.items", F.round("x.fill", 6).alias("mean_fill"), "x.fields")


def uncovered(recipe_fields: list[str], needed: list[str]) -> list[str]:
    """Fields that a page needs and its recipe doesn't read, for which it has to be discovered anew."""
    return [f for f in needed if f not in recipe_fields]
