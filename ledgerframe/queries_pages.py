"""Registered queries on pages as element rows: recipes replayed, made, repaired and moved, selectors, next pages and owners.

No SQL says the same; tests hold them against plain walks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerframe.functions import dom
from ledgerframe.operators import elements, fitting, paths, recipes, relocation, seeds
from ledgerframe.queries import query, table
from ledgerframe.session import spread

_NAV = ("nav li", {"title": ("a", None), "url": ("a", "href")})


@query()
def l05_recipe_replay(spark, d):
    return recipes.replay(table(spark, d, "pages"), *_NAV).withColumnRenamed("ord", "n")


@query()
def l06_recipe_acceptance(spark, d):
    rows = recipes.replay(table(spark, d, "pages"), *_NAV)
    out = recipes.accepted(recipes.fill(rows, ["title", "url"]), ["title", "url"], ["title"])
    return out.select("page_id", "items", F.round("fill_title", 6).alias("fill_title"), F.round("fill_url", 6).alias("fill_url"), "accepted")


@query()
def l12_relaxed_recipe(spark, d):
    """A recipe whose generated names no page has any more: every page's own groups and places make it anew."""
    fields = {"title": ("span.title--x1Y2z", None), "url": ("b.go__a1B2c", "href")}
    out = recipes.relaxed(table(spark, d, "pages"), "div.item--q9R8s", fields, {"title": "title", "url": "url"}, ["title"])
    return out.select("page_id", "recipe", "items", "mean_fill", F.col("fields")["title"].alias("title"), F.col("fields")["url"].alias("url"))


@query()
def l10_group_selectors(spark, d):
    """For the best group of each page the selector that fits its items best, and in the first of them that of its first link."""
    rows = spread(paths.placed(elements.elements(table(spark, d, "pages"))), "elements")
    best = elements.groups(rows, 1).select("page_id", "parent", "selector")
    members = rows.join(best, ["page_id", "parent", "selector"]).select("page_id", F.col("parent").alias("group"), "i", "last")
    named = seeds.group_selectors(rows, members.drop("last"))
    first = members.groupBy("page_id", "group").agg(F.min(F.struct("i", "last")).alias("e")).select("page_id", "group", "e.i", "e.last")
    links = first.join(rows.filter("tag = 'a'").select("page_id", F.col("i").alias("a")), "page_id").filter((F.col("a") >= F.col("i")) & (F.col("a") <= F.col("last")))
    targets = links.groupBy("page_id", "group", F.col("i").alias("item")).agg(F.max("a").alias("i")).withColumnRenamed("group", "key")
    return named.join(seeds.relative_selectors(rows, targets).select("page_id", F.col("key").alias("group"), F.col("selector").alias("link")), ["page_id", "group"], "left")


@query()
def l09_seeded_recipes(spark, d):
    """For each page a recipe from one record of it: text and link of the second entry of its navigation."""
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    record = recipes.replay(pages, *_NAV).filter("ord = 1")
    said = [F.struct(F.lit(f).alias("field"), F.col(f).alias("quote"), F.lit(f == "url").alias("link")) for f in ("title", "url")]
    quotes = record.select("page_id", F.explode(F.array(*said)).alias("q")).select("page_id", "q.*").filter("quote is not null")
    out = seeds.recipes_from_examples(pages, spread(quotes, "quotes"), ["title", "url"])
    return out.select("page_id", "items", "f1", "size", F.col("fields")["title"].alias("title"), F.col("fields")["url"].alias("url"))


@query()
def l16_next_pages(spark, d):
    s = dom.page_facets("next_page", "owner")(F.col("html"), F.col("url"))
    return table(spark, d, "pages").select("page_id", s.alias("s")).select("page_id", "s.next_page", "s.owner")


@query()
def l13_relocated_recipe(spark, d):
    """Every page and the same page rebuilt, its navigation as a list of other tags and names: where the recipe's entries are there."""
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    rebuilt = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<nav><ul>", '<div class="menu"><h4>Menu</h4>'), "</ul></nav>", "</div>"))
    rebuilt = rebuilt.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<li><a ", '<section class="entry"><i>o</i><a class="go" '), "</a></li>", "</a></section>"))
    out = relocation.relocated(pages, rebuilt, *_NAV)
    return out.select("page_id", "items", "f1", "shared", F.col("fields")["title"].alias("title"), F.col("fields")["url"].alias("url"))


@query()
def l19_fitted_text(spark, d):
    return fitting.fit_text(table(spark, d, "pages"), "the tion and ing", 2_000)
