"""Pages as items: lists read by a recipe along their next pages, records read from their own data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerframe.functions import dom, schema_org
from ledgerframe.functions.evidence import from_text, Proof, normal_pay
from ledgerframe.functions.parsers import arrangement, first_number
from ledgerframe.functions.url import canonical_url
from ledgerframe.operators import elements, recipes
from ledgerframe.session import spread

#: Forms of columns: what a raw value becomes.
FORMS = {"number": lambda c: first_number(c).cast("string"), "pay": normal_pay, "arrangement": lambda c: F.coalesce(arrangement(c), F.lower(F.trim(c))), "text": F.trim}


def page_chain(pages: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """The pages (url, html) that lists (start) run over: start, url, place from 0, html.

    A list goes on to the page that each page names as its next, for `most` pages at most; it ends where that page isn't
    there or has been read already. Every round is a join of the last pages with the links; texts join at the end only.
    """
    known = pages.select(canonical_url(F.col("url")).alias("key"), "url", "html").filter("key is not null").groupBy("key").agg(F.min_by(F.struct("url", "html"), "url").alias("p"))
    links = spread(known.select("key", canonical_url(dom.page_facets("next_page")(F.col("p.html"), F.col("p.url"))["next_page"]).alias("following")), "page-links")
    now = spread(starts.select(canonical_url(F.col("start")).alias("start")).distinct().join(links, F.col("start") == F.col("key")).select("start", "key", F.lit(0).alias("place")), "page-chain")
    found = now
    for k in range(1, most):
        ahead = now.join(links, "key").select("start", F.col("following").alias("key")).filter("key is not null").join(links.select("key"), "key", "left_semi")
        now = spread(ahead.join(found.select("start", "key"), ["start", "key"], "left_anti").select("start", "key", F.lit(k).alias("place")), "page-chain")
        if now.isEmpty():
            break
        found = found.union(now)
    return found.join(known, "key").select("start", "p.url", "place", "p.html")


def list_items(chain: DataFrame, recipe: tuple[str, dict[str, tuple[str, str | None]]], kinds: dict[str, str], owner: str | None = None) -> DataFrame:
    """Items of lists' pages (start, url, place, html), each once for a list: start, ord, and a struct of value and evidence for each field.

    Values take the form of their column's kind (number, pay, arrangement, else text); what is quoted stays as the page has
    it. Where a recipe lacks the field `owner`, the page's site owner fills it.
    """
    items, fields = recipe
    once = chain.groupBy("url").agg(F.first("html").alias("html")).withColumn("page_id", F.col("url"))  # a page can be in many lists
    found = elements.parts(once, "owner").withColumnRenamed("owner", "_owner")
    listed = recipes.replay_parts(found, items, fields).select("page_id", F.col("ord").alias("n"), F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))]), lambda _, v: v.isNotNull()).alias("item"))
    rows = chain.select("start", "place", "url").join(found.select("page_id", "url", "_owner"), "url").join(listed, "page_id")
    once = rows.groupBy("start", F.to_json(F.map_entries("item")).alias("_same")).agg(F.min(F.struct("place", "n", "url", "_owner")).alias("at"), F.min_by("item", F.struct("place", "n")).alias("item"))
    value = lambda f: _dom_value(F.col("item")[f], kinds.get(f, "text"), F.col("at.url"))
    out = once.select("start", F.struct("at.place", "at.n").alias("ord"), *[value(f).alias(f) for f in fields], *([_dom_value(F.col("at._owner"), "text", F.col("at.url")).alias(owner)] if owner and owner not in fields else []))
    return out.filter(" or ".join(f"{f} is not null" for f in fields))


def _dom_value(raw: Column, kind: str, url: Column) -> Column:
    return from_text(Proof(FORMS[kind](raw), raw), raw, url, "DOM")


def record_items(pages: DataFrame, fields: list[str], hints: dict[str, tuple[str, ...]]) -> DataFrame:
    """Items of single pages (url, html): url, n, and each field as text, from the page's own data.

    A page that lists several entries gives one item for each, any other page one; an item's address is its own link, else
    the page's canonical one, else the page's.
    """
    s = dom.page_facets("json_ld", "canonical")(F.col("html"), F.col("url"))
    rows = pages.select("url", s.alias("s")).withColumn("entries", schema_org.item_list(F.col("s.json_ld")))
    things = F.when(F.size("entries") > 1, F.col("entries")).otherwise(F.array(F.get(F.col("s.json_ld"), F.lit(0))))
    each = rows.select("url", "s.canonical", F.posexplode(things).alias("n", "thing"))
    own = F.coalesce(canonical_url(schema_org.value(F.col("thing"), "url", "item.url")), canonical_url(F.col("canonical")), F.col("url"))
    return each.select(F.col("url").alias("page"), "n", own.alias("url"), *[schema_org.by_name(F.col("thing"), f, hints).alias(f) for f in fields if f != "url"])
