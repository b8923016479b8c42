"""Result pages of search engines as hits, by one recipe each; links that engines wrap are unwrapped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerframe.functions.url import host_of, parameter
from ledgerframe.operators import elements, recipes
from ledgerframe.operators.discovery import merge_hits

# For each engine, in order of trust, the place of its results and of link, title and snippet in them.
ENGINES = {
    "duckduckgo": ("#links .result", {"link": ("a.result__a", "href"), "title": ("a.result__a", None), "description": (".result__snippet", None), "ad": ("", "class")}),
    "bing": ("#b_results li.b_algo", {"link": ("h2 a", "href"), "title": ("h2 a", None), "description": (".b_caption p", None)}),
    "brave": ('.snippet[data-type="web"]', {"link": ("a[href]", "href"), "title": (".title", None), "description": (".generic-snippet .content", None)}),
}
AD = "result--ad"


def unwrap(link: Column) -> Column:
    """The page that a result's link leads to; null unless that is an absolute http(s) address."""
    once = F.when(host_of(link).endswith("duckduckgo.com") & link.rlike(r"^\w+://[^/]+/l/\?"), parameter(link, "uddg"))
    coded = F.translate(F.regexp_extract(link, r"[?&]u=a1([^&#]*)", 1), "-_", "+/")
    padded = F.rpad(coded, (F.ceil(F.length(coded) / 4) * 4).cast("int"), "=")
    other = F.when(host_of(link).endswith("bing.com") & link.rlike(r"^\w+://[^/]+/ck/a\?") & (coded != ""), F.decode(F.unbase64(padded), "utf-8"))
    page = F.coalesce(once, other, link)
    return F.when(host_of(page).isNotNull(), page)


def hits(pages: DataFrame, engine: str) -> DataFrame:
    """Hits of an engine's result pages (query_ord, html), in order: query_ord, hit_ord, url, title, description; ads are left out."""
    items, fields = ENGINES[engine]
    numbered = pages.select("query_ord", F.monotonically_increasing_id().alias("page_id"), F.lit("https://engine.invalid/").alias("url"), "html")
    found = elements.parts(numbered)
    rows = recipes.replay_parts(found, items, fields).join(found.select("page_id", "query_ord"), "page_id").withColumnRenamed("ord", "hit_ord")
    rows = rows.filter(~F.coalesce(F.contains("ad", F.lit(AD)), F.lit(False))) if "ad" in fields else rows
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    link = F.col("link")
    found = rows.select("query_ord", "hit_ord", unwrap(link).alias("url"), clean("title").alias("title"), clean("description").alias("description"))
    return found.filter(F.col("url").isNotNull() & (F.coalesce(host_of(F.col("url")), F.lit("")) != "engine.invalid"))


def merged(pages: dict[str, DataFrame], most: int) -> DataFrame:
    """Hits of several engines once by address, an engine adds what those before it haven't found; the first `most`."""
    every = [hits(p, engine).withColumn("query_ord", F.lit(i)) for i, (engine, p) in enumerate((e, pages[e]) for e in ENGINES if e in pages)]
    return merge_hits(reduce(DataFrame.unionByName, every), most)
