"""Choosing sources: kinds of hits, merged searches, boards among hits, recall of earlier plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerframe.functions.text import normalize_text, trigrams
from ledgerframe.functions.url import board_of, canonical_url, document_kind, site_of
from ledgerframe.operators.scale import join_groups
from ledgerframe.session import materialise

# Hosts of people's profiles; words of list pages; legal forms and endings that a board's slug may lack.
PROFILES = ("linkedin.com", "x.com", "twitter.com", "instagram.com", "tiktok.com", "youtube.com", "github.com")
LISTS = r"(?i)(?:\btop\b|\bbest\b|\blist of\b|\bdirectory\b|/(?:tags?|category|directory|list|search)(?:/|$))"

ENDINGS = r"\b(?:inc|llc|ltd|corp|co|labs?|technologies|technology|hq|ai)\b\.?"
LEGAL = r"\b(?:inc|incorporated|llc|ltd|limited|gmbh|corp|corporation|co|plc|sa|ag|bv)\b\.?"


def hit_kind(url: Column, title: Column) -> Column:
    """profile, document, list, or null where the shape doesn't tell."""
    return F.when(site_of(url).isin(*PROFILES), "profile").when(document_kind(url).isNotNull(), "document").when(F.concat_ws(" ", title, url).rlike(LISTS), "list")


def merge_hits(hits: DataFrame, most: int | None = None) -> DataFrame:
    """Hits (query_ord, hit_ord, url) once by canonical URL, the first query wins; links that aren't addresses are dropped."""
    rows = hits.withColumn("canonical", canonical_url(F.col("url"))).filter("canonical is not null")
    first = rows.groupBy("canonical").agg(F.min(F.struct("query_ord", "hit_ord", "url")).alias("x")).select("canonical", "x.*")
    return first if most is None else first.orderBy("query_ord", "hit_ord").limit(most)


def boards_from_hits(hits: DataFrame, seen: DataFrame, most: int) -> DataFrame:
    """Boards (kind, slug) among hits that aren't in `seen`, in first-seen order, the first `most`."""
    rows = hits.withColumn("board", board_of(F.col("url"))).filter("board is not null").select("board.kind", "board.slug", "query_ord", "hit_ord")
    found = rows.groupBy("kind", "slug").agg(F.min(F.struct("query_ord", "hit_ord")).alias("at"), F.count("*").alias("hits"))
    return found.join(seen, ["kind", "slug"], "left_anti").orderBy("at").limit(most).select("kind", "slug", "hits")


def select_sources(registry: DataFrame, companies: DataFrame, tags: list[str], excluded: DataFrame, linked: bool = False) -> DataFrame:
    """Registry rows (name, slug, tags): those of named companies if any match, else none if the request links pages, else those that share a tag if tags are asked for, else all; never excluded ones.

    A company is named by its name or slug, in the form for comparing, or by a slug that spells the name with or without
    its legal form.
    """
    key = normalize_text(F.col("name"))
    rows = registry.withColumn("_key", key).join(excluded.select(normalize_text(F.col("name")).alias("_key")), "_key", "left_anti").drop("_key")
    form = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("form"))
    slug = F.coalesce(F.col("slug").cast("string"), F.lit(""))
    known = rows.select("name", "slug", F.explode(F.array(form("text", key), form("text", normalize_text(slug)), form("slug", slug))).alias("f"))
    asked = companies.select(F.explode(F.concat(F.array(form("text", key)), F.transform(name_slugs(F.col("name")), lambda s: form("slug", s)))).alias("f")).filter("f.form <> ''").distinct()
    matched = known.join(asked, "f", "left_semi").select(F.col("name").alias("_name"), F.col("slug").alias("_slug")).distinct()
    named = rows.join(matched, F.col("name").eqNullSafe(F.col("_name")) & F.col("slug").eqNullSafe(F.col("_slug")), "left_semi").withColumn("_rank", F.lit(0))
    others = rows.limit(0) if linked else rows
    tagged = others.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))).withColumn("_rank", F.lit(1)) if tags else others.limit(0).withColumn("_rank", F.lit(1))
    every = named.unionByName(tagged).unionByName(others.withColumn("_rank", F.lit(2)).limit(0) if tags else others.withColumn("_rank", F.lit(2)))
    best = every.agg(F.min("_rank").alias("_best"))
    return every.join(F.broadcast(best), F.col("_rank") == F.col("_best")).drop("_rank", "_best")  # one row


def fresh_queries(wanted: DataFrame, tried: DataFrame, most: int = 3) -> DataFrame:
    """Queries (ord, query) not tried before, whatever their case, each once, the first `most`."""
    key = F.lower(F.trim("query"))
    rows = wanted.withColumn("_key", key).filter("_key <> ''").groupBy("_key").agg(F.min(F.struct("ord", "query")).alias("x"))
    return rows.join(tried.select(key.alias("_key")).distinct(), "_key", "left_anti").orderBy("x.ord").limit(most).select("x.ord", "x.query")


def recall(requests: DataFrame, plans: DataFrame, least: float = 0.7, valid: int = 20) -> DataFrame:
    """For each request (id, text) the most similar earlier plan (plan_id, text, n_valid) by trigrams, at least `least`.

    Equal texts are compared once. A pair as similar as that shares a trigram among the rarest of both (all but
    `least` of them, and one), so texts meet through these only, in one order of all trigrams by frequency; common
    trigrams bring no pairs together.
    """
    x = requests.groupBy("text").agg(F.count("*").alias("rows")).withColumn("grams", trigrams(F.col("text")))
    y = plans.filter(F.col("n_valid") >= valid).groupBy("text").agg(F.min("plan_id").alias("plan_id")).withColumn("grams", trigrams(F.col("text")))
    known = materialise(y, "recall-plans")
    found = similar_texts(materialise(x.select("text", "grams"), "recall-texts"), known.select("text", "grams"), least)
    near = found.join(known.select(F.col("text").alias("other"), "plan_id"), "other")
    best = near.groupBy("text").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "plan_id")).alias("x"))
    return join_groups(requests.select("id", "text"), best.join(x.select("text", "rows"), "text"), "text", "rows").select("id", "x.plan_id", (-F.col("x.s")).alias("similarity"))


def similar_texts(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Pairs (text, other, similarity) of distinct texts (text, grams) of both sides whose grams are at least that similar, equal texts among them."""
    often = a.union(b).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))

    def rarest(side: DataFrame) -> DataFrame:
        placed = side.select("text", F.size("grams").alias("size"), F.explode("grams").alias("gram")).join(often, "gram")
        ranked = placed.groupBy("text", "size").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("g"))  # as many as the text has
        few = F.col("size") - F.ceil(F.col("size") * F.lit(least) - F.lit(1e-9)) + 1
        return ranked.select("text", "size", F.explode(F.slice("g", F.lit(1), few.cast("int"))).alias("g")).select("text", "size", "g.gram")

    one, two = rarest(a), rarest(b).select(F.col("text").alias("other"), F.col("size").alias("other_size"), "gram")
    fits = F.least("size", "other_size") >= F.greatest("size", "other_size") * least - 1e-9
    pairs = one.join(two, "gram").filter(fits).select("text", "other").distinct()
    both = pairs.join(a.select("text", F.col("grams").alias("x")), "text").join(b.select(F.col("text").alias("other"), F.col("grams").alias("y")), "other")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("text", "other", (shared / (F.size("x") + F.size("y") - shared)).alias("similarity")).filter(F.col("similarity") >= least)


def company_key(name: Column) -> Column:
    """A company's name or slug as lower-case letters and digits."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def company_form(name: Column) -> Column:
    """A company's name without legal forms, for comparing."""
    return F.regexp_replace(F.lower(name), LEGAL, "")


def name_slugs(name: Column) -> Column:
    """Slugs that spell a whole name, joined and hyphenated, with and without endings, each once, of two characters at least."""
    words = lambda t, kept: F.filter(F.split(F.regexp_replace(t, kept, " "), r"\s+"), lambda w: w != "")
    every, core = words(F.lower(name), r"[^a-z0-9\s-]"), words(F.regexp_replace(F.lower(name), ENDINGS, " "), r"[^a-z0-9\s]")
    return F.array_distinct(F.filter(F.array(*[F.array_join(w, by) for w in (every, core) for by in ("", "-")]), lambda s: F.length(s) >= 2))


def slug_variants(name: Column) -> Column:
    """`name_slugs`, then the first word of the name's core."""
    core = F.get(F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(name), ENDINGS, " "), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: w != ""), F.lit(0))
    return F.array_distinct(F.filter(F.concat(name_slugs(name), F.array(F.coalesce(core, F.lit("")))), lambda s: F.length(s) >= 2))


# What parts a posting's title, what a cut title ends with, the number that a taken slug ends with.
TITLE_PARTS, CUT_OFF, SLUG_NUMBER = r"\s+(?:[-–—|@]|at)\s+", r"\s*(?:\.\.\.|…)$", r"-\d+$"
#: Letters that a name and a slug must have in common.
LEAST_COMMON = 3


def company_names(titles: DataFrame) -> DataFrame:
    """(slug, name) of boards from their postings' titles (slug, ord, title): the longest title part that fits the slug.

    A part fits if its letters equal the slug's, or start alike down to the end of the shorter one, or end with the slug's,
    with LEAST_COMMON letters in common. Without a fitting part the name is the slug in words.
    """
    own = F.regexp_replace("slug", SLUG_NUMBER, "")
    spelled = F.array_join(F.transform(F.filter(F.split(own, "[-_]"), lambda w: w != ""), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), " ")
    slugs = titles.select("slug", company_key(own).alias("key"), spelled.alias("spelled"), "ord", F.posexplode(F.split("title", TITLE_PARTS)).alias("place", "part"))
    letters = slugs.withColumn("letters", company_key(F.col("part"))).withColumn("common", F.least(F.length("letters"), F.length("key")))
    starts = F.left("letters", F.col("common")) == F.left("key", F.col("common"))
    ends = (F.length("letters") >= F.length("key")) & (F.right("letters", F.length("key")) == F.col("key"))
    fits = ((F.col("common") >= LEAST_COMMON) & (starts | ends)) | (F.col("letters") == F.col("key"))
    named = F.struct(F.length("part").alias("n"), (-F.col("ord")).alias("ord"), (-F.col("place")).alias("place"), "part")
    best = letters.groupBy("slug", "spelled").agg(F.max(F.when(fits, named)).alias("best"))
    return best.select("slug", F.coalesce(F.trim(F.regexp_replace("best.part", CUT_OFF, "")), "spelled").alias("name"))


def capped_hits(hits: DataFrame, robots: DataFrame, lists: int = 8, records: int = 10) -> DataFrame:
    """The first list pages and the first record pages among hits (ord, url, site, kind: list or record) whose site allows reading (site, allowed)."""
    first = lambda kind, most: hits.filter(F.col("kind") == kind).orderBy("ord").limit(most)
    return first("list", lists).unionByName(first("record", records)).join(robots.filter("allowed").select("site").distinct(), "site", "left_semi")


def profile_sites(hits: DataFrame, most: int = 100) -> DataFrame:
    """One source for each site of profile hits (site, ord, url): how many it has and its first addresses, `most` at most."""
    ranked = hits.withColumn("n", F.row_number().over(W.partitionBy("site").orderBy("ord"))).filter(F.col("n") <= most)
    counts = hits.groupBy("site").agg(F.count("*").alias("hits"), F.min("ord").alias("ord"))
    return counts.join(ranked.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("ord", "url")))["url"].alias("urls")), "site")


def documents_by_query(files: DataFrame, seen: DataFrame, most: int) -> DataFrame:
    """Base queries with files (base, ord, url), each file once for its first query and none already seen: the first `most` queries and their files' count."""
    once = files.groupBy("url").agg(F.min(F.struct("ord", "base")).alias("x")).select("url", "x.*").join(seen.select("url"), "url", "left_anti")
    return once.groupBy("base").agg(F.count("*").alias("files"), F.min("ord").alias("ord")).orderBy("ord").limit(most)


def ordered_candidates(linked: DataFrame, known: DataFrame) -> DataFrame:
    """Sources (ref, ord) that a request links first, then the known ones it doesn't link."""
    rows = linked.select("ref", F.lit(0).alias("rank"), "ord").unionByName(known.join(linked.select("ref"), "ref", "left_anti").select("ref", F.lit(1).alias("rank"), "ord"))
    return rows.groupBy("ref").agg(F.min(F.struct("rank", "ord")).alias("x")).select("ref", "x.rank", "x.ord")


def rounds(search, state, most: int = 5):
    """Search again until a round brings nothing fresh, `most` rounds at most; `search(state, k)` returns (fresh rows, next state).

    Each round is a job of its own; their fresh rows are returned in order.
    """
    found = []
    for k in range(most):
        fresh, state = search(state, k)
        if fresh.isEmpty():
            break
        found.append(fresh)
    return found, state


def request_queries(queries: list[str], description: str, most: int = 8) -> list[str]:
    """Distinct trimmed queries of a request, `most` at most, else its description."""
    return list(dict.fromkeys(q.strip() for q in queries if q.strip()))[:most] or [description.strip()]


def role_words(title: str, keywords: list[str], remote: bool, location: str | None) -> str:
    """What to search boards for: the longest role keyword that the title has at a word's start (else the first keyword, else the title), 'remote', the place."""
    import re

    held = [k for k in sorted(keywords, key=len, reverse=True) if re.search(rf"(?:^|[^a-z0-9]){re.escape(k.strip().lower())}", title.lower())]
    return " ".join(x for x in (held[0] if held else keywords[0] if keywords else title, "remote" if remote else None, location) if x)
