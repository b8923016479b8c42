"""Pages as rows of elements: repeated groups, content by relevance and density, alike elements, selectors that fit a group."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ledgerframe.functions import dom
from ledgerframe.functions.pages import shared
from ledgerframe.functions.slices import sliced_udf
from ledgerframe.functions.text import sequence_ratio
from ledgerframe.session import spread

# How much tags count as content, what names an element that is none, weights of the content score and its
# threshold, parts of a page that are never content.
TAG_WEIGHTS = {"div": 0.5, "p": 1.0, "article": 1.5, "section": 1.0, "span": 0.3, "li": 0.5, "ul": 0.5, "ol": 0.5, "h1": 1.2, "h2": 1.1, "h3": 1.0, "h4": 0.9, "h5": 0.8, "h6": 0.7}
NEGATIVE = r"(?i)^(?:nav|footer|header|sidebar|ads|comment|promo|advert|social|share)"
TEXT_DENSITY, LINK_DENSITY, TAG, NAMED, LENGTH, LEAST_SCORE = 0.4, 0.2, 0.2, 0.1, 0.1, 0.48
CHROME = ("nav", "footer", "aside", "form", "svg", "iframe")
BLOCKS = ("address", "article", "blockquote", "dd", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "li", "main", "ol", "p", "pre", "section", "table", "tbody", "td", "th", "thead", "tr", "ul")
# Items of a group and their text at least, text that counts, weights of bare tags and of fragile selectors.
LEAST_GROUP, LEAST_TEXT, MOST_TEXT, BARE, FRAGILE = 3, 8, 200, 0.3, 0.8
#: Attributes that say nothing about an element's kind.
OWN = ("href", "src")

# Attributes that name an element for good, best first; class names that a selector can spell; forms of those
# that tools generate, which change with every build.
STABLE = ("data-ui", "data-testid", "data-test", "data-qa", "data-automation-id", "itemprop")
PLAIN = r"(?U)^-?[_a-zA-Z][\w-]*$"
GENERATED = (r"^(?:css|sc|jsx|emotion|svelte|tw)-[A-Za-z0-9]{3,}", r"--[A-Za-z0-9_-]{4,}$", r"__[A-Za-z0-9]{5}$", r"^[a-z]{1,3}[A-Z0-9][A-Za-z0-9]{4,}$")

ELEMENT = (
    T.StructType().add("i", "integer").add("parent", "integer").add("last", "integer").add("depth", "integer").add("tag", "string").add("chain", "string")
    .add("attributes", T.MapType(T.StringType(), T.StringType())).add("text", "string").add("letters", "integer").add("words", "integer").add("link", "boolean").add("chars", "integer").add("markup", "integer").add("linked", "integer")
    .add("start", "integer").add("stop", "integer")
)
PARTS = T.StructType().add("text", "string").add("elements", T.ArrayType(ELEMENT))


class _Text:
    """A page's visible text as it is written: blocks on lines of their own, other white space collapsed."""

    def __init__(self):
        self.parts, self.length, self.gap = [], 0, ""

    def write(self, piece: str) -> None:
        words = piece.split()
        self.space(piece and piece[0].isspace())
        if words:
            line = ("" if not self.length else self.gap) + " ".join(words)
            self.parts.append(line)
            self.length += len(line)
            self.gap = ""
        self.space(piece and piece[-1].isspace())

    def space(self, wanted: bool) -> None:
        self.gap = self.gap or (" " if wanted else "")

    def line(self) -> None:
        self.gap = "\n"


def _parts(page: str | None, url: str | None = None, facets: tuple[str, ...] = ()) -> dict:
    """A page's text, one entry for each visible element in document order, and the facets asked for.

    `i` to `last` are the numbers of an element and of what lies below it; `start` to `stop` is its text's place in the
    page's. Sizes grow with the page alone: no entry repeats what lies below it or above it, but for the text of inline elements.
    """
    root = dom.parse(page)
    size, text, out = dom.measures(root), _Text(), []
    ahead: list[tuple] = [("open", root, -1, -1)]
    while ahead:
        what, node, parent, depth = ahead.pop()
        if what == "text":
            text.write(node)
        elif what == "close":
            out[parent]["stop"] = text.length
            text.line() if node.tag in dom.BLOCK else None
        elif node is root or not node.hidden:
            i = parent
            if node is not root:
                i = len(out)
                text.line() if node.tag in dom.BLOCK else None
                letters, words, *_, link = size[node]
                own = " ".join("".join(c if isinstance(c, str) else " " if c.tag in BLOCKS else _inline(c) for c in node.children).split())
                chain = "<".join(x.tag for x in (node, node.parent, node.parent.parent if node.parent else None) if x is not None and x.tag != "#root")
                out.append({"i": i, "parent": parent, "last": i, "depth": depth, "tag": node.tag, "chain": chain, "attributes": dict(node.attributes), "text": own, "letters": letters, "words": words, "link": link,
                            "chars": sum(len(c.strip()) for c in node.children if isinstance(c, str)), "markup": 2 * len(node.tag) + 5 + sum(len(k) + len(v) + 4 for k, v in node.attributes.items()) + sum(len(c) for c in node.children if isinstance(c, str)), "linked": 0,
                            "start": text.length, "stop": 0})
                ahead.append(("close", node, i, depth))
            ahead += [("text", c, i, depth) if isinstance(c, str) else ("open", c, i, depth + 1) for c in reversed(node.children)]
    whole = "".join(text.parts)
    for e in reversed(out):  # sums, from the leaves up
        if e["tag"] == "a":
            e["linked"] = e["chars"]
        if e["parent"] >= 0:
            above = out[e["parent"]]
            for k in ("chars", "markup", "linked"):
                above[k] += e[k]
            above["last"] = max(above["last"], e["last"])
        e["start"] += e["start"] < e["stop"] and whole[e["start"]] in " \n"
    return {"text": whole, "elements": out} | {f: dom.FACETS[f][0](root, url or "") for f in facets}


def _inline(node: dom.Node) -> str:
    """Text below an inline element, without that of blocks."""
    if node.hidden:
        return " "
    return f" {''.join(c if isinstance(c, str) else ' ' if c.tag in BLOCKS else _inline(c) for c in node.children)} "


@sliced_udf(PARTS)
def page_parts(page: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_parts(p) for p in page], columns=["text", "elements"])


def parts(pages: DataFrame, *facets: str) -> DataFrame:
    """Pages (page_id, html, other columns) with `text` and `elements` in place of html, written once for all that reads them.

    Facets of `dom` that are asked for are further columns, from the same parse; they need the page's url.
    """
    one = page_parts(F.col("html"))
    if facets:

        @sliced_udf(T.StructType([*PARTS, *[T.StructField(f, dom.FACETS[f][1]) for f in facets]]))
        def run(page: pd.Series, url: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([_parts(p, u, facets) for p, u in zip(page, url)], columns=["text", "elements", *facets])

        one = run(F.col("html"), F.col("url"))
    made = ("text", "elements", *facets)
    return spread(pages.withColumn("_p", one).select(*[c for c in pages.columns if c not in ("html", *made)], *[f"_p.{c}" for c in made]), "page-parts")


def generated(name: Column) -> Column:
    """Whether a class name looks like a tool's."""
    return reduce(lambda a, b: a | b, [name.rlike(form) for form in GENERATED])


def classes_of(attributes: Column) -> Column:
    """The class names that a selector can spell."""
    return F.filter(F.split(F.coalesce(attributes["class"], F.lit("")), r"\s+"), lambda c: c.rlike(PLAIN))


def selector_of(tag: Column, attributes: Column) -> Column:
    """The steadiest selector of an element by itself, and whether it is fragile: the best ranked of what the element has."""
    names = classes_of(attributes)
    steady = F.filter(names, lambda c: ~generated(c))
    quoted = lambda a: F.concat(tag, F.lit(f'[{a}="'), F.regexp_replace(attributes[a], r'(["\\])', r"\\$1"), F.lit('"]'))
    named = lambda a: F.when(attributes[a] != "", quoted(a))
    ranked = [*map(named, STABLE), F.when(F.size(steady) > 0, F.concat_ws(".", tag, F.slice(steady, 1, 2))), named("role")]
    best = F.coalesce(*ranked)
    return F.struct(F.coalesce(best, F.concat_ws(".", tag, F.get(names, F.lit(0)))).alias("selector"), (best.isNull() & (F.size(names) > 0)).alias("fragile"))


def rows_of(found: DataFrame) -> DataFrame:
    """One row for each element of `parts`, with its selector and whether that is fragile."""
    # The outer form: for the inner one Spark tests the list before it is opened, and would parse each page once more for that.
    rows = found.select("page_id", F.explode_outer("elements").alias("e")).filter("e is not null").select("page_id", "e.*")
    return rows.withColumn("_s", selector_of(F.col("tag"), F.col("attributes"))).select("*", "_s.selector", "_s.fragile").drop("_s")


def elements(pages: DataFrame) -> DataFrame:
    """One row for each visible element of each page (page_id, html)."""
    found = pages.select("page_id", page_parts(F.col("html"))["elements"].alias("elements"))
    return rows_of(found)


def inside(mark: Column) -> Column:
    """Whether an element lies below one that is marked: intervals nest, so it does if one before it reaches up to it."""
    before = W.partitionBy("page_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(mark, F.col("last"))).over(before) >= F.col("i"), F.lit(False))


def groups(rows: DataFrame, most: int = 5) -> DataFrame:
    """Alike siblings of each page, three or more with text: page_id, parent, selector, items, mean_text, link_share, score, place.

    The best `most` of a page, by count, text, links and how telling the selector is.
    """
    length = F.col("letters") + F.greatest(F.col("words") - 1, F.lit(0))
    found = rows.groupBy("page_id", "parent", "selector", "fragile").agg(F.count("*").alias("items"), F.avg(length).alias("mean_text"), F.avg(F.col("link").cast("double")).alias("link_share"))
    found = found.filter((F.col("items") >= LEAST_GROUP) & (F.col("mean_text") >= LEAST_TEXT))
    bare = ~(F.contains("selector", F.lit(".")) | F.contains("selector", F.lit("[")))
    score = F.col("items") * F.least("mean_text", F.lit(MOST_TEXT)) * (0.5 + F.col("link_share")) * F.when(bare, BARE).otherwise(1.0) * F.when(F.col("fragile"), FRAGILE).otherwise(1.0)
    ranked = found.withColumn("score", F.round(score, 6)).withColumn("place", F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("score"), "selector", "parent")))
    return ranked.filter(F.col("place") <= most).drop("fragile")


def content_score(tag: Column, chars: Column, markup: Column, linked: Column, named: Column) -> Column:
    """How much an element looks like content: text among markup, few links, a telling tag, no name of page furniture, length."""
    density = F.when(markup > 0, chars / markup).otherwise(0.0)
    links = F.when(chars > 0, linked / chars).otherwise(0.0)
    weight = F.coalesce(*[F.when(tag == t, w) for t, w in TAG_WEIGHTS.items()], F.lit(0.5))
    return TEXT_DENSITY * density + LINK_DENSITY * (1 - links) + TAG * weight + NAMED * named * -0.5 + LENGTH * F.log(chars + 1.0)


def content(rows: DataFrame, query: str, most: int = 20) -> DataFrame:
    """The content blocks of each page by relevance to a query, then by score: page_id, i, tag, text, relevance, score, place.

    A block counts if it and all around it look like content; its text is its own, without that of blocks within.
    """
    names = F.array_compact(F.array(F.nullif(F.col("attributes")["class"], F.lit("")), F.nullif(F.col("attributes")["id"], F.lit(""))))
    named = F.size(F.filter(names, lambda n: n.rlike(NEGATIVE)))
    scored = rows.withColumn("score", content_score(F.col("tag"), F.col("chars"), F.col("markup"), F.col("linked"), named))
    judged = scored.withColumn("out", (F.col("score") < LEAST_SCORE) & ~F.col("tag").isin("html", "body") | F.col("tag").isin(*CHROME))
    judged = judged.withColumn("lost", inside(F.col("out")))
    kept = judged.filter(~F.col("out") & ~F.col("lost") & F.col("tag").isin(*BLOCKS) & (F.col("text") != ""))
    kept = kept.select("page_id", "i", "tag", "text", "score").withColumn("relevance", shared(F.col("text"), query))
    ranked = kept.withColumn("place", F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("relevance"), F.desc("score"), "i")))
    return ranked.filter(F.col("place") <= most)


def alike(rows: DataFrame, targets: DataFrame, least: float = 0.2) -> DataFrame:
    """For each target (page_id, i) the elements of its page in the same depth and tags up to its grandparent, with like attributes: page_id, i, other.

    Attributes are as like as their values on average over the candidate's; without any, the candidate has none either.
    """
    kept = F.map_filter("attributes", lambda k, _: ~k.isin(*OWN))
    shaped = rows.select("page_id", "i", "depth", "chain", kept.alias("attributes"))
    t = shaped.join(targets.select("page_id", "i"), ["page_id", "i"], "left_semi")
    pairs = t.join(shaped.select("page_id", "depth", "chain", F.col("i").alias("other"), F.col("attributes").alias("theirs")), ["page_id", "depth", "chain"]).filter("i <> other")
    plain = pairs.filter((F.size("attributes") == 0) & (F.size("theirs") == 0)).select("page_id", "i", "other")
    each = pairs.filter((F.size("attributes") > 0) & (F.size("theirs") > 0)).select("page_id", "i", "other", F.size("theirs").alias("n"), "theirs", F.explode("attributes").alias("k", "v"))
    scored = each.groupBy("page_id", "i", "other", "n").agg(F.sum(sequence_ratio(F.col("v"), F.coalesce(F.col("theirs")[F.col("k")], F.lit("")))).alias("s"))
    return plain.union(scored.filter(F.floor(F.col("s") / F.col("n") * 100 + 0.5) / 100 >= least).select("page_id", "i", "other"))
