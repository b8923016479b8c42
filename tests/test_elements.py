"""Elements of pages against plain walks over the parsed page."""

import math
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerframe.functions import dom
from ledgerframe.operators import elements
from tests.plain_pages import Page, own_selector, repeated_groups

PAGE = """<html><body><nav><ul><li><a href="/a">Jobs here now</a></li><li><a href="/b">About us all</a></li><li><a href="/c">Contact them</a></li></ul></nav>
<main class="content"><h1>Open roles of Acme</h1><div class="card wide"><h2><a href="/1">Data engineer</a></h2><p>Builds pipelines for data in Oslo</p></div>
<div class="card"><h2><a href="/2">Data scientist</a></h2><p>Models demand of goods</p></div><div class="card"><h2><a href="/3">Cook of soups</a></h2><p>Cooks</p></div>
<p hidden>gone</p><div class="sidebar" id="ads"><p>buy</p></div><table><tr><td data-testid="x">1</td></tr></table></main></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    own = spark.createDataFrame([(-1, PAGE), (-2, None), (-3, "")], "page_id long, html string")
    return given.union(own)


@pytest.fixture(scope="module")
def parsed(pages):
    return {r.page_id: dom.parse(r.html) for r in pages.collect()}


@pytest.fixture(scope="module")
def rows(pages):
    return elements.elements(pages).cache()


def test_one_row_for_each_visible_element(pages, rows, parsed):
    seen = defaultdict(dict)
    texts = {r.page_id: r.text for r in elements.parts(pages).select("page_id", "text").collect()}
    for r in rows.collect():
        seen[r.page_id][r.i] = r
    for page_id, root in parsed.items():
        def visible(node):
            for c in node.children:
                if isinstance(c, dom.Node) and not c.hidden:
                    yield c
                    yield from visible(c)

        nodes = list(visible(root))
        got = seen[page_id]
        assert sorted(got) == list(range(len(nodes)))
        for i, node in enumerate(nodes):
            r, below = got[i], list(visible(node))
            assert (r.tag, r.selector, r.last) == (node.tag, own_selector(node)[0], i + len(below))
            assert r.letters + max(r.words - 1, 0) == len(node.text())
            assert r.parent == -1 or nodes[r.parent] is node.parent
            assert r.linked <= r.chars <= r.markup
            assert texts[page_id][r.start : r.stop] == node.text()


def test_groups_equal_a_walk(pages, rows, parsed):
    got = defaultdict(list)
    for g in elements.groups(rows).collect():
        got[g.page_id].append((g.selector, g["items"], round(g.mean_text, 6), round(g.link_share, 6), g.score))
    htmls = {r.page_id: r.html for r in pages.collect()}
    for page_id in parsed:
        want = repeated_groups(Page(htmls[page_id]))[:5]
        assert sorted(x[4] for x in got[page_id]) == pytest.approx(sorted(x[4] for x in want))
        assert len(set(x[4] for x in want)) < len(want) or sorted(got[page_id]) == sorted(want)


def test_content_equals_a_walk(rows):
    got = {(g.page_id, g.i): g for g in elements.content(rows, "data of the cook", 10_000).collect()}
    pages = defaultdict(dict)
    for r in rows.collect():
        pages[r.page_id][r.i] = r
    want = {}
    for page_id, found in pages.items():
        def score(r):
            names = [r.attributes.get(k) for k in ("class", "id") if r.attributes.get(k)]
            bad = sum(any(n.lower().startswith(w) for w in ("nav", "footer", "header", "sidebar", "ads", "comment", "promo", "advert", "social", "share")) for n in names)
            return 0.4 * (r.chars / r.markup if r.markup else 0) + 0.2 * (1 - (r.linked / r.chars if r.chars else 0)) + 0.2 * elements.TAG_WEIGHTS.get(r.tag, 0.5) - 0.05 * bad + 0.1 * math.log(r.chars + 1)

        ok = {i: (r.tag in ("html", "body") or score(r) >= 0.48) and r.tag not in elements.CHROME for i, r in found.items()}
        for i, r in found.items():
            above, a = [], i
            while a >= 0:
                above.append(a)
                a = found[a].parent
            if all(ok[a] for a in above) and r.tag in elements.BLOCKS and r.text:
                want[page_id, i] = (round(score(r), 9), len({w for w in r.text.lower().replace(",", " ").replace(".", " ").split()} & {"data", "cook"}))
    assert set(got) == set(want)
    assert all(got[k].score == pytest.approx(want[k][0]) for k in want)
    own = sorted((g for k, g in got.items() if k[0] == -1), key=lambda g: g.place)
    assert own[0].relevance == 1 and [g.place for g in own] == list(range(1, len(own) + 1)) and not any("Jobs here" in g.text or g.text == "buy" for g in own)


def test_alike_elements(rows, parsed):
    cards = rows.filter("page_id = -1 and selector like 'div.card%'")
    first = cards.groupBy("page_id").agg(F.min("i").alias("i"))
    got = {r.other for r in elements.alike(rows, first).collect()}
    found = {r.i: r for r in rows.filter("page_id = -1").collect()}
    target = found[first.first().i]
    want = set()
    for i, r in found.items():
        if i != target.i and (r.depth, r.chain) == (target.depth, target.chain):
            mine, theirs = ({k: v for k, v in x.attributes.items() if k not in ("href", "src")} for x in (target, r))
            like = not theirs if not mine else bool(theirs) and math.floor(sum(SequenceMatcher(None, v, theirs.get(k, "")).ratio() for k, v in mine.items()) / len(theirs) * 100 + 0.5) / 100 >= 0.2
            if like:
                want.add(i)
    assert got == want and len(got) >= 2


def test_pages_are_worked_on_in_slices(spark):
    import pandas as pd

    from ledgerframe.functions import slices

    texts = pd.Series(["x" * slices.CHARACTERS, None, "a", *["b"] * (slices.ROWS + 5), "y" * (slices.CHARACTERS - 1), "zz"])
    parts = [p[0] for p in slices.slices((texts, texts.map(lambda _: None)))]
    assert pd.concat(parts).equals(texts) and all(len(p) <= slices.ROWS and (len(p) == 1 or sum(map(len, p.dropna())) <= slices.CHARACTERS) for p in parts) and len(parts) >= 4
    assert list(slices.slices((texts[:0],))) == []
    page = "<ul>" + "<li><a href='/x'>entry</a>" * 4_000 + "</ul>"
    rows = spark.range(0, 40, 1, 1).select(F.col("id").alias("page_id"), F.when(F.col("id") % 9 > 0, F.concat(F.lit(page), F.lit("<p>"), F.col("id").cast("string"))).alias("html"))
    found = elements.elements(rows)
    assert {r.page_id: r["count"] for r in found.groupBy("page_id").count().collect()} == {k: 8_002 for k in range(40) if k % 9}
    said = rows.select("page_id", dom.page_facets("text")(F.col("html"), F.lit("https://a.example/"))["text"].alias("text")).collect()
    assert [(r.text or "").split("\n")[-1] for r in sorted(said)] == [str(k) if k % 9 else "" for k in range(40)]


def test_tables_of_pages_are_not_broadcast(spark):
    from ledgerframe.session import spread

    rows = spark.range(1_000).select("id", F.array_repeat(F.lit("x" * 1_000), 50).alias("steps"))  # 50 MB in a file of a few KB
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    kept = spread(rows, "test").filter("id % 2 = 0").select("id", F.explode("steps").alias("step"))
    assert "Broadcast" not in plan(spark.range(10_000_000).join(kept, "id"))
    assert kept.join(spark.range(10), "id").count() == 250


def test_pages_are_parsed_once(spark):
    rows = spark.createDataFrame([(1, "https://a.example/", "<h1>Acme Ltd</h1><p>a<b>c</b>"), (2, None, None), (3, "https://b.example/", "<script>1</script>")], "page_id long, url string, html string")
    found = elements.elements(rows)
    assert found._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1
    assert sorted((r.page_id, r.i, r.tag) for r in found.collect()) == [(1, 0, "h1"), (1, 1, "p"), (1, 2, "b")]
    read = {r.page_id: (r.text, [e.tag for e in r.elements], r.owner) for r in elements.parts(rows, "owner").collect()}
    assert read == {1: ("Acme Ltd\nac", ["h1", "p", "b"], "Acme Ltd"), 2: ("", [], None), 3: ("", [], None)}


def test_batches_stay_packed_beside_the_slice_at_work(spark):
    import tracemalloc

    import pandas as pd
    import pyarrow as pa
    from pyspark.sql import types as T

    from ledgerframe.functions import slices

    def held(texts: pd.Series) -> pd.DataFrame:  # traced from the first batch on, so that the second is seen whole
        tracemalloc.start() if not tracemalloc.is_tracing() else None
        return pd.DataFrame({"n": [None if t is None else len(t) for t in texts], "held": tracemalloc.get_traced_memory()[0], "marks": [{"a": "b"}] * len(texts)})

    kind = T.StructType().add("n", "long").add("held", "long").add("marks", T.MapType(T.StringType(), T.StringType()))
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        text = F.when(F.col("id") != 30, F.concat(F.repeat(F.lit("x"), slices.CHARACTERS), F.col("id").cast("string")))
        made = spark.range(0, 40, 1, 1).select("id", slices.sliced_udf(kind)(held)(text).alias("p")).select("id", "p.*").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert [r.n for r in made] == [None if k == 30 else slices.CHARACTERS + len(str(k)) for k in range(40)] and all(r.marks == {"a": "b"} for r in made)
    assert max(r.held for r in made) < 30 * slices.CHARACTERS  # a batch has twenty times as many, in Arrow's form alone
    texts = pa.array(["é€😀", None, "", *["b"] * (slices.ROWS + 5)])
    assert [t for p in slices.slices((texts, texts)) for t in p[0]] == texts.to_pylist() and list(slices.slices((texts[:0],))) == []
