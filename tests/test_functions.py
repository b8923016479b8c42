import json

import pytest
from pyspark.sql import functions as F

from ledgerframe.functions import dom, parsers, text, url


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTP://www.Example.com/a/?b=2&a=1&utm_source=x#f", "https://example.com/a?a=1&b=2"),
        ("https://example.com:443/", "https://example.com"),
        ("https://example.com:8080/x//", "https://example.com:8080/x"),
        ("https://example.com/?a=2&a=1&REF=q", "https://example.com?a=2&a=1"),
        ("https://jobs.lever.co/acme/1/apply", "https://jobs.lever.co/acme/1"),
        ("https://boards.greenhouse.io/acme", "https://job-boards.greenhouse.io/acme"),
        ("mailto:a@b.c", None),
        ("/relative", None),
        (None, None),
    ],
)
def test_canonical_url(spark, raw, want):
    assert one(spark, url.canonical_url, raw) == want


def test_url_parts(spark):
    assert one(spark, url.url_pattern, "https://a.b/x/y?z") == "a.b/*/*"
    assert tuple(one(spark, url.board_of, "https://jobs.ashbyhq.com/Acme/123")) == ("ashby", "acme")
    assert one(spark, url.board_of, "https://example.com/Acme") is None
    assert one(spark, url.document_kind, "https://a.b/c.PDF?x") == "pdf"
    assert one(spark, lambda c: url.parameter(c, "u"), "https://a.b/?q=1&u=https%3A%2F%2Fc.d") == "https://c.d"


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Hybrid or remote", "hybrid"), ("No remote", "onsite"), ("Remote, EU", "remote"), ("On-site only", "onsite"), ("Berlin", None), ("", None), (None, None)],
)
def test_arrangement(spark, raw, want):
    assert one(spark, parsers.arrangement, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("24K followers", 24_000), ("1.2M", 1_200_000), ("8,100 subscribers", 8_100), ("none", None), (None, None)])
def test_count(spark, raw, want):
    assert one(spark, parsers.parse_count, raw) == want


PAY = [
    ("pays $120k - $160k a year", (120_000, 160_000, "USD", "year")),
    ("€55 / hour", (55, 55, "EUR", "hour")),
    ("120-160k", (120_000, 160_000, None, "year")),
    ("120k-160", (120_000, 160_000, None, "year")),
    ("$120k-150", (120_000, 150_000, "USD", "year")),
    ("$120k-150 USD", (120_000, 150_000, "USD", "year")),
    ("120,000 – €150,000", (120_000, 150_000, "EUR", "year")),
    ("$120,000. Hourly standups", (120_000, 120_000, "USD", "year")),
    ("$120,000 hourly", None),
    ("with a 401k and $5 lunch", None),
    ("a $100 stipend", None),
    ("$100 per hour", (100, 100, "USD", "hour")),
    ("$45-60", (45, 60, "USD", "hour")),
    ("£4,500 per month", (4_500, 4_500, "GBP", "month")),
    ("USD 90,000", (90_000, 90_000, "USD", "year")),
    ("C$95k to C$110k", (95_000, 110_000, "CAD", "year")),
    ("EUR $95k", (95_000, 95_000, "EUR", "year")),
    ("₹30,00,000", (3_000_000, 3_000_000, "INR", "year")),
    ("JPY 12,000,000", (12_000_000, 12_000_000, "JPY", "year")),
    ("we raised $40M", None),
    ("$160k-$120k or £50.000", (50_000, 50_000, "GBP", "year")),
    ("$1 of 2024, then £40,000–£50,000", (40_000, 50_000, "GBP", "year")),
    ("85.5k CHF p.a.", (85_500, 85_500, "CHF", "year")),
    ("90,000-110,000", None),
    ("", None),
    (None, None),
]


def test_pay(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PAY)], "i int, t string").select("i", parsers.pay(F.col("t")).alias("p"))
    got = {r.i: r.p for r in rows.collect()}
    for i, (t, want) in enumerate(PAY):
        assert (tuple(got[i])[:4] if got[i] else None) == want, t


def test_pay_as_text(spark):
    rows = spark.createDataFrame([(120_000.0, 160_000.0, "USD", "1 YEAR"), (None, 55.5, None, "per-hour-wage"), (None, None, "EUR", None)], "a double, b double, c string, i string")
    assert [r[0] for r in rows.select(parsers.stated_pay(*map(F.col, "abci"))).collect()] == ["USD 120,000–160,000 / year", "55.5 / hour", None]


def test_file_names(spark):
    assert one(spark, parsers.file_title, "[PDF] A guide - PDF") == "A guide" and one(spark, parsers.name_title, "Voice_SDK-Manual.pdf") == "Voice SDK Manual"
    assert one(spark, parsers.link_file_name, "https://a.b/x/My%20file.pdf?q") == "My file.pdf" and one(spark, parsers.link_file_name, "https://a.b/x/") is None
    for text, want in [("attachment; filename=\"a \\\"b\\\".pdf\"", 'a "b".pdf'), ("inline; filename=x.pdf", "x.pdf"), ("attachment; filename=x; filename*=UTF-8''r%C3%A9sum%C3%A9.pdf", "résumé.pdf"), ("inline", None)]:
        assert one(spark, parsers.disposition_name, text) == want


def test_counts_of_boards_and_waits(spark):
    assert [one(spark, parsers.count_postings, x) for x in ("[1,2]", '{"jobs":[{}]}', '{"a":1}', "no")] == [2, 1, 0, 0]
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert [one(spark, lambda c: parsers.retry_after(c, now), x) for x in ("5", "Mon, 1 Jan 2024 00:01:00 GMT", "-3", "soon")] == [5_000, 60_000, 0, None]


def test_locations(spark):
    assert one(spark, parsers.join_locations, ["Berlin", " berlin ", None, "New  York", ""], "array<string>") == "Berlin; New York"
    assert one(spark, parsers.location_bucket, "San Francisco, CA; New York") == "san francisco"
    assert one(spark, parsers.location_bucket, "Remote (US)") == "remote"
    assert one(spark, parsers.location_bucket, None) == "unknown"


def test_text(spark):
    assert one(spark, text.normalize_text, "Sr. R&D  Engineer, Café") == "senior r and d engineer caf"
    assert one(spark, lambda c: text.truncate(c, 10), "aaaaaaa bbbbbb") == "aaaaaaa…"
    assert one(spark, lambda c: text.truncate(c, 10), "a bbbbbbbbbbbbb") == "a bbbbbbb…"
    assert one(spark, text.normalize_whitespace, "ﬁne​ \t x\n\n y ") == "fine x\ny"
    assert one(spark, text.csv_cell, '=1+"2"') == '"\'=1+""2"""'
    assert one(spark, text.csv_cell, None) == ""
    assert one(spark, text.decode_entities, "a &amp; b") == "a & b"


def test_quotes(spark):
    row = spark.createDataFrame([("“quick\nBROWN” fox—dog", "The \"quick  brown\" FOX-dog.")], "q string, t string").select(text.verify_quote(F.col("q"), F.col("t")).alias("s")).first()["s"]
    assert (row["start"], row["stop"]) == (4, 26)


PAGE = """<html><head><title>Acme - Jobs</title><script>var a="<p>no</p>"</script><script type="application/ld+json">{"@graph":[{"@type":"A"},{"@type":"B"}]}</script></head>
<body><h1>Acme</h1><p>One<p>Two <b>bold<div hidden>gone</div><ul class="list"><li class="job"><a href="/1">First job here</a><li class="job"><a href="/2">Second job here</a><li class="job"><a href="/3">Third job here</a></ul>
<nav><a href="?page=2">Next »</a></nav></body></html>"""


def test_page():
    s = dom.state(PAGE, "https://acme.example/jobs")
    assert s["title"] == "Acme - Jobs" and s["owner"] == "Acme" and s["next_page"] == "https://acme.example/jobs?page=2"
    assert s["text"].split("\n")[:3] == ["Acme", "One", "Two bold"] and "gone" not in s["text"] and "no" not in s["text"].split()
    assert [json.loads(x)["@type"] for x in s["json_ld"]] == ["A", "B"]
    assert dom.state(None, None)["text"] == ""


def test_lengths_from_the_leaves_up_equal_those_of_the_text():
    import random

    rng, tags = random.Random(3), ["p", "b", "div", "a", "span", "li", "br", "script", "i"]
    for _ in range(200):
        page = "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "a", "bb ", " c", " ", "<div hidden>h</div>", "\n"]) for _ in range(40))
        root = dom.parse(page)
        size = dom.measures(root)
        for e in [root, *root.elements()]:
            if not e.hidden:
                letters, words, *_, link = size[e]
                assert letters + max(words - 1, 0) == len(e.text()), page
                assert link == bool(e.tag == "a" or e.find("a")), page


def test_embedded_data():
    page = """<script id="__NEXT_DATA__">{"a": 1}</script><script>window.__NUXT__ = {"b": "}{", "c": {"d": 2}}; x</script><script>__APOLLO_STATE__={bad}</script>
              <link rel="canonical" href="/own"><p>text"""
    s = dom.state(page, "https://www.a.b/x", ("embedded", "canonical"))
    assert [(e["name"], json.loads(e["data"])) for e in s["embedded"]] == [("__NEXT_DATA__", {"a": 1}), ("__NUXT__", {"b": "}{", "c": {"d": 2}})]
    assert s["canonical"] == "https://www.a.b/own" and dom.state('<link rel="canonical" href="https://c.d/">', "https://a.b")["canonical"] is None


@pytest.mark.parametrize(
    "body, url, wanted",
    [
        ('<link rel="next" href="/jobs?page=3"><nav><a href="/x">Next</a></nav>', "https://a.b/jobs", "https://a.b/jobs?page=3"),
        ('<a rel="nofollow next" href="?page=2">more</a>', "https://a.b/jobs", "https://a.b/jobs?page=2"),
        ('<a rel="next" href="https://www.a.b/jobs/#top">self</a><div class="pager"><a href="/p/2">Older posts</a></div>', "https://a.b/jobs", "https://a.b/p/2"),
        ('<a href="/away">Next</a><p>no pagination</p>', "https://a.b/jobs", None),
        ('<div role="navigation"><a href="/jobs?page=3" aria-label="Next page"></a></div>', "https://a.b/jobs", "https://a.b/jobs?page=3"),
        ('<nav><a href="/">Home</a></nav><ul class="pagination"><li class="active">4</li><li><a href="?p=5">5</a><a href="?p=1">1</a></ul>', "https://a.b/l?p=4", "https://a.b/l?p=5"),
        ('<ul class="pagination"><a href="?p=2">2</a><a href="?p=3">3</a></ul>', "https://a.b/l", "https://a.b/l?p=2"),
        ('<ul class="pagination"><a href="?p=2">2</a><a href="?p=3">3</a><b aria-current="page">2</b></ul>', "https://a.b/l?p=2", "https://a.b/l?p=3"),
        ('<nav><a href="/l?utm_source=x">Next →</a></nav>', "https://a.b/l/", None),
        ('<nav><a href="mailto:a@b.c">next</a></nav>', "https://a.b/l", None),
        ("", "https://a.b/l", None),
    ],
)
def test_next_page(body, url, wanted):
    assert dom.state(f"<body>{body}</body>", url, ("next_page",))["next_page"] == wanted


@pytest.mark.parametrize(
    "page, wanted",
    [
        ('<title>Careers | Acme</title><meta property="og:site_name" content="Acme  Labs">', "Acme Labs"),
        ('<meta name="application-name" content="Northwind"><h1>Open roles</h1>', "Northwind"),
        ('<meta property="og:site_name" content=" "><meta name="application-name" content="Third"><h1>Other</h1>', "Third"),
        ("<title>Acme | Careers</title>", "Acme"),
        ("<title>Acme: what we do</title><h1>Join us</h1>", "Acme: what we do"),
        ("<title>Acme – Careers – Berlin</title><h1>A very long heading that says more than a name</h1>", "Acme"),
        ("<title>Jobs | Acme</title><h1>Careers</h1>", None),
        ("", None),
    ],
)
def test_site_owner(page, wanted):
    assert dom.state(page, "https://a.b", ("owner",))["owner"] == wanted


def test_pages_are_measured_by_their_visible_text(spark):
    import re

    from ledgerframe import queries_sources

    sf = "/root/testdata/sf0.001"
    shells = r"(?i)<div[^>]+id=[\"'](?:root|app|__next|__nuxt|svelte)[\"'][^>]*>\s*</div>|enable javascript|javascript is required|requires javascript"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        n = len(dom.parse(r.html).text())
        want[r.page_id] = "little text" if n < 500 else "shell" if n < 2_000 and re.search(shells, r.html) else None
    assert {r.page_id: r.reason for r in queries_sources.prd24_needs_render(spark, sf).collect()} == want and len(set(want.values())) > 1


def test_halves_of_time_and_digits(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from ledgerframe.functions import pages
    from ledgerframe.operators import reads

    at = spark.sql("select timestamp(x) as at, k from values ('2024-05-29 12:00:00', 0), ('2024-05-30 12:00:00', 1), ('2024-06-03 12:00:00', 2), ('2024-05-31 23:59:00.5', 3), ('2024-05-31 22:30:00', 4), (null, 5) as t(x, k)")
    got = [r.ago for r in at.select("k", pages.ago(F.col("at"), F.lit("2024-06-01").cast("timestamp")).alias("ago")).orderBy("k").collect()]
    assert got == ["2 days ago", "yesterday", "in 3 days", "just now", "1 hour ago", "just now"]  # halves go up, as -2.5 to -2
    said = [k / 1_000 for k in range(0, 1_001)]
    rows = spark.createDataFrame([(x,) for x in said], "x double").select("x", reads.two_digits(F.col("x")).alias("s")).collect()
    exact = lambda x: str(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP))
    assert {r.x: r.s for r in rows} == {x: exact(x) for x in said}


def test_quotes_against_a_plain_walk():
    import random
    import re
    import time
    import unicodedata

    def plain(quote, words):
        def folded(t):
            out, places = [], []
            for i, c in enumerate(t):
                if re.match(text.INVISIBLE, c):
                    continue
                for x in unicodedata.normalize("NFKC", c).translate(text._PLAIN).lower():
                    if x.isspace():
                        if out and out[-1] == " ":
                            continue
                        x = " "
                    out.append(x)
                    places.append(i)
            return "".join(out), places

        wanted, (whole, places) = folded(quote)[0].strip(), folded(words)
        at = whole.find(wanted)
        return None if len(wanted) < 2 or at < 0 else (places[at], places[at + len(wanted) - 1] + 1)

    draw = random.Random(3)
    for _ in range(3_000):
        words = "".join(draw.choices("aAbB \t\n ​´`’'–-ﬁΣİ½\x1f", k=draw.randint(0, 30)))
        at = draw.randint(0, 20)
        quote = words[at : at + draw.randint(0, 12)].swapcase()
        assert text._locate(quote, words) == plain(quote, words), (quote, words)
    long, start = "Some words – of prose\n" * 100_000, time.process_time()
    assert text._locate("no such quote", long) is None
    assert time.process_time() - start < 1  # the walk takes several


def test_facts_are_worked_out_once(spark):
    from ledgerframe.sources import hits

    rows = spark.createDataFrame([("https://a.example/ann", "Ann Lee (@ann)", "Cooks soups in Oslo all year · 3K followers")], "url string, title string, description string")
    out = hits.profile_items(rows, {"who": "name", "about": "bio"})
    assert out.first().about.value == "Cooks soups in Oslo all year" and out.first().who.locator == "0-7"
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 2


def test_single_lines_of_ascii_stay_in_spark(spark):
    rows = spark.createDataFrame([("plain  a",), ("ﬁne b",), (None,), ("",)], "x string")
    assert [r.y for r in rows.select(text.single_line(F.col("x")).alias("y")).collect()] == ["plain a", "fine b", None, ""]
    sent = rows.select(F.when(F.col("x").rlike(r"[^\x00-\x7F]"), F.col("x")).alias("s"), text.nfkc(F.col("x")).alias("y"))
    assert [r.s is None for r in sent.collect()] == [True, False, True, True]
    assert "CASE WHEN RLIKE" in sent._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")[1]
