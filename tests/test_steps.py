"""Items of searches and forums, steps, decisions, stores and contracts on small cases."""

import pytest
from pyspark.sql import functions as F

from ledgerframe.functions import evidence, pages
from ledgerframe.operators import decisions, discovery, reads, store
from ledgerframe.operators.criteria import Contract, Criterion
from ledgerframe.operators.scale import placed
from ledgerframe.plans import contracts, steps
from ledgerframe.sources import forum, hits


def test_profile_hits(spark):
    rows = spark.createDataFrame(
        [("https://x.com/ann", "Ann Lee (@annlee) - X", "24.5K followers · Writes about data and ships tools · 12 posts"), ("https://x.com/b", "B", None), ("no link", None, "")], "url string, title string, description string"
    )
    facts = hits.hit_facts(F.col("title"), F.col("description"), F.col("url"))
    got = [tuple(r) for r in rows.select(*[facts[f].value for f in ("name", "handle", "followers", "bio")]).collect()]
    assert got == [("Ann Lee", "@annlee", "24500", "Writes about data and ships tools"), (None, None, None, None), (None, None, None, None)]
    items = hits.profile_items(rows, {"who": "name", "crowd": "followers"}).collect()
    assert (items[0].who.method, items[0].who.locator, items[0].who.verified, items[1].who, items[2].external_id) == ("SEARCH", "0-7", True, None, "no link")
    assert [hits.fact_for(*x) for x in (("Name",), ("x", "their handle"), ("a", "", "title"), ("size",), ("follower_count",))] == ["name", "handle", "name", None, "followers"]


def test_document_hits(spark):
    rows = spark.createDataFrame(
        [("https://a.b/x/My_File.pdf", "", "", None), ("https://a.b/r", "[PDF] Guide", "About 12 pages", "2024-01-02T00:00"), ("https://a.b/page", "T", "d", None), ("https://a.b/err", "E", "d", None)], "url string, title string, description string, published string"
    )
    head = spark.createDataFrame(
        [("https://a.b/x/My_File.pdf", 200, "application/pdf", 7, "Mon, 01 Jan 2024 00:00:00 GMT", "Real-name.pdf", "https://a.b/x/My_File.pdf"), ("https://a.b/page", 200, "text/html", None, None, None, "https://a.b/page"), ("https://a.b/err", 404, "text/html", None, None, None, "https://a.b/err")],
        "url string, status int, content_type string, content_length long, last_modified string, disposition_name string, final_url string",
    )
    got = {r.url: r for r in hits.document_items(rows, head).collect()}
    assert set(got) == {"https://a.b/x/My_File.pdf", "https://a.b/r", "https://a.b/err"}
    one, two = got["https://a.b/x/My_File.pdf"], got["https://a.b/r"]
    assert (one.title.value, one.title.method, one.file_type.method, one.size_bytes.value) == ("Real name", "DOC_META", "DOC_META", "7")
    assert (two.title.value, two.title.method, two.pages.value, two.published.value, two.size_bytes) == ("Guide", "SEARCH", "12", "2024-01-02", None)
    alone = {r.url: r for r in hits.document_items(rows).collect()}
    assert (alone["https://a.b/x/My_File.pdf"].title.value, alone["https://a.b/x/My_File.pdf"].title.method) == ("My File", "DERIVED")


def test_forum_items_quote_their_text(spark):
    text = "Acme (YC) | Data Engineer | Remote (EU) | $120k-$150k<p>We build &amp; ship"
    rows = spark.createDataFrame([(7, 0, "ann", "2024-01-01", text), (8, 1, "bob", "2024-01-02", "no header"), (9, 2, None, None, None), (10, 3, "c", "d", " ")], "id long, ord int, author string, created_at string, text string")
    got = {r.external_id: r for r in forum.items(rows).collect()}
    assert set(got) == {"7", "8"} and got["8"].parsed is False and got["8"].company is None
    a = got["7"]
    assert (a.company.value, a.title.value, a.remote.value, a.salary.value, a.url.value) == ("Acme", "Data Engineer", "remote", "USD 120,000–150,000 / year", "https://news.ycombinator.com/item?id=7")
    for value in (a.company, a.title, a.location, a.salary):
        start, stop = map(int, value.locator.split("-"))
        assert a.plain[start:stop] == value.snippet and value.verified
    threads = spark.createDataFrame([(0, 1, "Freelancer?"), (1, 2, "Ask HN: Who is hiring? (May)"), (2, 3, "who is hiring")], "ord int, id long, title string")
    assert forum.latest_thread(threads).first().id == 2


def test_steps_fill_only_what_is_missing(spark):
    page = '<script type="application/ld+json">{"@type": "JobPosting", "title": "From page", "hiringOrganization": {"name": "Acme"}}</script><p>pays $99k a year'
    rows = spark.createDataFrame(
        [(1, "s", 1, "https://a/1", "Given", None, None, "pays $50k a year"), (2, "s", 2, "https://a/2", None, None, None, ""), (3, "s", 3, "https://a/3", None, None, None, ""), (4, "t", 1, None, None, None, None, None)],
        "id long, source string, ord int, url string, title string, company string, salary string, text string",
    )
    web = spark.createDataFrame([(f"https://a/{i}", page) for i in (1, 2, 3)], "url string, html string")
    got = {r.id: r for r in steps.enrich(rows, ["title", "company", "salary"], web, 2).collect()}
    assert (got[1].title, got[1].company, got[1].salary) == ("Given", "Acme", "USD 50,000 / year") and got[1].filled == {"salary": "REGEX", "company": "JSON_LD"}
    assert (got[2].title, got[2].salary) == ("From page", "USD 99,000 / year") and (got[3].title, got[4].title) == (None, None)
    asked = {r.id: r.may_ask for r in steps.extract_text(rows.withColumn("text", F.lit("x")), ["title"], ["title"], 1).collect()}
    assert asked == {1: False, 2: True, 3: False, 4: True}


def test_quotes_support_values(spark):
    rows = spark.createDataFrame([("1,200 units", "about 1200 Units sold", "text"), ("Berlin", "Bern", "text"), ("250,000 USD", "$250k", "pay"), ("fully remote", "Remote (EU)", "arrangement"), ("onsite", "remote", "arrangement")], "v string, q string, k string")
    for r in rows.collect():
        got = rows.filter((F.col("v") == r.v) & (F.col("q") == r.q)).select(evidence.quote_supports(F.col("v"), F.col("q"), r.k)).first()[0]
        assert got == (r.v not in ("Berlin", "onsite")), r
    none = evidence.compact({"a": evidence.from_api(F.lit("x"), F.lit("$.a"), F.lit("u")), "b": evidence.from_api(F.lit(" "), F.lit("$.b"), F.lit("u"))})
    assert set(spark.range(1).select(none.alias("m")).first().m) == {"a"}


def test_addresses_and_walls(spark):
    cases = {"10.1.2.3": True, "8.8.8.8": False, "::1": True, "::ffff:127.0.0.1": True, "::ffff:8.8.8.8": False, "64:ff9b::a00:1": True, "64:ff9b::808:808": False, "2002:a00:1::": True, "2002:808:808::": False, "fe80::1%eth0": True, "2606:4700::1111": False, "nonsense": True, "100.64.0.1": True, "2001:0:1::": True}
    rows = spark.createDataFrame([(k,) for k in cases], "a string")
    assert {r.a: r.x for r in rows.select("a", pages.is_internal(F.col("a")).alias("x")).collect()} == cases
    body = spark.createDataFrame([(200, "x hcaptcha.com/1/api.js"), (403, "x hcaptcha.com/1/api.js"), (200, 'content="auth_wall_x')], "s int, b string")
    assert [r[0] for r in body.select(pages.is_challenge(F.col("s"), F.lit(None).cast("string"), F.col("b"))).collect()] == [False, True, True]
    text = spark.createDataFrame([("exam-\nple Well-\nKnown ﬁne​",)], "t string").select(pages.document_text(F.col("t"))).first()[0]
    assert text == "example Well-\nKnown fine"


def test_companies(spark):
    rows = spark.createDataFrame([("Scale AI",), ("OpenAI Inc",)], "n string")
    assert [r[0] for r in rows.select(discovery.name_slugs(F.col("n"))).collect()] == [["scaleai", "scale-ai", "scale"], ["openaiinc", "openai-inc", "openai"]]
    titles = spark.createDataFrame([("montecarlodata", 0, "Backend Engineer @ Monte Carlo - Jobs"), ("weekday-1", 0, "Cook - Jobs"), ("acme", 0, "Cook at Acme..."), ("acme", 1, "Chef | Ac")], "slug string, ord int, title string")
    assert dict(discovery.company_names(titles).collect()) == {"montecarlodata": "Monte Carlo", "weekday-1": "Weekday", "acme": "Acme"}
    assert discovery.role_words("Backend Developer Jobs", ["developer", "backend developer"], True, "Oslo") == "backend developer remote Oslo"
    assert discovery.request_queries([" a ", "a", "b"], "d") == ["a", "b"] and discovery.request_queries([], " d ") == ["d"]
    state = lambda s, k: (spark.range(3 - k), s + 1)
    found, n = discovery.rounds(state, 0)
    assert (len(found), n) == (3, 4)


def test_similar_texts_equal_all_pairs(spark):
    from ledgerframe.functions.text import trigrams

    names = ["red widget", "red widgets", "blue gear", "gear blue", "red gear", "a", "b", "", "widget"]
    side = spark.createDataFrame([(n,) for n in names], "text string").withColumn("grams", trigrams(F.col("text")))
    sets = {r.text: set(r.grams) for r in side.collect()}
    want = {(a, b) for a in names for b in names if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert {(r.text, r.other) for r in discovery.similar_texts(side, side, 0.5).collect()} == want


def test_store(spark):
    rows = spark.createDataFrame([("a", 1, "x", None, "API", True), ("a", 2, "y", " ", "API", True), ("b", 1, None, "z", "LLM", False)], "key string, ord int, title string, url string, method string, verified boolean")
    kept = store.stored(rows, "r")
    assert {(r.key, r.title, r.run) for r in kept.collect()} == {("a", "y", "r"), ("b", None, "r")}
    values = store.evidence_rows(kept, ["title", "url"], ["run", "key"])
    assert {(r.key, r.field, r.value, r.confidence) for r in values.collect()} == {("a", "title", "y", 0.99), ("b", "url", "z", 0.0)}
    proof = spark.createDataFrame([("k", "v", [("title", "DOM", True, "$.x")])], "key string, title string, evidence array<struct<field:string,method:string,verified:boolean,quote:string>>")
    got = store.evidence_rows(proof, ["title"], ["key"]).first()
    assert (got.method, got.quote, got.page_id, got.confidence) == ("DOM", "$.x", None, 0.88)
    copies = spark.createDataFrame([("u", "http", "h1", "f", "b", 1), ("u", "http", "h2", "f", "b", 2)], "url string, via string, hash string, final_url string, body string, at int")
    new = spark.createDataFrame([("u", "http", "h2", "f", "b\0", 5), ("v", "http", "h", "f", 'x\\u0000y', 5)], copies.schema)
    assert {(r.url, r.hash, r.body, r.at) for r in store.page_copies(copies, new).collect()} == {("u", "h1", "b", 1), ("u", "h2", "b", 5), ("v", "h", "xy", 5)}
    assert store.page_copies(copies.limit(0), new.limit(0)).count() == 0


def test_numbers_in_the_order_of_all_rows(spark):
    rows = spark.range(500).select(((F.col("id") * 7919) % 500).alias("x"))
    assert all(r.x == r.n for r in placed(rows, [F.col("x")], "n").collect())
    assert placed(rows.limit(0), [F.col("x")], "n").count() == 0


def test_read_path(spark):
    rows = spark.createDataFrame([(1, "valid", "s", 0.9, None, "A_b", 0.5, 1), (2, "valid", "s", 0.8, None, "axb", 0.5, 2), (3, "invalid", "s", 0.9, None, "a_b", 0.5, 3), (4, "valid", "s", 0.9, 1, "a_b", 0.5, 4)], "id long, status string, source string, confidence double, duplicate_of long, name string, match_score double, created_at int")
    assert [r.id for r in reads.filtered(rows, reads.Filters(text="a_B"), ["name"]).orderBy("id").collect()] == [1, 3]
    page = reads.page_of(reads.filtered(rows, reads.Filters(duplicates=True), ["name"]), 1, 2).collect()
    assert [(r.id, r.total) for r in page] == [(4, 4), (2, 4)]


def test_decisions(spark):
    a, b = (spark.range(1).select(decisions.input_hash({k: F.lit(v) for k, v in x}).alias("h")).first().h for x in ([("task", "t"), ("state", "s")], [("state", "s"), ("task", "t")]))
    assert a == b
    odds = spark.createDataFrame([({"a": 0.9, "b": 0.1},), ({"a": 0.5, "z": 0.9},), (None,)], "p map<string,double>")
    assert [r[0] for r in odds.select(decisions.choice(F.col("p"), ["a", "b"])).collect()] == ["a", None, None]
    failures = spark.createDataFrame([("EMPTY_RENDER", 1, "http"), ("EMPTY_RENDER", 1, "browser"), ("SELECTOR_MISS", 1, "http"), ("SELECTOR_MISS", 3, "http"), ("RATE_LIMITED", 2, "http")], "f string, n int, v string")
    assert [r[0] for r in failures.select(decisions.repair(F.col("f"), F.col("n"), F.col("v"))).collect()] == ["SWITCH_TO_BROWSER", "ESCALATE", None, "STOP", "STOP"]


def test_contracts(spark):
    base = Contract(("title", "url", "pages"), ("title", "pages"))
    jobs, notes = contracts.job_defaults(base, "jobs at the best AI startups")
    assert jobs.keys == contracts.JOB_KEYS and jobs.criteria[0].kind == "tag" and notes
    tagged = Contract(("title",), criteria=(Criterion("t", "t", "tag", ("tags",), ("x",)),))
    assert contracts.job_defaults(tagged, "good companies")[0].criteria == tagged.criteria and contracts.job_defaults(base, "jobs in Oslo")[0].criteria == ()
    documents, queries, notes = contracts.document_defaults(base, "annual reports", [], [])
    assert (documents.required, documents.keys, queries, len(notes)) == (("title",), (("url",),), ["annual reports"], 2)
    assert contracts.web_links(["a.com/x", "https://a.com/x", " ftp://b", "http://c", "http://c", ""]) == (["https://a.com/x", "http://c"], ["ftp://b", ""])
    assert contracts.budget("quick", {"pages": 10})["pages"] == 10 and contracts.budget("quick", {})["calls"] == 15
    one, two = (Contract(f, criteria=(Criterion("c", "L", "keyword_any", f, v),)) for f, v in ((("a", "b"), ("Y", "x")), (("b", "a"), ("x", "y"))))
    assert contracts.summary(one, "jobs", "d") == contracts.summary(two, "jobs", "d")
    line = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (9, None)], "id long, parent long")
    assert {(r.id, r.root, r.depth) for r in contracts.lineage(line).collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3), (5, 1, 4), (9, 9, 0)}


@pytest.mark.parametrize(("seconds", "want"), [(-30, "just now"), (-60, "1 minute ago"), (-7_200, "2 hours ago"), (-86_400, "yesterday"), (-200_000, "2 days ago"), (3_700, "in 1 hour"), (90_000, "tomorrow")])
def test_how_long_ago(spark, seconds, want):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    assert spark.range(1).select(pages.ago(F.timestamp_seconds(F.unix_timestamp(now) + seconds), now)).first()[0] == want
