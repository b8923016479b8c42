import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerframe.functions import schema_org
from ledgerframe.functions.header import header
from ledgerframe.operators import discovery
from ledgerframe.sources import files, serp, workbook as books


def workbook(extra=(), state="visible"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" state="{state}"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>Ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>age</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row><row hidden="1"><c r="A3"><v>9</v></c></row></sheetData></worksheet>')
        for name in extra:
            z.writestr(name, "x")
    return out.getvalue()


@pytest.mark.parametrize(
    ("data", "kind", "verdict", "flags"),
    [
        (b"a,b\nx,1\n", "csv", "clean", []),
        ("﻿n\tö\nx\t1".encode("utf-16"), "csv", "clean", []),
        (b"a\0b", "other", "rejected", ["binary"]),
        (b'{"a": [1', "json", "rejected", ["damaged"]),
        (b'{"a": 1}\n{"a": 2}', "json", "clean", []),
        (b"[" * 100 + b"]" * 100, "json", "rejected", ["too_deep"]),
        (b"%PDF-1.4 /Java#53cript %%EOF", "pdf", "risky", ["javascript"]),
        (b"%PDF-1.4 /Encrypt %%EOF", "pdf", "rejected", ["encrypted"]),
        (b"%PDF-1.4 cut", "pdf", "rejected", ["damaged"]),
        (workbook(), "xlsx", "clean", []),
        (workbook(["xl/vbaProject.bin"]), "xlsx", "risky", ["macro"]),
        (workbook(["../x"]), "xlsx", "rejected", ["unsafe_path"]),
        (b"PK\x03\x04 xl/ broken", "xlsx", "rejected", ["damaged"]),
        (b"<!DOCTYPE html><p>", "html", "clean", []),
        (b"", "csv", "clean", []),
    ],
)
def test_scan(data, kind, verdict, flags):
    assert files.scan("p", data)[1:4] == (kind, verdict, flags)


def test_tables(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "b.csv").write_bytes(b"name;age\nAnn;7\n")
    (tmp_path / "c.json").write_bytes(b'{"n": 1, "jobs": [{"name": "Ann", "age": 7}]}')
    got = files.rows(files.read(spark, f"file://{tmp_path}")).collect()
    assert len(got) == 3 and all({c.header: c.value for c in r.cells} == {"name": "Ann", "age": "7"} for r in got)
    assert files.scan("p", workbook(state="hidden"))[4] == []


def test_tables_are_read_whole(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes(b"name,age\n" + b"Ann,7\n" * 6_001)
    (tmp_path / "c.json").write_text(json.dumps([{"name": "Ann", "age": 7}] * 6_001))
    assert files.rows(files.read(spark, f"file://{tmp_path}")).count() == 12_002
    cut = files.scan("b.csv", (tmp_path / "b.csv").read_bytes(), most=10)
    assert cut[2] == "clean" and cut[3] == ["truncated"] and len(cut[4][0]["rows"]) == 10
    assert files.scan("b.csv", (tmp_path / "b.csv").read_bytes())[3] == []


def test_tables_leave_in_pieces(spark, tmp_path):
    n = 2 * files.PIECE + 1
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "b.csv").write_bytes(b"name,age\n" + b"\n".join(b"Ann,%d" % k for k in range(n)))
    (tmp_path / "c.json").write_text("\n".join(json.dumps({"name": "Ann", "age": k} | ({"last": 1} if k == n - 1 else {})) for k in range(n)))
    (tmp_path / "d.csv").write_bytes(b"name,age\n" * files.PIECE + b'"' + b"x" * 200_000)  # no reader gets to its end
    for name in ("b.csv", "c.json"):
        assert [len(p["rows"][0]) for p in files.pieces(name, (tmp_path / name).read_bytes())] == [files.PIECE, files.PIECE, 1]
    path = f"file://{tmp_path}"
    got, whole = ({(r.path, r.table, r.row, tuple(map(tuple, r.cells))) for r in d.collect()} for d in (files.table_rows(spark, path), files.rows(files.read(spark, path))))
    assert got == whole and len(got) == 2 * n + 1
    # A row of a table goes on without the rest of it.
    plan = files.rows(files.read(spark, path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode(rows" in plan


HEADERS = [
    ("Acme (YC) | Senior Engineer | Berlin, Germany | REMOTE | $120k-$150k | Full-time | https://acme.com", ("Acme", "Senior Engineer", "Berlin, Germany", "remote", "USD 120,000–150,000 / year", "Full-time", "https://acme.com")),
    ("**Acme** | *Engineer* | Designer | Remote (Europe) | Contract", ("Acme", "Engineer; Designer", "Remote (Europe)", "remote", None, "Contract", None)),
    ("Acme | Hybrid or remote | Paris | Onsite", ("Acme", None, "Paris", "onsite", None, None, None)),
    ("Acme | $100k | $200k | SRE | Rome", ("Acme", "SRE", "$200k", None, "USD 100,000 / year", None, None)),
    ("Acme | https://a.com | see https://b.com engineers | NYC", ("Acme", "see https://b.com engineers", "NYC", None, None, None, "https://a.com")),
    ("A | https://a.com | 5", ("A", None, "5", None, None, None, "https://a.com")),
    ("Acme | Full-time | Part-time", None),
    ("two | parts", None),
    ("(YC) | Engineer | Berlin", None),
    (None, None),
]


def test_header(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HEADERS)], "i int, t string").select("i", header(F.col("t")).alias("h"))
    got = {r.i: r.h for r in rows.collect()}
    for i, (t, want) in enumerate(HEADERS):
        assert (tuple(got[i])[:7] if got[i] else None) == want, t
    assert got[1].words.role == "Engineer" and got[0].words.company == "Acme (YC)" and got[0].words.pay == "$120k-$150k"


def test_sources_by_name_tag_or_all(spark):
    registry = spark.createDataFrame([("Acme", "acme", ["ai"]), ("Bolt", "bolt", ["bank"]), ("Core", "core", [])], "name string, slug string, tags array<string>")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    pick = lambda *a: sorted(r.slug for r in discovery.select_sources(registry, *a).collect())
    assert pick(names("ACME!"), ["bank"], names()) == ["acme"]
    assert pick(names("none"), ["bank"], names()) == ["bolt"]
    assert pick(names("none"), ["other"], names("core")) == []  # tags that no company has select none


def test_boards_and_queries(spark):
    hits = spark.createDataFrame([(0, 0, "https://jobs.lever.co/a/1"), (0, 1, "https://jobs.lever.co/b/1"), (1, 0, "https://jobs.lever.co/a/2"), (1, 1, "junk")], "query_ord int, hit_ord int, url string")
    seen = spark.createDataFrame([("lever", "b")], "kind string, slug string")
    assert [tuple(r) for r in discovery.boards_from_hits(hits, seen, 5).collect()] == [("lever", "a", 2)]
    wanted = spark.createDataFrame([(1, "B"), (0, " a "), (2, "b"), (3, "")], "ord int, query string")
    tried = spark.createDataFrame([("A",)], "query string")
    assert [r.query for r in discovery.fresh_queries(wanted, tried).collect()] == ["B"]
    assert discovery.merge_hits(hits).filter(F.col("canonical").isNull()).count() == 0


def test_schema_org(spark):
    posting = '{"@type": ["JobPosting"], "title": " T ", "hiringOrganization": {"name": "C"}, "jobLocationType": "TELECOMMUTE", "jobLocation": [{"address": {"addressLocality": "Oslo", "addressCountry": "NO"}}], "employmentType": ["FULL_TIME"], "baseSalary": {"currency": "NOK", "value": {"minValue": 5}}}'
    rows = spark.createDataFrame([([posting, '{"@type": "ItemList", "itemListElement": [{"a": 1}, {"a": 2}]}', "broken"],), ([],)], "objects array<string>")
    thing = F.get(schema_org.of_type(F.col("objects"), "JobPosting"), F.lit(0))
    got = rows.select(*[c.alias(n) for n, c in schema_org.job_posting(thing).items()]).collect()
    assert tuple(got[0])[:5] == ("T", "C", "Oslo, NO", "remote", "FULL_TIME") and (got[0].salary_low, got[0].salary_high, got[0].currency) == (5.0, 5.0, "NOK")
    assert set(got[1]) == {None}
    assert [len(r.x) for r in rows.select(schema_org.item_list(F.col("objects")).alias("x")).collect()] == [2, 0]
    steps = [("JSON_LD", {"a": F.lit(None).cast("string")}), ("REGEX", {"a": F.lit("x"), "b": F.lit(1)})]
    row = rows.select(*[c.alias(n) for n, c in schema_org.ladder(steps, ["a", "b", "c"]).items()]).first()
    assert tuple(row.a) == ("x", "REGEX") and row.b.value == "1" and row.c is None


def test_workbook_reads_back(spark, tmp_path):
    data = spark.createDataFrame([(1, "=cmd()"), (2, None), (3, "a<b & c")], "id int, text string").coalesce(1)
    books.write(f"{tmp_path}/x.xlsx", {"Data": data, "About": data.limit(0)})
    kind, verdict, flags, tables = files.scan("x", (tmp_path / "x.xlsx").read_bytes())[1:]
    assert (kind, verdict, flags) == ("xlsx", "clean", []) and [t["name"] for t in tables] == ["Data", "About"]
    assert tables[0]["headers"] == ["id", "text"]


def test_result_pages(spark):
    duck = '<div id="links"><div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.b%2Fx%3Fy%3D1&rut=z">One <b>hit</b></a><a class="result__snippet">the  words</a></div><div class="result result--ad"><a class="result__a" href="https://ad.x/">Ad</a></div><div class="result"><a class="result__a" href="/local">Local</a></div></div>'
    bing = '<ol id="b_results"><li class="b_algo"><h2><a href="https://www.bing.com/ck/a?x=1&u=a1aHR0cHM6Ly9jLmQvZQ&n=1">Two</a></h2><div class="b_caption"><p>more</p></div></li><li class="b_algo"><h2><a href="https://a.b/x?y=1">Again</a></h2></li></ol>'
    brave = '<div class="snippet" data-type="web"><a href="https://e.f/"><span class="title">Three</span></a><div class="generic-snippet"><div class="content">text</div></div></div><div class="snippet" data-type="news"><a href="https://n.n/">N</a></div>'
    one = lambda page: spark.createDataFrame([(0, page), (1, None)], "query_ord int, html string")
    assert [tuple(r)[2:] for r in serp.hits(one(duck), "duckduckgo").collect()] == [("https://a.b/x?y=1", "One hit", "the words")]
    assert [(r.url, r.title) for r in serp.hits(one(bing), "bing").collect()] == [("https://c.d/e", "Two"), ("https://a.b/x?y=1", "Again")]
    assert [tuple(r)[2:] for r in serp.hits(one(brave), "brave").collect()] == [("https://e.f/", "Three", "text")]
    every = serp.merged({"brave": one(brave), "duckduckgo": one(duck), "bing": one(bing)}, 10).orderBy("query_ord", "hit_ord").collect()
    assert [r.url for r in every] == ["https://a.b/x?y=1", "https://c.d/e", "https://e.f/"]


def test_lists_run_along_their_next_pages(spark):
    from ledgerframe.sources import pages

    item = lambda i: f'<li class="job"><a href="/{i}">Job {i}</a><i>from ${90 + i}k to ${100 + i}k</i></li>'
    web = {
        "https://a.b/list": "<h1>Acme</h1>" + item(1) + item(2) + '<a rel="next" href="/list?page=2">next</a>', "https://a.b/list?page=2": "<h1>Acme</h1>" + item(2) + item(3) + '<a rel="next" href="/list?page=3">next</a>',
        "https://a.b/list?page=3": item(4) + '<a rel="next" href="/list">next</a>', "https://c.d/": item(9) + '<a rel="next" href="/gone">next</a>',
    }
    table = spark.createDataFrame([*web.items(), ("nolink", None)], "url string, html string")
    starts = spark.createDataFrame([("http://www.a.b/list",), ("https://c.d",), ("https://no.where",)], "start string")
    chain = pages.page_chain(table, starts, 5)
    assert {(r.start, r.place, r.url) for r in chain.collect()} == {("https://a.b/list", 0, "https://a.b/list"), ("https://a.b/list", 1, "https://a.b/list?page=2"), ("https://a.b/list", 2, "https://a.b/list?page=3"), ("https://c.d", 0, "https://c.d/")}
    assert pages.page_chain(table, starts, 2).count() == 3 and pages.page_chain(table, starts.limit(0), 2).count() == 0
    got = pages.list_items(chain, ("li.job", {"title": ("a", None), "link": ("a", "href"), "salary": ("i", None)}), {"salary": "pay"}, "company").orderBy("start", "ord").collect()
    assert [(r.title.value, r.salary.value) for r in got] == [(f"Job {i}", f"USD {90 + i},000–{100 + i},000 / year") for i in (1, 2, 3, 4, 9)]
    assert got[0].salary.snippet == "from $91k to $101k" and got[0].company.value == "Acme" and got[3].company is None and got[0].link.value == "https://a.b/1"


def test_records_read_from_their_own_data(spark):
    from ledgerframe.sources import pages

    several = '<script type="application/ld+json">{"@type": "ItemList", "itemListElement": [{"name": "A", "url": "https://a.b/1"}, {"name": "B"}]}</script><link rel="canonical" href="/own">'
    one = '<script type="application/ld+json">{"@type": "Product", "name": "C", "numberOfEmployees": 7}</script>'
    table = spark.createDataFrame([("https://a.b/x", several), ("https://a.b/y", one), ("https://a.b/z", "<p>none")], "url string, html string")
    got = {(r.page, r.n): (r.url, r.name, r.company_size) for r in pages.record_items(table, ["name", "url", "company_size"], {"size": ("numberOfEmployees",)}).collect()}
    assert got == {("https://a.b/x", 0): ("https://a.b/1", "A", None), ("https://a.b/x", 1): ("https://a.b/own", "B", None), ("https://a.b/y", 0): ("https://a.b/y", "C", "7"), ("https://a.b/z", 0): ("https://a.b/z", None, None)}


def test_a_boards_texts_go_to_python_once(spark):
    from ledgerframe.functions import parsers
    from ledgerframe.sources import boards

    coded = "&lt;p&gt;Pays &lt;b&gt;well&lt;/b&gt; &amp;amp; more&lt;/p&gt;&lt;p&gt;Oslo&lt;/p&gt;"
    jobs = [(k, f"T{k}", None, None, {"name": "OSLO ;  New   York| oslo ;; Bergen|new york"} if k < 4 else None, None, None, "2024-01-02", coded if k % 2 else None) for k in range(6)]
    board = spark.createDataFrame([(jobs,)], boards.GREENHOUSE)
    rows = boards.greenhouse_rows(board, "Acme")
    assert rows._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1
    got = {r.external_id: (r.location, r.description) for r in rows.collect()}
    assert got == {str(k): ("OSLO; New York; Bergen" if k < 4 else None, "Pays well & more\nOslo" if k % 2 else None) for k in range(6)}
    places = spark.createDataFrame([(1, ["a", None, " A ", "", "b  c", "B C", "É", "é"]), (2, []), (3, None)], "k int, p array<string>")
    assert [r.j for r in places.orderBy("k").select(parsers.join_locations(F.col("p")).alias("j")).collect()] == ["a; b c; É", "", None]
