import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerframe.operators import criteria, reports, resolve, scale, state
from ledgerframe.operators.components import connected_components
from ledgerframe.operators.scale import join_groups, numbered
from ledgerframe.plans import compiler
from ledgerframe.sources import boards, export
from ledgerframe.streaming import events as streams


def test_components_ignore_nulls_loops_and_order(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 5), (None, 4), (9, 8), (8, 7)], "a long, b long")
    assert dict(connected_components(edges).collect()) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    assert connected_components(edges.limit(0)).count() == 0


def test_numbering_has_no_gaps(spark):
    rows = spark.range(500).withColumn("k", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    out = numbered(rows, ["k"], [F.col("id")], [F.col("id")], "n", 500).toPandas()
    for _, g in out.groupby("k", dropna=False):
        assert sorted(g.n) == list(range(len(g)))


@pytest.mark.parametrize("settings", [{}, {"HOT_KEYS": 20, "LEAST_HOT": 5}, {"HOT_KEYS": 3, "LEAST_HOT": 1}])
@pytest.mark.parametrize("kind", ["long", "string", "binary"])
def test_hot_keys_join_once(spark, monkeypatch, settings, kind):
    for k, v in settings.items():
        monkeypatch.setattr(scale, k, v)
    key = F.when(F.col("id") < 3_000, 0).when(F.col("id") < 4_000, 1).when(F.col("id") < 4_050, F.lit(None)).otherwise(F.col("id")).cast("string").cast(kind)
    rows = spark.range(5_000).select("id", key.alias("k"))
    groups = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    got = join_groups(rows, groups, "k", "n")
    assert got.columns == ["k", "id", "n"] and got.count() == 4_950 and got.select("id").distinct().count() == 4_950
    assert got.filter("id < 3000 and n <> 3000").count() == 0


def test_three_valued_criteria(spark):
    c = criteria.Criterion
    rows = spark.createDataFrame([(1, None, []), (2, "Infrastructure capital", ["a"])], "id int, t string, tags array<string>")
    tests = [c("a", "a", "keyword_any", ("t",), ("infra",)), c("b", "b", "keyword_none", ("t",), ("api",)), c("c", "c", "equals", ("t",), ("x",)), c("d", "d", "tag", ("tags",), ("a",)), c("e", "e", "keyword_any", ("t",), ())]
    got = {r.id: [s.passed for s in r.signals] for r in criteria.match(rows, tuple(tests)).collect()}
    assert got == {1: [False, True, None, None, None], 2: [True, True, False, True, None]}
    assert not criteria.safe_pattern("(a+)+") and criteria.safe_pattern("ab+c") and not criteria.safe_pattern("(")


def test_patterns_read_whole_texts(spark):
    rows = spark.createDataFrame([("x" * 5_000 + " end",)], "t string")
    rule = (criteria.Criterion("a", "a", "regex", ("t",), ("end$",)),)
    assert criteria.match(rows, rule).first().signals[0].passed is True
    assert criteria.match(rows, rule, pattern_chars=2_000).first().signals[0].passed is False


def test_a_hub_of_many_edges(spark, monkeypatch):
    monkeypatch.setattr(scale, "LEAST_HOT", 20)
    monkeypatch.setattr(scale, "HOT_KEYS", 10)
    edges = spark.range(1, 400).selectExpr("0 AS a", "id AS b").union(spark.range(400, 420).selectExpr("id AS a", "id + 1 AS b"))
    found = connected_components(edges).toPandas()
    assert (found[found.node < 400].component == 0).all() and (found[found.node >= 400].component == 400).all() and len(found) == 421
    rows = spark.range(300).selectExpr("id", "IF(id < 200, 'popular', CAST(id AS STRING)) AS k")
    cluster = dict(resolve.clusters(rows, [F.col("k")]).collect())
    assert all(cluster[i] == (0 if i < 200 else i) for i in range(300))
    assert sorted(r.id for r in resolve.first_wins(rows, F.col("k"), ["id"]).collect()) == [0, *range(200, 300)]


def test_clusters_and_keepers(spark):
    rows = spark.createDataFrame([(1, "u1", "f1", 1, 0.5, 2, 5), (2, "u2", "f1", 0, 0.4, 2, 6), (3, "u2", "f2", 0, 0.4, 3, 7), (4, None, None, 0, 0.9, 1, 1), (5, "", "", 0, 0.9, 1, 1)], "id long, u string, f string, method_rank int, confidence double, completeness int, created_at int")
    found = resolve.clusters(rows, [resolve.record_key(("u",)), resolve.record_key(("f",))])
    assert dict(found.collect()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    kept = {r.id: r.duplicate_of for r in resolve.keepers(rows.join(found, "id")).collect()}
    assert kept == {1: 3, 2: 3, 3: None, 4: None, 5: None}


def test_reports_on_empty_tables(spark):
    rows = spark.createDataFrame([], "id long, status string, confidence double, duplicate_of long, name string, source string, ord int, reasons array<string>")
    assert tuple(reports.quality_totals(rows).first()) == (0, 0, 0, 0, 0)
    assert [r.rate for r in reports.completeness(rows, ["name"]).collect()] == [0.0]
    assert [r.n for r in reports.histogram(rows).collect()] == [0, 0, 0, 0]
    assert reports.reject_reasons(rows).count() == 0


def test_previous_run_and_is_new(spark):
    runs = spark.createDataFrame([(1, "q", 1, True), (2, "q", 2, False), (3, "q", 3, True)], "id long, q string, at int, done boolean")
    assert {r.id: r.previous for r in state.previous_run(runs, "q", ["at"], F.col("done")).collect()} == {1: None, 2: 1, 3: 1}
    new = spark.createDataFrame([("a", True), ("c", True), ("d", False)], "k string, kept boolean")
    old = spark.createDataFrame([("a", True), ("b", True)], "k string, kept boolean")
    assert {r.k: r.is_new for r in state.is_new(new, old, "k").collect()} == {"a": False, "c": True, "d": False}


def test_plan_joins_sources_and_keeps_reasons(spark):
    a = spark.createDataFrame([(1, 1, "a", "API", True, 0, "Data Engineer", "https://x.y/1"), (2, 2, "a", "API", True, 0, "Cook", "https://x.y/2"), (3, 3, "a", "API", True, 0, "Data Scientist", "nolink")], "id long, ord int, source string, method string, verified boolean, created_at int, title string, url string")
    b = spark.createDataFrame([(4, 1, "b", "SEARCH", True, 1, "Data engineer", "http://www.x.y/1/?utm_a=1")], a.schema)
    contract = criteria.Contract(("title", "url"), ("title", "url"), (criteria.Criterion("data", "data work", "keyword_any", ("title",), ("data",), hard=True),), (("url",),), ("url",))
    got = {r.id: (r.status, r.duplicate_of, r.lead_tier, list(r.reasons)) for r in compiler.run(contract, [a, b]).collect()}
    assert got == {1: ("valid", None, "strong", []), 2: ("invalid", None, None, ["criterion_not_met:data"]), 3: ("invalid", None, None, ["invalid_link:url"]), 4: ("valid", 1, "strong", [])}


def test_boards(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"jobs": [{"id": 1, "title": "T", "absolute_url": "https://a/1", "company_name": "C", "location": {"name": "Berlin | Remote; berlin"}, "metadata": [{"name": "Workplace", "value": "On-Site"}], "first_published": "2024-01-01", "content": "&lt;p&gt;Hi&lt;/p&gt;"}]}))
    (tmp_path / "a.json").write_text(json.dumps({"jobs": [{"id": "x", "title": "A", "isListed": False}, {"id": "y", "title": "B", "employmentType": "FullTime", "isRemote": True, "location": "Paris", "secondaryLocations": [{"location": "Rome"}], "compensation": {"summaryComponents": [{"compensationType": "Equity"}, {"compensationType": "Salary", "currencyCode": "EUR", "minValue": 5}]}}]}))
    (tmp_path / "l.json").write_text(json.dumps([{"id": "z", "text": "L", "createdAt": 0, "workplaceType": "hybrid", "categories": {"allLocations": ["Oslo"]}}]))
    (tmp_path / "w.json").write_text(json.dumps({"name": "W", "jobs": [{"title": "M", "shortcode": "s", "telecommuting": True, "city": "", "state": None, "country": "Spain"}]}))
    g, a, l, w = (boards.read(spark, k, f"file://{tmp_path}/{k[0]}.json" if k != "workable" else f"file://{tmp_path}/w.json", "Co").first() for k in ("greenhouse", "ashby", "lever", "workable"))
    assert (g.location, g.arrangement, g.description) == ("Berlin; Remote", "onsite", "Hi")
    assert (a.title, a.location, a.employment, a.salary_high, a.arrangement) == ("B", "Paris; Rome", "Full-time", 5.0, "remote")
    assert (l.arrangement, l.posted[:10], l.location) == ("hybrid", "1970-01-01", "Oslo")
    assert (w.company, w.location, w.arrangement) == ("W", "Spain", "remote")
    assert {e.field for e in a.evidence} == {"title", "company", "location", "employment", "arrangement", "salary_low", "salary_high", "currency"}
    with pytest.raises(KeyError):
        boards.read(spark, "other", "", "")


def test_stream_equals_batch(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, at(0), 1, "error", 1.0), (2, at(1), 1, "error", 1.0), (3, at(2), 1, "view", 2.0), (4, at(4000), 2, "click", 3.0), (5, at(90000), 2, "click", 3.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/e")
    schema = spark.read.parquet(f"{tmp_path}/e").schema
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/e")
    q = streams.tumbling(stream(), "1 hour", "1 minute").writeStream.format("memory").queryName("t").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(spark.table("t").collect()) == sorted(streams.tumbling(spark.read.parquet(f"{tmp_path}/e"), "1 hour").collect())
    q = streams.breaker(stream(), limit=2).writeStream.format("memory").queryName("b").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.event_id: r.state for r in spark.table("b").collect()} == {1: "closed", 2: "open", 3: "open", 4: "closed", 5: "closed"}


def test_csv_lines(spark):
    rows = spark.createDataFrame([(1, 'a "b", c', None), (2, "=x", "y")], "id int, a string, b string")
    assert [r.line for r in rows.orderBy("id").select(export.csv_lines(rows, ["a", "b"]).alias("line")).collect()] == ['"a ""b"", c",', "'=x,y"]
