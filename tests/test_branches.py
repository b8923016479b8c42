"""Branches that fail, more rounds of branches, rounds of searching."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerframe.functions.text import located_phrases
from ledgerframe.operators import criteria, discovery
from ledgerframe.plans import branches, compiler


def fail(rows, message):
    return rows.withColumn("title", F.when(F.lit(True), F.raise_error(F.lit(message))).cast("string"))


@pytest.fixture(scope="module")
def posts(spark):
    rows = [(i, i, "s", "API", True, 0, None if i == 4 else f"Title {i}", f"https://a.b/{i}") for i in range(1, 9)]
    return spark.createDataFrame(rows, "id long, ord long, source string, method string, verified boolean, created_at int, title string, url string")


CONTRACT = criteria.Contract(fields=("title", "url"), required=("title",), keys=(("url",),), urls=("url",), criteria=(), most=5)


def test_one_broken_branch_of_three(spark, posts):
    def unbuilt():
        raise KeyError("no such adapter")

    made = {"good": lambda: posts.filter("id < 4"), "task": lambda: fail(posts, "the page is gone"), "plan": lambda: posts.select("nothing"), "build": unbuilt, "more": lambda: posts.filter("id > 6").drop("created_at")}
    out = branches.collect(spark, made)
    assert Counter(r.id for r in out.rows.collect()) == Counter([1, 2, 3, 7, 8]) and out.failed == 3
    told = {e.branch: e for e in out.events.collect()}
    assert set(told) == {"task", "plan", "build"} and all(e.kind == "failed" and e.message for e in told.values())
    assert "no such adapter" in told["build"].message


def test_all_broken_branches_fail_the_run(spark, posts):
    with pytest.raises(branches.AllFailed, match="none of the 3 branches"):
        branches.run(spark, CONTRACT, {k: lambda: fail(posts, "gone") for k in "abc"})
    with pytest.raises(branches.AllFailed):
        branches.collect(spark, {"a": lambda: branches.broken(posts, F.lit("bad file"))})
    assert branches.collect(spark, {}).rows is None


def test_rows_that_carry_an_error_are_left_out_and_counted(spark, posts):
    made = {"a": lambda: branches.broken(posts, F.when(F.col("id") % 2 == 0, F.concat(F.lit("bad page of "), "source"))), "b": lambda: branches.broken(posts.filter("id = 1"), F.lit("bad file"))}
    rows, events = branches.run(spark, CONTRACT, made)
    assert sorted(r.id for r in rows.collect()) == [1, 3, 5, 7]
    assert {(e.branch, e.kind, e.message, e.rows) for e in events.collect()} == {("a", "rows", "bad page of s", 4), ("b", "rows", "bad file", 1), ("b", "failed", "no row of it could be read", None)}


def test_rounds_until_there_are_enough(spark, posts):
    asked = []

    def find(number, rows):
        asked.append((number, rows.count()))
        return {"first": lambda: posts.limit(0), f"r{number}": lambda: posts.filter(F.col("id").between(3 * number - 3, 3 * number - 1))}

    rows, events = branches.run_in_rounds(spark, CONTRACT, {"first": lambda: posts.filter("id < 3")}, find)
    assert sorted(r.id for r in rows.collect()) == [1, 2, 3, 4, 5, 6, 7, 8] and asked == [(2, 2), (3, 5)] and events.count() == 0
    enough, _ = branches.run_in_rounds(spark, CONTRACT, {"first": lambda: posts}, find)
    assert enough.count() == 8 and len(asked) == 2  # five valid rows are all it wants

    def broken(number, rows):
        raise TimeoutError("no answer")

    few, events = branches.run_in_rounds(spark, CONTRACT, {"first": lambda: posts.filter("id < 3")}, broken)
    assert few.count() == 2 and [(e.branch, e.kind) for e in events.collect()] == [("round 2", "failed")]
    none, _ = branches.run_in_rounds(spark, CONTRACT, {"first": lambda: posts.filter("id < 3")}, lambda number, rows: {})
    assert none.count() == 2
    assert set(compiler.run(CONTRACT, [posts]).columns) == set(few.columns)


@pytest.mark.parametrize("budget, most", [(100, 5), (7, 5), (3, 2), (0, 5), (100, 1)])
def test_search_rounds_equal_a_plain_loop(spark, budget, most):
    """Refs that lead to others, some known, some twice, and no way on at the ends."""
    leads = {i: [f"{i * 2 + 1}", f"{i * 2 + 2}", f"{i // 2}"] for i in range(40)}
    table = spark.createDataFrame([(str(i), r) for i, rs in leads.items() for r in rs], "ref string, to string")

    def search(fresh, number, share):
        asked = fresh.orderBy(F.col("ref").cast("int")).limit(share)
        return asked.join(table, "ref").select(F.col("to").alias("ref")), asked.count()

    got = branches.search_rounds(search, spark.createDataFrame([("0",), ("1",), ("0",)], "ref string"), budget, most)
    seen, fresh, want, left = {"0", "1"}, {"0", "1"}, {}, budget
    for number in range(1, most + 1):
        share = left if number == most else -(-left // 2)
        if share <= 0:
            break
        asked = sorted(fresh, key=int)[:share]
        left -= len(asked)
        fresh = {r for a in asked for r in leads.get(int(a), [])} - seen
        if not fresh:
            break
        seen |= fresh
        want |= dict.fromkeys(fresh, number)
    assert Counter((r.ref, r.round) for r in got.collect()) == Counter(want.items())


def test_phrases_stand_apart(spark):
    text = spark.createDataFrame([(1, "Senior backend engineers, backend work"), (2, "BACKEND"), (3, None), (4, "")], "i int, t string")
    got = {r.i: [tuple(x) for x in r.p] for r in text.select("i", located_phrases(F.col("t"), ("backend engineers", " Senior Backend ", "engineers, back", "work", "", "backend")).alias("p")).collect()}
    assert got == {1: [(0, 1, 14), (15, 2, 30), (34, 3, 38)], 2: [(0, 5, 7)], 3: [], 4: []}


def test_first_keyword(spark):
    rows = spark.createDataFrame([("capital api", "api"), ("The (API) infra", "API"), ("Infrastructure", "Infra"), ("none", None), (None, None)], "t string, k string")
    assert all(r.got == r.k for r in rows.select("k", criteria.first_keyword(F.col("t"), ("api", "infra")).alias("got")).collect())
    assert rows.select(criteria.first_keyword(F.col("t"), ("", " ")).alias("got")).distinct().collect()[0].got is None


def test_sources_by_name_slug_and_variants(spark):
    registry = spark.createDataFrame([("OpenAI", "openai", ["ai"]), ("Acme Labs", "acme", ["bio"]), ("Scale AI", "scaleai", ["ai"]), ("Other", "other", []), ("Gone", "gone", ["ai"])], "name string, slug string, tags array<string>")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    pick = lambda c, tags=(), linked=False: sorted(r.name for r in discovery.select_sources(registry, c, list(tags), names("gone"), linked).collect())
    assert pick(names("OpenAI Inc", "other")) == ["OpenAI", "Other"]
    assert pick(names("acme", "scale-ai")) == ["Acme Labs", "Scale AI"] and pick(names("OpenAI LLC")) == ["OpenAI"]
    assert pick(names("Nobody"), ["ai"]) == ["OpenAI", "Scale AI"] and pick(names("Gone")) == ["Acme Labs", "OpenAI", "Other", "Scale AI"]
    assert pick(names("Nobody"), ["ai"], True) == [] and pick(names("other"), [], True) == ["Other"] and pick(names(), ["none"]) == []
