"""The written store: readers see whole runs or nothing, and runs that come again leave one copy."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerframe.operators import criteria, store
from ledgerframe.plans import compiler
from ledgerframe.session import scratch


def rows(spark, values):
    return spark.createDataFrame(values, "key string, title string, ord long")


def proof(records):
    return store.evidence_rows(records.withColumn("method", F.lit("API")).withColumn("verified", F.lit(True)), ["title"], ["key"])


@pytest.fixture
def written(spark):
    return store.RunStore(spark, scratch(spark, "run-store"))


def kept(written, *runs):
    return Counter((r.run, r.key, r.title) for r in written.read("records", *runs).collect()), Counter((r.run, r.key, r.value) for r in written.read("evidence", *runs).collect())


def test_only_committed_attempts_are_read(spark, written):
    assert written.committed().count() == 0 and written.read("records").count() == 0
    one = rows(spark, [("a", "A", 1), ("b", None, 2)])
    written.write_attempt("r/1", "x", one, proof(one))
    assert written.read("records").count() == 0  # killed before its commit
    written.commit("r/1", "x")
    assert kept(written) == (Counter([("r/1", "a", "A"), ("r/1", "b", None)]), Counter([("r/1", "a", "A")]))
    # Killed while it was written again: the old copy stays whole.
    two = rows(spark, [("a", "new", 1), ("c", "C", 2)])
    written.write_attempt("r/1", "y", two, proof(two).limit(0))
    assert kept(written)[0] == Counter([("r/1", "a", "A"), ("r/1", "b", None)])
    # Written at last; nothing of the others stays, in the folders neither.
    written.write("r/1", two, proof(two))
    assert kept(written) == (Counter([("r/1", "a", "new"), ("r/1", "c", "C")]), Counter([("r/1", "a", "new"), ("r/1", "c", "C")]))
    assert spark.read.parquet(f"{written.folder}/records").select("attempt").distinct().count() == 1


def test_an_attempt_written_twice_is_one(spark, written):
    one = rows(spark, [("a", "A", 1)])
    for _ in range(2):
        written.write_attempt("r", "x", one, proof(one))
    written.commit("r", "x")
    assert written.read("records").count() == written.read("evidence").count() == 1


def test_runs_stay_apart_and_may_have_other_columns(spark, written):
    one, none = rows(spark, [("a", "A", 1)]), rows(spark, [])
    written.write("r 1", one.withColumn("more", F.lit(7)), proof(one))
    written.write("r%201", one, proof(one))
    written.write("empty", none, proof(none))
    assert Counter(r.run for r in written.read("records").collect()) == {"r 1": 1, "r%201": 1}
    assert {(r.run, r.more) for r in written.read("records").collect()} == {("r 1", 7), ("r%201", None)}
    assert kept(written, "r 1")[0] == Counter([("r 1", "a", "A")])
    assert store.RunStore(spark, written.folder).committed().count() == 3


def test_a_run_stores_what_it_found(spark, written):
    contract = criteria.Contract(fields=("title", "url"), required=("title",), keys=(("url",),), urls=("url",), criteria=())
    found = spark.createDataFrame(
        [(1, 1, "s", "API", True, 0, "First", "https://a.b/1"), (2, 2, "s", "API", True, 0, "Second", "https://a.b/2"), (1, 3, "s", "API", True, 0, "First again", "https://a.b/1"), (4, 4, "s", "DOM", False, 0, None, "nowhere")],
        "id long, ord long, source string, method string, verified boolean, created_at int, title string, url string",
    )
    for sources in ([found, found.filter("id = 2").withColumn("id", F.lit(9)).withColumn("url", F.lit("https://a.b/9"))], [found]):
        out = compiler.run_and_store(contract, sources, written, "run")
        assert out.count() == (4 if len(sources) == 2 else 3)
    got = {r.key: (r.title, r.status) for r in written.read("records", "run").collect()}
    assert got == {"s:1": ("First again", "valid"), "s:2": ("Second", "valid"), "s:4": (None, "invalid")}
    assert Counter(r.key for r in written.read("evidence").collect()) == {"s:1": 2, "s:2": 2, "s:4": 1}
