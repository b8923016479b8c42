"""Every query with SQL equals it on the smallest table; the entry query runs."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import compare
from ledgerframe import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    import duckdb

    if not Path(SF).exists():
        pytest.skip("no test data")
    db = duckdb.connect()
    for t in compare.TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df, want = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert compare.lines([tuple(r) for r in df.collect()], df.columns) == compare.lines(want.fetchall(), want.columns)


def test_entry(spark):
    if not Path(SF).exists():
        pytest.skip("no test data")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_single_lines_of_all_texts(spark, tmp_path):
    """Texts beyond ASCII and null ones have a line as well."""
    import duckdb

    lines = {"plain  a": "plain a", None: None, "": "", "é\n\u00a0ü ": "é ü", "e\u0301a": "éa", "ﬁ １２ ™ ½": "fi 12 TM 1⁄2", "a\u200bb\ufeff \u202ec": "ab c"}
    lines |= {"x\u2028\u2029y\u1680z\x0b\tw": "x y z w", "\u3000가\u1100\u1161ｶﾞ": "가가ガ", "＇’": "'’", "a\x1fb\x85c": "a\x1fb\x85c", "é\x00ﬁ": "é\x00fi", "㉱\u11a7": "라\u11a7"}
    spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = list(enumerate(lines.values()))
    assert sorted(map(tuple, queries.QUERIES["k22_single_line"](spark, str(tmp_path)).collect())) == want
    assert sorted(db.sql(queries.ORACLE_SQL["k22_single_line"]).fetchall()) == want
