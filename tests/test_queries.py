"""Every registered query of the graph engine equals its SQL on the smallest tables; those without SQL return rows."""

import pytest

import __spark_entry__
from quillgraph.plans.registry import QUERIES, SQL

from . import oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.collect()
    if name not in SQL:
        assert df.columns
        return
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert oracle.rows(df.columns, got) == oracle.rows(names, cursor.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_clauses_of_all_lines(spark, tmp_path):
    lines = [f"line {i} " + "x" * (30 + i) for i in range(1, 25)]
    spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.article, r.n) for r in QUERIES["x6_clauses"](spark, str(tmp_path)).collect())
    assert got == [(1, i, len(x)) for i, x in enumerate(lines, 1)]
