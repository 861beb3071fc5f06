"""Corpus queries that have SQL equal it."""

import pytest

from quillgraph.llm import queries

from .. import oracle


@pytest.fixture(scope="module", params=["0.001", "0.01"])
def folder(request):
    return f"/root/testdata/sf{request.param}"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, folder, name):
    df = queries.queries()[name](spark, folder)
    cursor = oracle.connect(folder).execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert oracle.rows(df.columns, df.collect()) == oracle.rows(names, cursor.fetchall())
