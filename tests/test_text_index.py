"""The substring index against plain containment, and what it reads."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.operators import search as S
from quillgraph.operators import text_index as T

FIELDS = ["name", "title", "content"]
SCHEMA = "id string, label string, name string, title string, content string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcé中") for _ in range(rng.randint(1, 5)))
    out = [(f"n{i:04d}", rng.choice("ABC"), word(), word() if i % 3 else None, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(600)]
    return out + [("x1", "A", None, None, None), ("x2", "A", "", "", ""), ("x3", "C", "unique needle", None, "zzz"), ("x4", None, "needle\0unique", "é😀中", "ab\ncd"), ("x4", None, "needle\0unique", "é😀中", "ab\ncd")]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("text") / "i")
    T.build(spark.createDataFrame(rows, SCHEMA), path, FIELDS, segment=2000)
    return path


@pytest.mark.parametrize("phrase", ["a", "中", "ab", "é中", "abc", "a b", "unique needle", "needle", "nothing like it", "zzz", "", "😀", "é😀中", "\0", "b\nc", "aa aa"])
def test_phrases(spark, rows, index, phrase):
    has = lambda c: F.coalesce(F.col(c).contains(phrase), F.lit(False))
    got = T.matching(spark, index, phrase).filter(has("name") | has("title") | has("content"))
    want = [r for r in rows if any(x is not None and phrase in x for x in r[2:])]
    assert sorted(map(str, map(tuple, got.select("id", "label", *FIELDS).collect()))) == sorted(map(str, want))


def test_files_without_the_grams_are_not_read(spark, index):
    every = T._rows(spark, index)
    assert every.select("seg").distinct().count() > 5
    found = T.matching(spark, index, "unique needle")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [seg#" in plan or "PartitionFilters: [isnotnull(seg" in plan
    segments = T.candidates(spark, index, "unique needle").select("seg").distinct().count()
    assert segments == 1
    assert "PushedFilters: [In(gram" in T.candidates(spark, index, "needle")._jdf.queryExecution().executedPlan().toString()
    assert T.matching(spark, index, "no such phrase at all").count() == 0


def test_searches_through_the_index(spark, rows, index):
    df = spark.createDataFrame(rows, SCHEMA)
    for q in ("a", "ab", "needle"):
        assert S.text_search(T.matching(spark, index, q), q, ["B", "A", "C"], 7).collect() == S.text_search(df, q, ["B", "A", "C"], 7).collect()
        assert S.symbol_search(T.matching(spark, index, q), q, ["C", "A"]).collect() == S.symbol_search(df, q, ["C", "A"]).collect()
    terms = ["bc", "é", "needle"]
    key = lambda r: tuple(r)
    assert sorted(map(key, S.subterm_search(T.matching(spark, index, *terms), terms, ["A", "B"]).collect())) == sorted(map(key, S.subterm_search(df, terms, ["A", "B"]).collect()))


@given(st.lists(st.tuples(st.integers(0, 3), st.text("ab😀", max_size=12)), max_size=8))
@settings(max_examples=100, deadline=None)
def test_grams(texts):
    key, row = T._grams(texts)
    want = {(k, r) for r, t in texts for n in range(1, T.N + 1) for i in range(len(t) - n + 1) for k in T.gram_keys(t[i : i + n])}
    assert list(zip(key.tolist(), row.tolist())) == sorted(want)


def test_empty_table(spark, tmp_path):
    T.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "i"), FIELDS)
    assert T.matching(spark, str(tmp_path / "i"), "a").count() == 0
