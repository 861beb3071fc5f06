"""The vector index against exact search, over builds, appends and odd vectors."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillgraph.operators import vector_index as V
from quillgraph.plans.registry import QUERIES, SQL

from . import oracle


def clustered(n, dim=32, centres=40, seed=0):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dim))
    return at[rng.integers(centres, size=n)] + 0.25 * rng.normal(size=(n, dim))


def exact(x, q, k):
    d = 1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    return [np.lexsort((np.arange(len(x)), row))[:k].tolist() for row in d]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("index") / "v")


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")


def test_build_append_search(spark, folder):
    """Recall of 0.9 or more from a sixth of the rows, also for rows that came after the fit."""
    x = clustered(8000)
    q = clustered(60, seed=0) + 0.05
    V.build(frame(spark, x[:6000]), folder, lists=48)
    before = V.rows_of(spark, folder).count()
    V.append(frame(spark, x[6000:], range(6000, 8000)), folder)
    assert (before, V.rows_of(spark, folder).count()) == (6000, 8000)
    asked = frame(spark, q).withColumnsRenamed({"vec_id": "query_id", "embedding": "vector"})
    got = V.search(asked, folder, k=10, probes=6).toPandas()
    want = exact(x.astype(np.float32).astype(float), q, 10)
    hits = [len(set(want[i]) & set(got[got.query_id == i]["id"])) for i in range(len(q))]
    assert sum(hits) >= 0.9 * 10 * len(q)
    assert (got[got["id"] >= 6000].batch == "append").all() and (got["id"] >= 6000).any()
    share = V.share_read(asked, folder, probes=6).first()
    assert share.queries == 60 and share.share < 1 / 6 * 1.3
    assert got.groupby("query_id")["distance"].apply(lambda d: d.is_monotonic_increasing).all()


def test_reads_only_the_lists_it_visits(spark, folder):
    one = frame(spark, clustered(1, seed=0)).withColumnsRenamed({"vec_id": "query_id", "embedding": "vector"})
    found = V.search(one, folder, k=3, probes=2)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan
    lists = V.visits(V.load(spark, folder), one, 2).count()
    assert lists == 2 and found.count() == 3


def test_all_lists_give_the_exact_answer(spark, tmp_path):
    x, q = clustered(700, dim=10, seed=3), clustered(20, dim=10, seed=3)
    V.build(frame(spark, x), str(tmp_path / "v"), lists=9, parts=4)  # ten dimensions in four parts
    asked = frame(spark, q).withColumnsRenamed({"vec_id": "query_id", "embedding": "vector"})
    got = V.search(asked, str(tmp_path / "v"), k=5, probes=9, rerank=200)
    want = exact(x.astype(np.float32).astype(float), q.astype(np.float32).astype(float), 5)
    found = got.toPandas().sort_values("rank").groupby("query_id")["id"].apply(list)
    assert [found[i] for i in range(20)] == want


def test_odd_vectors(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [inf, 0.0]), (10, [1e30, 1e30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    path = str(tmp_path / "v")
    V.build(df, path)
    assert sorted(r.id for r in V.rows_of(spark, path).collect()) == [1, 2, 2, 10]
    V.append(df.limit(0), path)
    asked = spark.createDataFrame([(1, [2.0, 0.1]), (2, None), (3, [0.0, 0.0]), (None, [1.0, 1.0])], "query_id long, vector array<double>")
    got = V.search(asked, path, k=10).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.rank)] == [1, 10, 2, 2] and {r.query_id for r in got} == {1}
    with pytest.raises(ValueError):
        V.build(df.filter("vec_id = 3"), str(tmp_path / "w"))


def test_a_list_with_all_rows_is_cut_into_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "SLICE", 50)
    x = clustered(600, dim=8, centres=1, seed=4)
    path = str(tmp_path / "v")
    V.build(frame(spark, x), path, lists=1)
    asked = frame(spark, x[:5]).withColumnsRenamed({"vec_id": "query_id", "embedding": "vector"})
    got = V.search(asked, path, k=4, probes=1, rerank=150).toPandas().sort_values("rank").groupby("query_id")["id"].apply(list)
    y = x.astype(np.float32).astype(float)
    assert [got[i] for i in range(5)] == exact(y, y[:5], 4)


def test_query_ranks_copies_and_near_ties_as_its_sql(spark, tmp_path):
    """More copies than are ranked again by codes, and distances that differ beyond the ninth decimal only."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[300:1200] = x[100]  # 900 copies of a query
    x[200] = np.eye(16)[0]
    for k in range(20):  # the smaller the id, the farther, by less than 1e-9
        x[1201 + k] = np.eye(16)[0] + np.eye(16)[1] * 1e-6 * (20 - k)
    folder = str(tmp_path)
    frame(spark, x).write.parquet(f"{folder}/embeddings.parquet")
    got = QUERIES["k12_index_search"](spark, folder)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    cursor = duck.execute(SQL["k12_index_search"])
    assert oracle.rows(got.columns, got.collect()) == oracle.rows([d[0] for d in cursor.description], cursor.fetchall())


def test_groups_of_a_search_are_bounded(spark, tmp_path, monkeypatch):
    """Cells of several lists, cut lists and blocks of queries give what one group gives."""
    x, q = clustered(900, dim=8, seed=6), clustered(70, dim=8, seed=7)
    path = str(tmp_path / "v")
    V.build(frame(spark, x), path, lists=12)
    asked = frame(spark, q).withColumnsRenamed({"vec_id": "query_id", "embedding": "vector"})
    found = lambda **how: sorted(tuple(r)[:4] for r in V.search(asked, path, k=6, **how).collect())
    plain = [found(probes=12, rerank=None), found(probes=3, rerank=None), found(probes=3, rerank=5)]
    y = x.astype(np.float32).astype(float)
    want = exact(y, q.astype(np.float32).astype(float), 6)
    assert [[r[2] for r in plain[0] if r[0] == i] for i in range(70)] == want
    for name, size in (("SLICE", 100), ("QUERIES", 20), ("PRODUCT", 300)):
        monkeypatch.setattr(V, name, size)
    assert [found(probes=12, rerank=None), found(probes=3, rerank=None), found(probes=3, rerank=5)] == plain


def test_a_task_of_a_search_holds_little_memory(spark, tmp_path, monkeypatch):
    """A full slice with many queries; long vectors come in smaller slices and blocks, which give the same rows."""
    rng = np.random.default_rng(8)
    n, asked, dim = V.SLICE, 1000, 64
    x, q = rng.normal(size=(n, dim)), rng.normal(size=(asked, dim))
    q /= np.sqrt((q * q).sum(1, keepdims=True))
    model = V.Model(x[:1], np.zeros((1, 1, dim)))
    lists = lambda a, kind: pa.array(list(a), pa.list_(kind))
    rows = pa.table({"list": pa.array(np.zeros(n, np.int32)), "id": pa.array(np.arange(n)), "batch": pa.array(["build"] * n), "vector": lists(x.astype(np.float32), pa.float32())})
    queries = pa.table({"query_id": pa.array(np.arange(asked)), "v": lists(q, pa.float64()), "lists": lists(np.zeros((asked, 1), np.int32), pa.int32())})
    tracemalloc.start()
    got = V._ranked(model, 5, True)(rows, queries)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 5 * asked and peak < 48e6
    y, one = x.astype(np.float32).astype(float), got.slice(0, 5)
    assert one.column("id").to_pylist() == exact(y, q[:1], 5)[0]
    assert V._bounds(64, 5) == (V.SLICE, V.QUERIES) and max(V._bounds(1024, 5)) * 1024 <= V.HELD
    path, z = str(tmp_path / "v"), clustered(500, dim=8, seed=9)
    V.build(frame(spark, z), path, lists=5)
    few = frame(spark, z[:60]).withColumnsRenamed({"vec_id": "query_id", "embedding": "vector"})
    found = lambda: sorted(tuple(r)[:4] for r in V.search(few, path, k=6, probes=5, rerank=None).collect())
    plain = found()
    monkeypatch.setattr(V, "HELD", 160)
    assert found() == plain
