"""Joins by time against plain versions, with a key that has half of all rows."""

import datetime as dt
import random

import pytest

from quillgraph.operators.intervals import as_of, overlaps, valid_during


def plain_as_of(left, right):
    out = []
    for i, k, t in left:
        before = [(u, v) for k2, u, v in right if None not in (k2, u, v, k, t) and k2 == k and u <= t]
        out.append((i, k, t, max(before)[1] if before else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("width", [None, 1, 7, 10_000])
def test_as_of(spark, width):
    rng = random.Random(2)
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
    left = [(i, key(), rng.choice([None, *range(-50, 300)])) for i in range(400)]
    right = [(key(), rng.choice([None, *range(-40, 280)]), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(150)]
    l, r = spark.createDataFrame(left, "id int, k string, at long"), spark.createDataFrame(right, "k string, at long, v double")
    got = as_of(l, r, "k", "at", "v", width)
    assert got.columns == ["id", "k", "at", "last_v"] and sorted(str(tuple(x)) for x in got.collect()) == plain_as_of(left, right)
    assert as_of(l.limit(0), r, "k", "at", "v").count() == 0
    assert {x.last_v for x in as_of(l, r.limit(0), "k", "at", "v").collect()} == {None}


def test_as_of_times(spark):
    t = dt.datetime(2024, 1, 1)
    l = spark.createDataFrame([(1, "a", t + dt.timedelta(days=2)), (2, "a", t)], "id int, k string, at timestamp")
    r = spark.createDataFrame([("a", t, "x"), ("a", t + dt.timedelta(days=1, microseconds=1), "y")], "k string, at timestamp, v string")
    assert {x.id: x.last_v for x in as_of(l, r, "k", "at", "v").collect()} == {1: "y", 2: "x"}


@pytest.mark.parametrize("width", [None, 1, 3, 1000])
def test_overlaps(spark, width):
    rng = random.Random(4)

    def some(n):
        out = []
        for i in range(n):
            s = rng.choice([None, *range(-100, 400)])
            length = rng.choice([-3, 0, 1, 2, 5, 30, 400, None])
            out.append((i, "hot" if rng.random() < 0.5 else rng.choice(["a", None]), s, None if length is None or s is None else s + length))
        return out

    a, b = some(120), some(90)
    schema = "id int, k string, s long, e long"
    got = overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ("k", "k"), ("id", "id"), ("s", "s"), ("e", "e"), width)
    far = 10**6
    full = lambda rows: [(i, k, s, far if e is None else e) for i, k, s, e in rows if k and s is not None and s < (far if e is None else e)]
    want = sorted((i, j, k) for i, k, s, e in full(a) for j, k2, s2, e2 in full(b) if k == k2 and s < e2 and s2 < e)
    assert sorted(map(tuple, got.collect())) == want


def test_valid_during(spark):
    points = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "b", 0), (4, None, 5), (5, "a", None)], "id int, k string, at long")
    facts = spark.createDataFrame([(1, "a", 0, 10), (2, "a", None, 6), (3, "a", 10, None), (4, "b", 1, 2), (5, "b", 0, 1)], "id int, k string, s long, e long")
    got = valid_during(points, facts, ("k", "k"), ("id", "id"), "at", "s", "e")
    assert sorted((x.a_key, x.b_key) for x in got.collect()) == [(1, 1), (1, 2), (2, 3), (3, 5)]


def test_a_hot_key_spreads_over_tasks(spark):
    """Rows of one key end in many partitions of the window."""
    l = spark.range(20_000).selectExpr("'hot' as k", "id as at")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = as_of(l, l.selectExpr("k", "at", "at as v").filter("at % 3 = 0"), "k", "at", "v")
        assert got.filter("last_v <> at - at % 3 or last_v is null").count() == 0
        bins = l.selectExpr("pmod(hash(k, at div 20), 16) as p").groupBy("p").count().collect()
        assert len(bins) == 16 and max(b["count"] for b in bins) < 20_000 / 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
