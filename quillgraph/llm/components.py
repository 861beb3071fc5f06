"""Connected components of a table of links.

A table of up to LOCAL links (4 MB) is settled by one task with a union-find; larger ones by alternating large-star and
small-star steps, each an aggregation and an equi-join on narrow rows: a hub's links are split by skew handling, no group
is gathered, and the driver sees one checksum a step. Both give the same table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Links that one task may hold.
LOCAL = 1 << 18


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).filter("a != b").distinct()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of all links (a, b) of one task."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 50_000):
        some = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(map(top, some), pa.int64())], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", local: int = LOCAL) -> DataFrame:
    """node, root (its component's least node) for every node that has a link."""
    edges = durable(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct())
    if edges.count() <= local:
        return edges.coalesce(1).mapInArrow(_united, "node long, root long")
    seen = None
    while True:
        edges = durable(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after more links (a, b): the components of the links between roots, laid over them."""
    x = links.select("a", "b")
    for c in ("a", "b"):
        x = x.join(roots.toDF(c, "__r"), c, "left").withColumn(c, F.coalesce("__r", c)).drop("__r")
    found = durable(components(x))
    moved = roots.join(found.toDF("root", "__to"), "root", "left").select("node", F.coalesce("__to", "root").alias("root"))
    return moved.union(found.join(roots.select("node"), "node", "left_anti").select("node", "root"))
