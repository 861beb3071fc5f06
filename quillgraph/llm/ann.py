"""Approximate nearest neighbours with learned partitions.

A bounded sample's k-nearest-neighbour graph is cut into balanced parts: centres are grown under a capacity, then
vertices move to the part that holds most of their neighbours as long as sizes stay within bounds, so few graph edges are
cut. A small classifier (softmax regression on the vector and its squared distances to the parts' means) learns the
parts; it files every row of the table under its most probable part and routes a query to as many parts as make up
a share of its probability. That share is set on vertices that the classifier has not seen, so that their graph
neighbours are reached in RECALL of all cases: few parts where the data have structure, most where they have none. Rows
there are reranked by exact distance in double precision.

Scale: the number of parts grows with the table, one for ROWS rows, up to a sixteenth of the sample, so a query reads a
smaller share of a larger table. The model is a few matrices of parts x dimension. Rows are dealt by (part, block), blocks of
about `block` rows, so a hot part or a group of equal vectors is spread over tasks; queries are sent to the blocks of
their parts. Only where a part has more than QUERIES queries do these meet its blocks in several chunks. Each (query, block)
gives back its k best; these meet in one aggregation. Nothing is dropped: a part's blocks are searched whole.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part; fewer than k candidates give all of them; ties go to the smaller id, a null one last; repeated ids are rows of
their own; squares that overflow are scaled first; an empty table or no queries give no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Bounded sample that the graph is made of; parts at least, and rows that ask for one more.
SAMPLE, PARTS, ROWS, GRAPH_K = 4096, 16, 2048, 10
BLOCK, QUERIES = 4096, 8192
#: Share of a held-out fifth of the sample's graph edges that routing must reach, and parts searched at least.
RECALL, PROBES = 0.97, 2
SEED = 3


class Router(NamedTuple):
    means: np.ndarray
    centre: np.ndarray
    scale: float
    w: np.ndarray
    mass: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = _inputs(x, self.means, self.centre, self.scale) @ self.w
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _inputs(x: np.ndarray, means: np.ndarray, centre: np.ndarray, scale: float) -> np.ndarray:
    y, m = (x - centre) / scale, (means - centre) / scale
    d = ((y**2).sum(1)[:, None] - 2 * y @ m.T + (m**2).sum(1)) / x.shape[1]
    return np.hstack([np.ones((len(x), 1)), y, -d])


def neighbour_graph(x: np.ndarray, k: int = GRAPH_K, chunk: int = 512) -> np.ndarray:
    """Indices of each row's k nearest other rows."""
    out, norms = [], (x**2).sum(1)
    k = min(k, len(x) - 1)
    for a in range(0, len(x), chunk):
        d = norms[a : a + chunk, None] - 2 * x[a : a + chunk] @ x.T + norms
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(x) - 1 else np.argsort(d, axis=1)[:, :k])
    return np.vstack(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.25, rounds: int = 12) -> np.ndarray:
    """A part for each vertex: sizes at most slack times even, few edges between parts."""
    n = len(x)
    cap = int(np.ceil(slack * n / parts))
    rng = np.random.default_rng(SEED)
    centres = [int(rng.integers(n))]
    near = ((x - x[centres[0]]) ** 2).sum(1)
    while len(centres) < parts:  # spread starts
        total = near.sum()
        centres.append(int(rng.choice(n, p=near / total)) if total > 0 else int(rng.integers(n)))
        near = np.minimum(near, ((x - x[centres[-1]]) ** 2).sum(1))
    means = x[centres]
    part = np.zeros(n, np.int64)
    for _ in range(6):  # balanced assignment, nearest rows first
        d = (x**2).sum(1)[:, None] - 2 * x @ means.T + (means**2).sum(1)
        choice = np.argsort(d, axis=1)
        room = np.full(parts, cap)
        for i in np.argsort(d.min(axis=1), kind="stable"):
            p = next(q for q in choice[i] if room[q])
            part[i], room[p] = p, room[p] - 1
        means = np.vstack([x[part == p].mean(0) if (part == p).any() else means[p] for p in range(parts)])
    sizes = np.bincount(part, minlength=parts)
    floor = int(n / parts / slack / 2)
    both: list[list[int]] = [list(r) for r in graph]
    for i, r in enumerate(graph):
        for j in r:
            both[j].append(i)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[both[i]], minlength=parts)
            best = int(votes.argmax())
            if votes[best] > votes[part[i]] and sizes[best] < cap and sizes[part[i]] > floor:
                sizes[part[i]] -= 1
                sizes[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


def train(x: np.ndarray, parts: int = PARTS, recall: float = RECALL, steps: int = 300) -> Router:
    """The classifier of a sample's balanced parts."""
    x = np.asarray(x, np.float64)
    parts = max(1, min(parts, len(x) // 8))
    if parts == 1:
        return Router(np.zeros((1, x.shape[1])), np.zeros(x.shape[1]), 1.0, np.zeros((x.shape[1] + 2, 1)), 1.0)
    graph = neighbour_graph(x)
    part = balanced_parts(x, graph, parts)
    means = np.vstack([x[part == p].mean(0) if (part == p).any() else np.zeros(x.shape[1]) for p in range(parts)])
    centre, scale = x.mean(0), float(x.std()) or 1.0
    held = np.arange(len(x)) % 5 == 0
    z, y = _inputs(x[~held], means, centre, scale), np.eye(parts)[part[~held]]
    w = np.zeros((z.shape[1], parts))
    speed = np.zeros_like(w)
    for step in range(steps):  # gradient descent with momentum
        s = z @ w
        q = np.exp(s - s.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        speed = 0.9 * speed - 0.5 * (z.T @ (q - y) / len(z) + 1e-3 * w)
        w = w + speed
    router = Router(means, centre, scale, w, 1.0)
    q = router.probabilities(x)
    filed, order = q.argmax(1), np.argsort(-q, axis=1)
    before = np.cumsum(np.take_along_axis(q, order, 1), axis=1) - np.take_along_axis(q, order, 1)
    # probability of the parts that are tried before the one that holds the neighbour
    spent = np.take_along_axis(before, np.argsort(order, axis=1), 1)
    need = np.sort(np.concatenate([spent[i, filed[graph[i]]] for i in np.flatnonzero(held)]))
    return router._replace(mass=float(need[min(len(need) - 1, int(recall * len(need)))]) + 1e-12)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (array<double>) of the rows that take part."""
    v = F.transform(vector, lambda e: e.cast("double"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("v").isNotNull())
    rows = rows.filter(~bad & F.exists("v", lambda e: e != 0))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (size["d"] if size else -1))


def _routed(router: Router, all_parts: bool, probes: int = 1):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            q = router.probabilities(np.array(p["v"].tolist()))
            if not all_parts:
                yield p.assign(part=q.argmax(1))
                continue
            order = np.argsort(-q, axis=1)
            reached = np.cumsum(np.take_along_axis(q, order, 1), axis=1)
            many = np.minimum(q.shape[1], np.maximum(probes, (reached < router.mass).sum(1) + 1))
            yield p.assign(part=[o[:m].tolist() for o, m in zip(order, many)])

    return run


def _distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        diff = x - v
        d = np.sqrt((diff**2).sum(1))
    if not np.isfinite(d).all():
        far = np.flatnonzero(np.isfinite(diff).all(axis=1) & ~np.isfinite(d))
        most = np.abs(diff[far]).max(axis=1)
        with np.errstate(over="ignore"):
            d[far] = most * np.sqrt(((diff[far] / most[:, None]) ** 2).sum(1))
    return d


def _search(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            x, ids, none = np.array(rows["v"].tolist()), rows["id"].to_numpy(), rows["none"].to_numpy(bool)
            home = rows["mark"].to_numpy()
            for q, mark, v in zip(queries["id"], queries["mark"], queries["v"]):
                d = _distances(x, np.asarray(v))
                others = np.flatnonzero(home != mark)  # not the query's own row
                if k < len(others):
                    others = others[d[others] <= np.partition(d[others], k - 1)[k - 1]]
                near = others[np.lexsort((ids[others], none[others], d[others]))][:k]
                out.append(pd.DataFrame({"query_id": q, "mark": mark, "vec_id": ids[near], "none": none[near], "score": d[near]}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("query_id", "int64"), ("mark", "int64"), ("vec_id", "int64"), ("none", "bool"), ("score", "float64"))})

    return run


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, parts: int | None = None, sample: int = SAMPLE, recall: float = RECALL, probes: int = PROBES, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose key is divisible by `every`, among all rows.

    parts: one for ROWS rows unless given, PARTS at least and a sixteenth of the sample at most."""
    # pandas has no null among whole numbers: a null id goes as 0 and a flag
    rows = usable(df, key, vector).withColumn("none", F.col("id").isNull()).withColumn("id", F.coalesce("id", F.lit(0).cast("long")))
    rows = durable(rows.withColumn("mark", F.monotonically_increasing_id()))
    few = rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id", "mark").limit(sample).select("v").collect()  # `sample` vectors
    if not few:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = parts or min(max(PARTS, rows.count() // ROWS), max(PARTS, sample // 16))
    router = train(np.array([r["v"] for r in few]), parts, recall)
    fields = "id long, v array<double>, none boolean, mark long"
    filed = durable(rows.mapInPandas(_routed(router, False), f"{fields}, part int"))
    asked = durable(rows.filter(~F.col("none") & (F.col("id") % every == 0)).mapInPandas(_routed(router, True, probes), f"{fields}, part array<int>"))
    # a row a part: how many blocks its rows fill, how many chunks its queries
    sizes = filed.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    visits = asked.select(F.explode("part").alias("part")).groupBy("part").agg(F.ceil(F.count("*") / queries).cast("int").alias("chunks"))
    grid = F.broadcast(durable(sizes.join(visits, "part")))
    dealt = filed.join(grid, "part").withColumn("block", F.pmod(F.xxhash64("mark", F.lit(SEED)), F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asked = asked.withColumn("part", F.explode("part")).join(grid, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("mark", F.lit(SEED + 1)), F.col("chunks")).cast("int"))
    on = ["part", "block", "chunk"]
    found = asked.select("id", "v", "mark", *on).groupBy(*on).cogroup(dealt.select("id", "none", "v", "mark", *on).groupBy(*on)).applyInPandas(_search(k), "query_id long, mark long, vec_id long, none boolean, score double")
    best = found.groupBy("query_id", "mark").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "none", "vec_id"))), 1, k).alias("b"))
    best = best.select("query_id", F.posexplode("b").alias("rank", "b"))
    return best.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.when(~F.col("b.none"), F.col("b.vec_id")).alias("vec_id"), "b.score")
