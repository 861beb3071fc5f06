"""A vector index that stays: inverted lists with product-quantised codes, as Parquet in a folder.

`build` fits centres of lists and codebooks of residuals on a bounded sample and writes every vector into its list; `append`
adds vectors by the same centres and codebooks; `search` reads the lists whose centres are nearest to some query, ranks their rows by
codes, and ranks the best again by whole vectors. The three calls share only the folder:

    path/model     one row a centre and one a code: bounded, whatever the number of vectors
    path/lists     list=<n>/: batch, id, codes (a byte a part of the vector), vector

Codes and vectors are columns of their own, so the first ranking reads a few bytes a row, and the second one only
rows that are wanted. Lists are written by ranges of (list, hash of the id), so a list of any size spreads over files and tasks.
Search joins queries and rows in groups of bounded size: a task holds a slice of some lists and a block of the queries that visit them.

Metric: cosine distance, as Euclidean distance of vectors of length one. Vectors that are null, zero, of another length than most of the
sample, or hold nulls or non-finite numbers are not indexed and find nothing; null ids are not indexed. An id that is
appended again is a row of its own; search returns each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that centres and codebooks are fitted on, at most; codes of a part; rows that a task of a search holds, about.
SAMPLE, CODES, SLICE = 20_000, 256, 20_000
#: Queries of a block, rows that a task returns, and distances that it holds at once, about.
QUERIES, FOUND, PRODUCT = 8192, 1 << 20, 1 << 20
#: Components of the rows, and of the queries, that a task of a search holds, at most: the longer the vectors, the fewer.
HELD = 1_280_000
#: Decimals to which distances count.
PLACES = 9
#: Lists, at most (a centre each in the model and 40 sample rows for each).
LISTS = 512


class Model(NamedTuple):
    centres: np.ndarray  # lists x dimensions
    books: np.ndarray  # parts x codes x dimensions of a part

    @property
    def dim(self) -> int:
        return self.centres.shape[1]


def _usable(vector: Column) -> Column:
    """Doubles of a vector, null unless all are finite and one is not zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad & F.exists(v, lambda x: x != 0), v)


def _units(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    flat /= np.sqrt((flat * flat).sum(axis=1, keepdims=True))
    return flat


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    far, step = (centres * centres).sum(1)[None], max(1, PRODUCT // len(centres))
    return np.concatenate([np.argmin(far - 2 * x[i : i + step] @ centres.T, axis=1) for i in range(0, max(1, len(x)), step)])


def _centres(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's centres; a centre without rows moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        far = np.argsort(-((x - centres[at]) ** 2).sum(1), kind="stable")
        counts = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        empty = np.flatnonzero(counts == 0)
        centres[empty] = x[far[: len(empty)]]
    return centres


def fit(x: np.ndarray, lists: int, parts: int, seed: int = 1) -> Model:
    """Centres of lists and codebooks of what is left, from unit vectors x."""
    centres = _centres(x, min(lists, len(x)), seed)
    left = x - centres[_nearest(x, centres)]
    width = -(-x.shape[1] // parts)
    left = np.pad(left, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width)
    codes = min(CODES, len(x))
    return Model(centres, np.stack([_centres(left[:, j], codes, seed + j + 1) for j in range(parts)]))


def encode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """List and codes of unit vectors."""
    parts, _, width = model.books.shape
    at = _nearest(x, model.centres)
    left = np.pad(x - model.centres[at], ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)
    return at, np.stack([_nearest(left[:, j], model.books[j]) for j in range(parts)], axis=1).astype(np.uint8)


def _saved(model: Model) -> pd.DataFrame:
    rows = [("centre", i, 0, row.tolist()) for i, row in enumerate(model.centres)]
    rows += [("code", i, j, row.tolist()) for j, book in enumerate(model.books) for i, row in enumerate(book)]
    return pd.DataFrame(rows, columns=["kind", "number", "part", "vector"])


def load(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "part", "number").toPandas()
    centres, codes = (rows[rows.kind == k] for k in ("centre", "code"))
    return Model(np.array(centres.vector.tolist()), np.stack([np.array(g.vector.tolist()) for _, g in codes.groupby("part")]))


def _write(model: Model, vectors: DataFrame, path: str, batch: str, key: str, vector: str) -> None:
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), _usable(F.col(vector)).alias("v"), F.col(vector).cast("array<float>").alias("vector")).filter(F.size("v") == model.dim)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                some = b.slice(at, 2048)
                lists, codes = encode(model, _units(some.column("v")))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), some.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), some.column("vector")], names=["list", "id", "codes", "vector"])

    coded = rows.mapInArrow(encoded, "list int, id long, codes binary, vector array<float>").withColumn("batch", F.lit(batch))
    spread = coded.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list")
    spread.write.mode("append").partitionBy("list").parquet(f"{path}/lists")


def build(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, parts: int | None = None, batch: str = "build") -> None:
    """Write an index of all vectors to a new folder.

    lists: a thousand rows each if not given, LISTS at most. parts: bytes of a row's codes, one for four dimensions if not given."""
    spark = vectors.sparkSession
    usable = vectors.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), _usable(F.col(vector)).alias("v")).filter("v IS NOT NULL")
    n = usable.count()
    if not n:
        raise ValueError("no vectors to build an index of")
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    dim = int(sample.map(len).mode()[0])
    x = _units(pa.array([v for v in sample if len(v) == dim], pa.list_(pa.float64())))
    model = fit(x, lists or max(1, min(LISTS, n // 1000)), parts or max(1, dim // 4))
    spark.createDataFrame(_saved(model), "kind string, number int, part int, vector array<double>").coalesce(1).write.parquet(f"{path}/model")
    _write(model, vectors, path, batch, key, vector)


def append(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", batch: str = "append") -> None:
    """Add vectors to an index as it was fitted."""
    _write(load(vectors.sparkSession, path), vectors, path, batch, key, vector)


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """list, batch, id, codes, vector of all that an index holds."""
    return spark.read.schema("batch string, id long, codes binary, vector array<float>, list int").parquet(f"{path}/lists")


def _routed(model: Model, queries: DataFrame, probes: int, key: str, vector: str) -> DataFrame:
    """query_id, v (the unit vector), lists (the nearest first): the lists that each query visits, a row a query."""
    usable = queries.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("query_id"), _usable(F.col(vector)).alias("v")).filter(F.size("v") == model.dim)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda x, kind: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel(), kind))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                some = b.slice(at, 1024)
                x = _units(some.column("v"))
                far = (model.centres**2).sum(1)[None] - 2 * x @ model.centres.T
                near = np.argsort(far, axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([some.column("query_id"), lists(x, pa.float64()), lists(near, pa.int32())], names=["query_id", "v", "lists"])

    return usable.mapInArrow(routed, "query_id long, v array<double>, lists array<int>")


def visits(model: Model, queries: DataFrame, probes: int, key: str = "query_id", vector: str = "vector") -> DataFrame:
    """query_id, list, place (0: the nearest), v (the unit vector) of the lists that each query visits."""
    return _routed(model, queries, probes, key, vector).select("query_id", F.posexplode("lists").alias("place", "list"), "v").select("query_id", "list", "place", "v")


def _by_codes(model: Model, rows: pa.Table, asked: pa.Table) -> Iterator[np.ndarray]:
    """For each query the distances of all rows by codes, infinite in lists that it does not visit. rows: in the order of lists."""
    parts, _, width = model.books.shape
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(rows.num_rows, parts)
    at = rows.column("list").to_numpy()
    for v, lists in zip(asked.column("v").to_pylist(), asked.column("lists").to_pylist()):
        far = np.full(rows.num_rows, np.inf)
        for number in lists:
            i, j = np.searchsorted(at, [number, number + 1])
            left = np.pad(np.asarray(v) - model.centres[number], (0, parts * width - model.dim)).reshape(parts, 1, width)
            table = ((model.books - left) ** 2).sum(2)  # part, code: distance of the query's part from the code
            far[i:j] = table[np.arange(parts)[None], codes[i:j]].sum(1)
        yield far


def _by_vectors(model: Model, rows: pa.Table, asked: pa.Table) -> Iterator[np.ndarray]:
    """As _by_codes, by the cosine distance of whole vectors; a block of queries is one matrix product."""
    x = _units(rows.column("vector").combine_chunks().cast(pa.list_(pa.float64())))
    at, step = rows.column("list").to_numpy(), max(1, PRODUCT // rows.num_rows)
    for i in range(0, asked.num_rows, step):
        some = asked.slice(i, step)
        product = some.column("v").combine_chunks().flatten().to_numpy().reshape(some.num_rows, -1) @ x.T
        for far, lists in zip(np.subtract(1, product, out=product), some.column("lists").to_pylist()):
            seen = np.zeros(len(model.centres), bool)
            seen[lists] = True
            yield np.where(seen[at], far, np.inf)


def _ranked(model: Model, keep: int, whole: bool):
    """The `keep` nearest rows of a slice of a cell, for each of a block of queries; ties to the smaller id, also where they are cut."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        who, which, how = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if rows.num_rows and asked.num_rows:
            rows = rows.sort_by([("list", "ascending"), ("batch", "ascending")])
            ids = rows.column("id").to_numpy()
            for query, far in zip(asked.column("query_id").to_pylist(), (_by_vectors if whole else _by_codes)(model, rows, asked)):
                order = np.round(far, PLACES)
                most = np.partition(order, keep - 1)[keep - 1] if len(order) > keep else np.inf
                few = np.flatnonzero((order <= most) & np.isfinite(order))
                few = few[np.lexsort((ids[few], order[few]))[:keep]]
                who.append(np.full(len(few), query)), which.append(few), how.append(far[few])
        at = pa.array(np.concatenate(which))
        picked = [rows.column(c).take(at) for c in ("list", "id", "batch")]
        return pa.table([pa.array(np.concatenate(who)), *picked, pa.array(np.concatenate(how))], names=["query_id", "list", "id", "batch", "near"])

    return run


def _bounds(dim: int, keep: int) -> tuple[int, int]:
    """Rows and queries of a task of a search, at most."""
    return max(1, min(SLICE, HELD // dim)), max(1, min(QUERIES, HELD // dim, FOUND // keep))


def _nearest_rows(model: Model, index: DataFrame, asked: DataFrame, keep: int, whole: bool) -> DataFrame:
    """query_id, list, id, batch, near of at least the `keep` nearest rows of each query's lists.

    Lists are packed into cells of about SLICE rows (fewer, if vectors are long) and larger ones cut, queries dealt into blocks, so that a
    task holds a slice of a cell and a block of the queries that visit it, whatever the numbers of rows, lists, queries and components; it
    returns `keep` rows a query."""
    spark = asked.sparkSession
    most, block = _bounds(model.dim, keep)
    counts = index.groupBy("list").count().orderBy("list").collect()  # a row a list
    cells, cell, filled = {}, 0, 0
    for number, n in counts:
        if filled and filled + n > most:
            cell, filled = cell + 1, 0
        cells[number], filled = (cell, -(-n // most)), filled + n
    at = spark.createDataFrame([(number, *x) for number, x in cells.items()], "list int, cell int, slices int")
    blocks = -(-asked.count() // block) or 1
    own = F.struct(*[F.lit([cells.get(i, (-1, 0))[k] for i in range(len(model.centres))]).cast("array<int>").alias(c) for k, c in enumerate(("cell", "slices"))])
    dealt = index.select("list", "id", "batch", "vector" if whole else "codes").join(F.broadcast(at), "list")
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).drop("slices")
    sent = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("own", own)
    of = lambda c, x: F.element_at(f"own.{c}", x + 1)
    sent = sent.withColumn("cell", F.explode(F.array_distinct(F.transform("lists", lambda x: of("cell", x))))).filter("cell >= 0").withColumn("lists", F.filter("lists", lambda x: of("cell", x) == F.col("cell")))
    sent = sent.withColumn("slice", F.explode(F.sequence(F.lit(0), F.array_max(F.transform("lists", lambda x: of("slices", x))) - 1))).drop("own")
    group = ("cell", "slice", "block")
    return dealt.groupBy(*group).cogroup(sent.groupBy(*group)).applyInArrow(_ranked(model, keep, whole), "query_id long, list int, id long, batch string, near double")


def search(queries: DataFrame, path: str, k: int = 10, probes: int = 8, rerank: int | None = 10, key: str = "query_id", vector: str = "vector") -> DataFrame:
    """query_id, rank (from 1), id, batch, distance: the k nearest rows found for each query (query_id, vector).

    Only lists that some query visits are read. Of the rows there, rerank * k a query go on by their codes, and the distance
    is the cosine distance of the whole vectors. Without `rerank` all rows of the lists are ranked by their whole vectors, which is exact
    where all lists are visited. Distances equal to nine decimals are ties and go to the smaller id."""
    spark = queries.sparkSession
    model, index = load(spark, path), rows_of(spark, path)
    asked = _routed(model, queries, probes, key, vector)
    wanted = [r["list"] for r in asked.select(F.explode("lists").alias("list")).distinct().collect()]  # numbers of lists, LISTS at most unless asked for
    read = index.filter(F.col("list").isin(wanted))
    first = lambda df, by, n: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(by, "id", "batch"))).filter(F.col("rank") <= n)
    if rerank is None:
        ranked = _nearest_rows(model, read, asked, k, True).withColumnRenamed("near", "distance")
    else:
        few = first(_nearest_rows(model, read, asked, rerank * k, False), F.col("near"), rerank * k).select("query_id", "list", "id", "batch").distinct()  # rows of one id come back from the list
        exact = few.join(read.select("list", "id", "batch", "vector"), ["list", "id", "batch"]).join(asked.select("query_id", "v"), "query_id")
        double = F.transform("vector", lambda x: x.cast("double"))
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
        ranked = exact.withColumn("distance", 1 - dot(double, F.col("v")) / F.sqrt(dot(double, double)))  # v has length one
    return first(ranked, F.round("distance", PLACES), k).select("query_id", "rank", "id", "batch", "distance")


def share_read(queries: DataFrame, path: str, probes: int = 8, key: str = "query_id", vector: str = "vector") -> DataFrame:
    """queries, share: mean share of the index's rows in the lists that a query visits."""
    spark = queries.sparkSession
    sizes = rows_of(spark, path).groupBy("list").agg(F.count("*").alias("rows"))
    total = sizes.agg(F.sum("rows")).first()[0]
    seen = visits(load(spark, path), queries, probes, key, vector).join(F.broadcast(sizes), "list").groupBy("query_id").agg(F.sum("rows").alias("rows"))
    return seen.agg(F.count("*").alias("queries"), (F.avg("rows") / total).alias("share"))
