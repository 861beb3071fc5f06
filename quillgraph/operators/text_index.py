"""A substring index that stays: postings of character n-grams over segments of rows, as Parquet in a folder.

    path/columns   no rows, the columns of the indexed rows
    path/rows      seg=<n>/: row (place in the segment), label and id, and the indexed rows' columns; a folder a segment
    path/postings  gram, seg, rows: places in a segment whose text has the gram; in files by ranges of grams

A segment is a range of (label, id) of about SEGMENT characters. A phrase is in a row only if all of its n-grams are: `matching` reads the
postings of those grams alone (their ranges are pushed to the files), intersects them segment by segment, reads only folders of
segments with a candidate, and joins candidates there. What it returns is a superset in rows, exact for the phrase once
`contains` is tested again, which every search does anyway. Phrases shorter than N use their own length's grams, which are
indexed too.

Scale: grams of a piece of a segment are found and sorted as arrays in the task that reads it, so a posting list is as long as a segment at most and
a gram that all rows have costs a row a segment. Building shuffles postings once, by ranges of grams.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a gram; characters of a segment, about; characters whose grams are sorted at once; segments that a filter names, at most.
N, SEGMENT, PIECE, NAMED = 3, 1 << 25, 1 << 20, 5_000


def gram_keys(phrase: str) -> list[int]:
    """The grams of a phrase, as numbers: 21 bits a character."""
    codes = np.frombuffer(phrase.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    n = min(N, len(codes))
    return sorted({sum(int(c) << (21 * j) for j, c in enumerate(codes[i : i + n])) for i in range(len(codes) - n + 1)}) if n else []


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(at, at + b.num_rows, dtype=np.int32))], names=[*b.schema.names, "row"])
        at += b.num_rows


def _grams(texts: Sequence[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Different (gram, row) pairs of texts (row, text), sorted."""
    codes = np.frombuffer("".join(t for _, t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.array([len(t) for _, t in texts], np.int64)
    own, rows = np.repeat(np.arange(len(texts)), lengths), np.repeat(np.array([r for r, _ in texts], np.int64), lengths)
    keys, at, key = [], [], np.zeros(len(codes), np.int64)
    for n in range(1, N + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        key = key[:m] + (codes[n - 1 :] << (21 * (n - 1)))
        inside = own[:m] == own[n - 1 :]
        keys.append(key[inside]), at.append(rows[:m][inside])
    key, row = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, at))
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    new = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])) if len(key) else np.empty(0, bool)
    return key[new], row[new]


def _lists(key: np.ndarray, row: np.ndarray, seg: int) -> pa.RecordBatch:
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    lists = pa.ListArray.from_arrays(np.append(starts, len(key)).astype(np.int32), pa.array(row.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(key[starts]), pa.array(np.full(len(starts), seg, np.int32)), lists], names=["gram", "seg", "rows"])


def _posted(fields: Sequence[str]):
    """gram, seg, rows of the rows (seg, row, fields); pieces of a segment give lists of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seg, row = b.column("seg").to_pylist(), b.column("row").to_pylist()
            texts, held, at = [], 0, None
            for i in range(b.num_rows):
                if texts and (seg[i] != at or held > PIECE):
                    yield _lists(*_grams(texts), at)
                    texts, held = [], 0
                at = seg[i]
                for f in fields:
                    t = b.column(f)[i].as_py()
                    if t:
                        texts.append((row[i], t))
                        held += len(t)
            if texts:
                yield _lists(*_grams(texts), at)

    return run


def build(rows: DataFrame, path: str, fields: Sequence[str], order: Sequence[str] = ("label", "id"), segment: int = SEGMENT) -> None:
    """Write an index of the fields of rows, with all their columns, to a new folder; segments are ranges of `order`."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(reduce(Column.__add__, [F.length(F.coalesce(f, F.lit(""))) for f in fields]))).first()[0] or 0
    dealt = rows.repartitionByRange(int(size // segment) + 1, *order).sortWithinPartitions(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = dealt.mapInArrow(_placed, f"{schema}, row int").withColumn("seg", F.spark_partition_id())
    rows.limit(0).write.parquet(f"{path}/columns")
    placed.write.partitionBy("seg").parquet(f"{path}/rows")
    posted = _rows(spark, path).select("seg", "row", *fields).mapInArrow(_posted(fields), "gram long, seg int, rows array<int>")
    posted.repartitionByRange("gram").sortWithinPartitions("gram", "seg").write.parquet(f"{path}/postings")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns.add("row", "integer").add("seg", "integer")).parquet(f"{path}/rows")


def candidates(spark: SparkSession, path: str, phrase: str) -> DataFrame:
    """seg, row of the rows that have all grams of a phrase (of at least one character)."""
    keys = gram_keys(phrase)
    lists = spark.read.schema("gram long, seg int, rows array<int>").parquet(f"{path}/postings").filter(F.col("gram").isin(keys))
    whole = lists.groupBy("seg", "gram").agg(F.flatten(F.collect_list("rows")).alias("rows"))  # a segment's rows at most
    every = whole.groupBy("seg").agg(F.collect_list("rows").alias("lists")).filter(F.size("lists") == len(keys))
    both = F.aggregate(F.slice("lists", F.lit(2), F.lit(max(1, len(keys)))), F.element_at("lists", 1), lambda x, y: F.array_intersect(x, y))
    return every.select("seg", F.explode(F.array_distinct(both)).alias("row"))


def matching(spark: SparkSession, path: str, *phrases: str) -> DataFrame:
    """The indexed rows that can contain one of the phrases (an empty one: all rows), read from their segments only."""
    rows = _rows(spark, path)
    if not all(phrases):
        return rows.drop("seg", "row")
    found = reduce(DataFrame.union, [candidates(spark, path, p) for p in phrases]).distinct()
    named = [r["seg"] for r in found.select("seg").distinct().limit(NAMED + 1).collect()]
    some = rows.filter(F.col("seg").isin(named)) if len(named) <= NAMED else rows  # so many numbers in a filter; the join holds for any
    return some.join(found, ["seg", "row"], "left_semi").drop("seg", "row")
