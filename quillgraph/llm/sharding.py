"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Every row gets a global row number that depends on the rows' content alone (buckets by hash, then sorted in the
bucket). A keyed Feistel network permutes [0, n); position p goes to shard p % shards, slot p // shards, so shard
sizes differ by one row at most, slots have no gaps, and any (shard, slot) can be computed from a row number, and the
row number from (shard, slot), without data. All steps are built-in expressions.

Scale: two narrow shuffles (about 40 bytes a row); texts are read once and never shuffled. Buckets are salted by
the row's whole content, so no key, source or group of copies gathers in one. Identical rows are counted before the
shuffle and dealt out again afterwards, in blocks. Only the buckets' counts reach the driver.

Defined cases: null text has size `overhead` and the checksum of no bytes; null keys are a value as any other; rows
equal in all of (key, size, checksum) are interchangeable and each gets a place; an empty table gives an empty
result; other columns of the input do not matter, whatever their names.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, utf8

#: Buckets for numbering rows: each is sorted by one task; spilling sorts bound the memory.
BUCKETS = 4096
#: Rounds of the network, two half rounds each.
ROUNDS = 4
#: Copies of one identical row are dealt out in blocks of so many.
BLOCK = 4096


def _shape(n: int) -> tuple[int, int]:
    """Halves a * b >= n with a * b - n < a: few values lie outside [0, n)."""
    a = max(1, isqrt(max(0, n - 1)) + 1) if n > 0 else 1
    return a, max(1, -(-n // a))


def _div(x: Column, by: int) -> Column:
    """Whole quotient of x >= 0; exact below 2**53."""
    return ((x - F.pmod(x, F.lit(by))) / by).cast("long")


def _f(half: Column, key: Column, seed: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(half, key, F.lit(seed)), F.lit(modulus))


def _network(x: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """One pass of the network over [0, a * b), or its inverse."""
    a, b = _shape(n)
    start = F.struct(_div(x, b).alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

    def forward(s: Column, k: Column) -> Column:
        l = F.pmod(s["l"] + _f(s["r"], 2 * k, seed, a), F.lit(a))
        return F.struct(l.alias("l"), F.pmod(s["r"] + _f(l, 2 * k + 1, seed, b), F.lit(b)).alias("r"))

    def backward(s: Column, k: Column) -> Column:
        r = F.pmod(s["r"] - _f(s["l"], 2 * k + 1, seed, b), F.lit(b))
        return F.struct(F.pmod(s["l"] - _f(r, 2 * k, seed, a), F.lit(a)).alias("l"), r.alias("r"))

    keys = range(ROUNDS)
    order = F.array(*[F.lit(k).cast("long") for k in (reversed(keys) if inverse else keys)])
    return F.aggregate(order, start, backward if inverse else forward, lambda s: s["l"] * b + s["r"])


def permute(x: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """The place of x in the seeded permutation of [0, n); with `inverse`, the x whose place it is.

    Cycle walking: a value outside [0, n) is sent through the network again. Fewer than a values lie outside,
    so a walk ends after at most a * b - n + 1 steps; the rest of that bound is only walked by rows that need it.
    """
    a, b = _shape(n)
    outside = a * b - n

    def step(v: Column, _: Column) -> Column:
        return F.when(v < n, v).otherwise(_network(v, n, seed, inverse))

    x = _network(x.cast("long"), n, seed, inverse)
    for steps in sorted({min(8, outside), outside} - {0}):
        x = F.when(x < n, x).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, step))
    return x


def place(row_number: Column, n: int, shards: int, seed: int = 0) -> tuple[Column, Column]:
    """(shard, slot) of a row number."""
    p = permute(row_number, n, seed)
    return F.pmod(p, F.lit(shards)).cast("int"), _div(p, shards)


def row_at(shard: Column, slot: Column, n: int, shards: int, seed: int = 0) -> Column:
    """The row number stored at (shard, slot)."""
    return permute(slot.cast("long") * shards + shard, n, seed, inverse=True)


def number_rows(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """(df[keys] with a `row_number` from 0, number of rows); the numbers depend on the rows' content alone."""
    spark = df.sparkSession
    counted = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    counted = durable(counted.withColumn("__b", F.pmod(F.xxhash64(*keys, F.lit("bucket")), F.lit(buckets)).cast("int")))
    sizes = counted.groupBy("__b").agg(F.sum("__n").alias("n")).collect()  # a number a bucket
    total, at = 0, []
    for b, n in sorted((r["__b"], r["n"]) for r in sizes):
        at.append((b, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(at or [(0, 0)], "__b int, __at long"))
    order = [F.col(k).asc_nulls_first() for k in keys]
    upto = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = counted.join(offsets, "__b").withColumn("__from", F.col("__at") + F.coalesce(F.sum("__n").over(upto), F.lit(0)))
    blocks = first.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(BLOCK).cast("long"))))
    each = F.explode(F.sequence(F.col("__i"), F.least(F.col("__i") + BLOCK, F.col("__n")) - 1))
    return blocks.withColumn("__j", each).select(*keys, (F.col("__from") + F.col("__j")).alias("row_number")), total


def shard_table(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, seed: int = 20, overhead: int = 16) -> DataFrame:
    """key, size, text_crc32, row_number, shard, slot for every row of df."""
    data = utf8(text)
    narrow = df.select(F.col(key), (F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + overhead).alias("size"), F.crc32(data).alias("text_crc32"))
    numbered, n = number_rows(narrow, [key, "size", "text_crc32"])
    placed = numbered.withColumn("__p", permute(F.col("row_number"), n, seed))  # once, for both shard and slot
    return placed.select(key, "size", "text_crc32", "row_number", F.pmod(F.col("__p"), F.lit(shards)).cast("int").alias("shard"), _div(F.col("__p"), shards).alias("slot"))
