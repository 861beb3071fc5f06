"""Shared helpers of the corpus operators: table access, durable intermediates, word counts."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What counts as one word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; where it is unset, a single-JVM session (tests) gets a
    local one, and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage: later reads survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Stored(NamedTuple):
    """A table in the shared checkpoint folder, for what is large: compressed, by column, and gone once it is dropped."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> Stored:
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner see which shuffles nothing refers to any more, so that their files go now, not at the end."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside hand Python so many rows at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bit(rows: DataFrame, at: Column, wanted: DataFrame) -> DataFrame:
    """rows whose place `at` is one of wanted's (p). The places are broadcast as bitmaps, 4 kB for 32768 of them."""
    maps = wanted.select("p").groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__map"))
    byte = "cast(conv(hex(substring(__map, cast(bitmap_bit_position(__p) div 8 as int) + 1, 1)), 16, 10) as int)"
    hit = F.expr(f"shiftright({byte}, cast(bitmap_bit_position(__p) % 8 as int)) & 1")
    found = rows.withColumn("__p", at).withColumn("__n", F.bitmap_bucket_number("__p")).join(F.broadcast(durable(maps)), F.col("__n") == F.col("__bucket"))
    return found.filter(hit == 1).select(*rows.columns)


#: Rows of whole texts that go to Python at once, at most.
TEXT_ROWS = 1_000


def whole_texts(spark: SparkSession) -> None:
    """From now on this session hands Python TEXT_ROWS rows at a time at most: rows of whole texts are large, and a batch
    stands in the JVM and in the worker. What runs later, when a result is written, is meant too."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def among(rows: DataFrame, key: str, wanted: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """rows whose 16-byte key may be in wanted (same column): all that are, and few others.

    A bitmap of `bits` bits is broadcast: 4 MB at most, whatever the tables' sizes. It thins out what
    an exact join must shuffle afterwards; the more keys, the less it thins out, but it never loses one."""
    at = lambda c: F.pmod(F.conv(F.hex(F.substring(c, 1, 4)), 16, 10).cast("long"), F.lit(bits))
    return _bit(rows, at(key), wanted.select(at(key).alias("p")))


def utf8(c: Column | str) -> Column:
    return F.encode(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "UTF-8")


def n_words(c: Column | str) -> Column:
    """Number of words (WORD), 0 for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def global_rank(df: DataFrame, keys: Sequence[Column], out: str = "rank") -> DataFrame:
    """Number the rows 0.. in the total order of `keys`, without sending all rows to one task.

    Range-partitions, pins the partitions by a checkpoint, counts each partition (one number a partition goes
    to the driver) and adds the offsets. Rows that are equal in all keys get numbers in no defined order.
    """
    spark = df.sparkSession
    names = [f"__k{i}" for i in range(len(keys))]
    ranged = df.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(ranged.repartitionByRange(parts, *[F.col(n).asc_nulls_last() for n in names]).withColumn("__pid", F.spark_partition_id()))
    counts = {r["__pid"]: r["n"] for r in ranged.groupBy("__pid").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for pid in sorted(counts):
        offsets.append((pid, total))
        total += counts[pid]
    at = spark.createDataFrame(offsets or [(0, 0)], "__pid int, __at long")
    w = Window.partitionBy("__pid").orderBy(*[F.col(n).asc_nulls_last() for n in names])
    return ranged.join(F.broadcast(at), "__pid").withColumn(out, F.row_number().over(w) - 1 + F.col("__at")).drop("__pid", "__at", *names)
