"""Numbers for rows in a total order, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path, written


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(at, at + b.num_rows))], names=[*b.schema.names, "__at"])
        at += b.num_rows


def in_order(df: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """df with its rows' numbers from 0 in the order of `by` (nulls first); rows equal there are numbered in any order.

    Ranges of the order are numbered task by task and written; what stands before a range is one number a range."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_placed, f"{schema}, __at long").withColumn("__range", F.spark_partition_id())
    placed = written(ranged, scratch_path(df.sparkSession, "order"))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("n"))  # a row a range
    before = sizes.select("__range", (F.sum("n").over(Window.partitionBy().orderBy("__range")) - F.col("n")).alias("__before"))
    return placed.join(F.broadcast(before), "__range").withColumn(out, F.col("__at") + F.col("__before")).drop("__range", "__at", "__before")
