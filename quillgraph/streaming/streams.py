"""Streaming forms: rate limiting with state, windowed counts with late data, change detection, idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited(requests: DataFrame, by: str = "client_ip", at: str = "ts", seconds: int = 60, most: int = 10) -> DataFrame:
    """By, at, refused. A client's window starts with its first request and is reset by the first one that comes more
    than `seconds` later; the state of a client is a start and a count, and goes after an idle window."""
    kind = requests.schema[by].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(batches).sort_values(at)
        refused = []
        for t in rows[at]:
            if start is None or (t - start).total_seconds() > seconds:
                start, n = t, 0
            n += 1
            refused.append(n > most)
        state.update((start, n))
        state.setTimeoutDuration(2000 * seconds)
        yield pd.DataFrame({by: key[0], at: rows[at], "refused": refused})

    return requests.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, {at} timestamp, refused boolean", "start timestamp, n int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, at: str, by: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling event-time window; rows later than the watermark are left out and state is dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def session_counts(events: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by session."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def unseen(docs: DataFrame, key: str, text: str, at: str, late: str = "1 day") -> DataFrame:
    """Z3: each (key, hash of text) once."""
    return docs.withColumn("hash", F.left(F.sha2(text, 256), F.lit(16))).withWatermark(at, late).dropDuplicatesWithinWatermark([key, "hash"])


def merge_sink(path: str, key: str, merge: Callable[[DataFrame, DataFrame, str], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges a batch into the newest version of a table and writes the next one, named by
    batch, so that a batch that runs again writes the same version again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        except Exception as e:  # the first batch after the table was emptied
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        (batch if old is None else merge(old, batch, key)).write.mode("overwrite").parquet(f"{path}/v{number}")

    return write
