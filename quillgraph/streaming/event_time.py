"""Streams by the time of their events: rate limits that wait for the watermark, and joins of two streams within an interval.

Rows that come out of order or twice give what they give in order and once, as long as they are not later than the watermark; later ones are
left out. State is one key's window and the rows that the watermark has not passed yet, and goes when neither is needed."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = dt.datetime(1970, 1, 1)


def _ms(t: dt.datetime) -> int:
    return (t - _EPOCH) // dt.timedelta(milliseconds=1)


class _Limiter(StatefulProcessor):
    """Holds requests until the watermark has passed them, then counts them in the order of (time, id)."""

    def __init__(self, by: str, at: str, key: str, seconds: int, most: int) -> None:
        self.by, self.at, self.key, self.seconds, self.most = by, at, key, seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, n int")  # microseconds
        self.waiting = handle.getMapState("waiting", "at long, id long", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            for t, i in zip(batch[self.at], batch[self.key]):
                micros = pd.Timestamp(t).value // 1000
                if micros // 1000 >= passed:  # later than the watermark: left out
                    self.waiting.updateValue((micros, int(i)), (True,))
                    self.handle.registerTimer(micros // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted(tuple(k) for k in self.waiting.keys() if k[0] // 1000 < passed)
        start, n = self.window.get() if self.window.exists() else (None, 0)
        out = []
        for micros, i in due:
            if start is None or micros - start > self.seconds * 1_000_000:
                start, n = micros, 0
            n += 1
            out.append((key[0], i, pd.Timestamp(micros, unit="us"), n > self.most))
            self.waiting.removeKey((micros, i))
        if start is not None:
            end = start // 1000 + self.seconds * 1000 + 1
            if end < passed and not self.waiting.exists():
                self.window.clear()  # the next request starts a window of its own
            else:
                self.window.update((start, n))
                self.handle.registerTimer(max(end, passed) + 1)
        if out:
            yield pd.DataFrame(out, columns=[self.by, self.key, self.at, "refused"])

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, by: str = "client_ip", at: str = "ts", key: str = "event_id", seconds: int = 60, most: int = 10, late: str = "1 minute") -> DataFrame:
    """By, key, at, refused of a stream of requests, each once, when the watermark has passed it.

    A client's window starts with its first request and is reset by the first one that comes more than `seconds` later, by the requests' own
    times. The session's state store must be RocksDB."""
    schema = ", ".join(f"{c} {requests.schema[c].dataType.simpleString()}" for c in (by, key, at)) + ", refused boolean"
    rows = requests.select(by, at, key).withWatermark(at, late)
    return rows.groupBy(by).transformWithStateInPandas(_Limiter(by, at, key, seconds, most), schema, "Append", "EventTime")


def joined_within(left: DataFrame, right: DataFrame, by: str, at: tuple[str, str], key: tuple[str, str], before: str = "0 seconds", after: str = "10 minutes", late: tuple[str, str] = ("10 minutes", "10 minutes"), how: str = "inner") -> DataFrame:
    """Pairs of two streams with one key in which the right row comes from `before` before to `after` after the left one.

    Both sides carry a watermark, so a row's state goes once no partner can come; rows that come twice (by key and time) count once. how: inner, or
    leftOuter for left rows without a partner, which come when none can come any more."""
    # the other side's key is the id, so that a row that comes again meets its own state
    l = left.withWatermark(at[0], late[0]).dropDuplicatesWithinWatermark([key[0]]).select(F.col(by).alias("l_by"), F.col(key[0]).alias("l_key"), F.col(at[0]).alias("l_at"))
    r = right.withWatermark(at[1], late[1]).dropDuplicatesWithinWatermark([key[1]]).select(F.col(by).alias("r_by"), F.col(key[1]).alias("r_key"), F.col(at[1]).alias("r_at"))
    near = F.expr(f"l_by = r_by AND r_at >= l_at - INTERVAL {before} AND r_at <= l_at + INTERVAL {after}")
    return l.join(r, near, how).select(F.col("l_by").alias(by), "l_key", "r_key", "l_at", "r_at")
