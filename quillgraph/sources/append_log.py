"""Append-only logs of JSON lines as a data source, for batches and for streams.

    spark.dataSource.register(AppendLog)
    spark.read.format("append_log").schema("ts timestamp, id long").option("path", folder).load()
    spark.readStream.format("append_log").schema(...).option("path", folder).load()

A folder's files (`*.jsonl`) are cut into byte ranges of `chunk` bytes (16 MB), a task each; a line belongs to the range that it begins in. Lines
that are no JSON object, or whose values do not fit the schema, are skipped. Files named by day (`2024-05-31-x.jsonl`) that a pushed filter on
column `day_column` rules out are not opened (with spark.sql.python.filterPushdown.enabled).

A stream's offset holds, by file, the bytes up to the last whole line; a line that is still being written waits for its end. The folder must be
mounted where tasks run, as files are opened by path."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

CHUNK = 16 << 20
_DAY = re.compile(r"(\d{4}-\d{2}-\d{2})")


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def _files(folder: str) -> list[str]:
    found = [os.path.join(top, f) for top, _, names in os.walk(folder.removeprefix("file:")) for f in names if f.endswith(".jsonl")]
    return sorted(found)


def _pieces(path: str, start: int, end: int, chunk: int) -> list[Piece]:
    return [Piece(path, a, min(a + chunk, end)) for a in range(start, end, chunk)]


def _value(v, kind: T.DataType):
    """v as a column of this kind holds it; ValueError if it does not."""
    if v is None or isinstance(kind, T.StringType):
        return v if v is None or isinstance(v, str) else json.dumps(v)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return dt.datetime.fromisoformat(v)
    if isinstance(kind, T.BooleanType) and isinstance(v, bool):
        return v
    if isinstance(kind, (T.LongType, T.IntegerType)) and isinstance(v, int) and not isinstance(v, bool):
        return v
    if isinstance(kind, (T.DoubleType, T.FloatType)) and isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(v)
    raise ValueError(kind.simpleString())


def _rows(piece: Piece, schema: T.StructType) -> Iterator[tuple]:
    with open(piece.path, "rb") as f:
        f.seek(max(0, piece.start - 1))
        if piece.start and f.read(1) != b"\n":
            f.readline()  # the rest of a line that begins in the piece before
        while f.tell() < piece.end and (line := f.readline()):
            try:
                row = json.loads(line)
                yield tuple(_value(row.get(c.name), c.dataType) for c in schema.fields)
            except (ValueError, TypeError, AttributeError):
                continue


class _Batch(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.folder, self.chunk, self.column = schema, options["path"], int(options.get("chunk", CHUNK)), options.get("day_column")
        self.least, self.most = "", "9999"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            day = value.strftime("%Y-%m-%d") if hasattr(value, "strftime") else str(value)[:10]
            if self.column and getattr(f, "attribute", None) == (self.column,):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.least = max(self.least, day)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.most = min(self.most, day)
            yield f  # rows are tested by Spark; only files are left out here

    def partitions(self) -> Sequence[Piece]:
        days = ((p, m[1] if (m := _DAY.match(os.path.basename(p))) else None) for p in _files(self.folder))
        wanted = [p for p, day in days if day is None or self.least <= day <= self.most]
        return [x for p in wanted for x in _pieces(p, 0, os.path.getsize(p), self.chunk)] or [Piece(os.devnull, 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _rows(partition, self.schema)


class _Stream(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.folder, self.chunk = schema, options["path"], int(options.get("chunk", CHUNK))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: self._whole(p) for p in _files(self.folder)}

    def _whole(self, path: str) -> int:
        """Bytes up to the end of the last whole line."""
        with open(path, "rb") as f:
            at = f.seek(0, os.SEEK_END)
            while at:
                back = max(0, at - 65_536)
                f.seek(back)
                end = f.read(at - back).rfind(b"\n")
                if end >= 0:
                    return back + end + 1
                at = back
        return 0

    def partitions(self, start: dict, end: dict) -> Sequence[Piece]:
        return [x for p, to in sorted(end.items()) for x in _pieces(p, start.get(p, 0), to, self.chunk)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _rows(partition, self.schema)

    def commit(self, end: dict) -> None:
        """Nothing is kept beside the offsets."""


class AppendLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "append_log"

    def schema(self) -> str:
        raise ValueError("give the log's schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Batch(schema, self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Stream(schema, self.options)
