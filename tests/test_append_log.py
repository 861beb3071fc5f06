"""The log source: ranges that cut lines, damaged lines, pushed days, and a stream that goes on while a file grows."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.sources import append_log
from quillgraph.sources.append_log import AppendLog

SCHEMA = "id long, day string, note string, value double"


@pytest.fixture(scope="module")
def source(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AppendLog)
    return spark


def line(i, day="2024-05-01", note="é中"):
    return json.dumps({"id": i, "day": day, "note": note, "value": i / 2, "more": [1]}, ensure_ascii=False) + "\n"


@pytest.mark.parametrize("chunk", [600, 1 << 20])
def test_batch(source, tmp_path, chunk):
    good = [line(i, note="x" * (i % 40)) for i in range(50)]
    bad = ["broken\n", "[1, 2]\n", "\n", '{"id": "text"}\n', '{"id": 1.5}\n']
    (tmp_path / "a.jsonl").write_text("".join(x + bad[i % 5] for i, x in enumerate(good)))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/b.jsonl").write_text(line(100) + '{"id": null}\n' + line(101).rstrip("\n"))
    (tmp_path / "c.txt").write_text(line(200))
    df = source.read.format("append_log").schema(SCHEMA).option("path", str(tmp_path)).option("chunk", chunk).load()
    got = sorted((-1 if r.id is None else r.id, r.value) for r in df.collect())
    assert got == sorted([(i, i / 2) for i in [*range(50), 100, 101]] + [(-1, None)])


@pytest.mark.parametrize("chunk", [1, 2, 7, 50])
def test_every_line_belongs_to_one_range(tmp_path, chunk):
    path = tmp_path / "a.jsonl"
    path.write_text("".join(line(i, note="é" * (i % 9)) + "\n" * (i % 3) for i in range(30)))
    schema = T.StructType([T.StructField("id", T.LongType())])
    pieces = append_log._pieces(str(path), 0, path.stat().st_size, chunk)
    assert [r[0] for p in pieces for r in append_log._rows(p, schema)] == list(range(30))


def test_days_that_a_filter_rules_out_are_not_opened(source, tmp_path):
    for day in range(1, 5):
        (tmp_path / f"2024-05-0{day}-x.jsonl").write_text(line(day, f"2024-05-0{day}"))
    (tmp_path / "2024-05-01-x.jsonl").chmod(0o000)
    (tmp_path / "other.jsonl").write_text(line(9, "2024-05-03") + line(10, "2024-01-01"))
    read = source.read.format("append_log").schema(SCHEMA).option("path", str(tmp_path)).option("day_column", "day").load()
    kept = read.filter((F.col("day") >= "2024-05-02") & (F.col("day") < "2024-05-04"))
    assert sorted(r.id for r in kept.collect()) == [2, 3, 9] and kept.rdd.getNumPartitions() == 4  # three days (the end's own day is opened) and the other file
    assert source.read.format("append_log").schema(SCHEMA).option("path", str(tmp_path / "none")).load().count() == 0


def test_stream_goes_on_from_its_offsets(source, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def run():
        stream = source.readStream.format("append_log").schema(SCHEMA).option("path", str(log)).option("chunk", 50).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert q.exception() is None
        return sorted(r.id for r in source.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect())

    (log / "a.jsonl").write_text("".join(line(i) for i in range(5)) + line(5)[:20])
    assert run() == [0, 1, 2, 3, 4]  # the sixth line is not whole yet
    with open(log / "a.jsonl", "a") as f:
        f.write(line(5)[20:] + line(6) + "broken\n")
    (log / "b.jsonl").write_text(line(7))
    assert run() == list(range(8))
    assert run() == list(range(8))
