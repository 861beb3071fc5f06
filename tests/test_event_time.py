"""Event-time streams: late, repeated and unordered rows, and a restart from the checkpoint."""

import datetime as dt

import pytest

from quillgraph.streaming import event_time as T

DAY = dt.datetime(2024, 1, 1)


def at(s):
    return DAY + dt.timedelta(seconds=s)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, T.ROCKSDB)
    yield
    spark.conf.set(name, before)


def run(spark, made, out, cp):
    q = made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", cp).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def files(spark, folder, rows, schema):
    """A file a row group, read in the order of its name, one in a batch."""
    for k, some in enumerate(rows):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k:02d}")


def plain(rows, seconds, most):
    out, start, n = [], {}, {}
    for ip, i, t in sorted(set(rows), key=lambda r: (r[2], r[1])):
        if ip not in start or (t - start[ip]).total_seconds() > seconds:
            start[ip], n[ip] = t, 0
        n[ip] += 1
        out.append((ip, i, t, n[ip] > most))
    return sorted(out)


def test_rate_limit(spark, tmp_path, rocks):
    schema = "client_ip string, event_id long, ts timestamp"
    first = [("a", 1, at(0)), ("a", 3, at(20)), ("b", 4, at(5))]
    second = [("a", 2, at(10)), ("a", 3, at(20)), ("a", 5, at(61)), ("b", 6, at(90))]  # one out of order, one twice
    third = [("a", 7, at(400)), ("b", 8, at(401)), ("a", 9, at(300))]
    late = [("a", 10, at(15)), ("c", 11, at(2000))]  # the first is later than the watermark
    last = [("z", 12, at(9000))]
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    made = lambda: T.rate_limited(source(), most=2, late="2 minutes")
    files(spark, tmp_path / "in", [first, second], schema)
    run(spark, made(), str(tmp_path / "out"), str(tmp_path / "cp"))
    for k, some in enumerate([third, late, last], 2):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k:02d}")
        run(spark, made(), str(tmp_path / "out"), str(tmp_path / "cp"))  # each run goes on from the checkpoint
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == plain(first + second + third + late[1:], 60, 2)


def test_interval_join(spark, tmp_path):
    schema = "user string, id long, ts timestamp"
    left = [[("u", 1, at(0)), ("u", 2, at(300)), ("v", 3, at(100))], [("u", 2, at(300)), ("u", 4, at(50))], [("w", 5, at(20_000))]]
    right = [[("u", 10, at(550)), ("v", 11, at(90))], [("u", 12, at(60)), ("u", 10, at(550))], [("w", 13, at(20_000))]]
    files(spark, tmp_path / "l", left, schema)
    files(spark, tmp_path / "r", right, schema)
    read = lambda s: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / s))
    made = T.joined_within(read("l"), read("r"), "user", ("ts", "ts"), ("id", "id"), "10 seconds", "5 minutes", how="leftOuter")
    run(spark, made, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.l_key, r.r_key or 0) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:5] == [(1, 12), (2, 10), (3, 11), (4, 12), (5, 13)] and len(got) == 5
