"""Writes as table expressions: gates, merges, migrations, change detection, append logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import is_blank, strip


def dedup_first(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The row with the least seq of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def insert_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """K2, K4: existing rows and those new ones whose key is not there yet."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """K3: new values win where they are not null."""
    a, b = existing.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return joined.select(*[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in existing.columns])


def overwrite_longer(existing: DataFrame, new: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """New text only where it is longer than the old one and has at least `least` characters."""
    n = new.select(F.col(key).alias("__k"), F.col(text).alias("__t"))
    better = (F.length("__t") >= least) & (F.length("__t") > F.coalesce(F.length(text), F.lit(0)))
    return existing.join(n, F.col(key) == F.col("__k"), "left").withColumn(text, F.when(better, F.col("__t")).otherwise(F.col(text))).select(*existing.columns)


def gate_reason(key: Column, title: Column, content: Column, exempt: Column, title_least: int = 2, content_least: int = 20) -> Column:
    """The first reason to reject a node, null for none."""
    t, c = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(content, F.lit("")))
    return (
        F.when(strip(F.coalesce(key, F.lit(""))) == "", "missing_id")
        .when(F.length(t) < title_least, "title_too_short")
        .when(~exempt & (F.length(c) < content_least), "content_too_short")
        .when(t.startswith("{'_id':") | t.startswith("{'offset':"), "title_is_raw_id")
    )


def gate_issues(key: Column, title: Column, content: Column, title_least: int = 5, content_least: int = 20) -> Column:
    """array<struct<severity, reason>> of everything that is wrong with a node."""
    t, c = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(content, F.lit("")))
    issue = lambda test, severity, reason: F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(reason).alias("reason")))
    return F.array_compact(F.array(
        issue(strip(F.coalesce(key, F.lit(""))) == "", "high", "missing_id"), issue(F.length(t) < title_least, "high", "title_too_short"),
        issue(F.length(c) < content_least, "medium", "content_too_short"), issue(t.startswith("{'_id':") | t.startswith("{'offset':"), "high", "title_is_raw_id"),
        issue(t.startswith("TRM_"), "medium", "title_is_code"),
    ))


def migrate(df: DataFrame, field_map: dict[str, tuple[str, str]]) -> DataFrame:
    """K6: new column from (old column, type); what cannot be cast, and null, becomes the type's empty value."""
    empty = {"string": F.lit(""), "bigint": F.lit(0), "double": F.lit(0.0), "boolean": F.lit(False)}
    return df.select(*[F.coalesce(F.col(old).try_cast(kind), empty[kind].cast(kind)).alias(new) for new, (old, kind) in field_map.items()])


def repair(df: DataFrame, column: str, bad: Column, value: Column) -> DataFrame:
    """K7: a column's value where a test holds."""
    return df.withColumn(column, F.when(F.coalesce(bad, F.lit(False)), value).otherwise(F.col(column)))


def rewire(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """K9: edges with ends replaced through (old, new), without repeats and without loops that this makes."""
    a, b = ids.toDF("__o1", "__n1"), ids.toDF("__o2", "__n2")
    e = edges.join(a, F.col("src") == F.col("__o1"), "left").join(b, F.col("dst") == F.col("__o2"), "left")
    src, dst = F.coalesce("__n1", "src"), F.coalesce("__n2", "dst")
    moved = F.col("__n1").isNotNull() | F.col("__n2").isNotNull()
    return e.filter(~(moved & (src == dst))).select(src.alias("src"), dst.alias("dst"), "rel_type").distinct()


def fold(parts: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Several tables as one, keys with each one's prefix."""
    out = None
    for prefix, df in parts:
        one = df.withColumn(key, F.concat(F.lit(prefix), F.col(key).cast("string")))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def lineage_merge(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str] = ("v1", "v2")) -> DataFrame:
    """Key, the other columns of either (the second wins), and which of the two had the row."""
    x, y = a.withColumn("__a", F.lit(names[0])).alias("x"), b.withColumn("__b", F.lit(names[1])).alias("y")
    j = x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full_outer")
    columns = list(dict.fromkeys([*a.columns, *b.columns]))
    pick = lambda c: F.coalesce(*[F.col(f"{s}.{c}") for s, d in (("y", b), ("x", a)) if c in d.columns]).alias(c)
    return j.select(*map(pick, columns), F.array_compact(F.array("__a", "__b")).alias("_lineage_present"))


def changed(docs: DataFrame, seen: DataFrame, key: str, text: str) -> DataFrame:
    """Z3: docs whose (key, hash of text) has not been seen; seen: key, hash."""
    d = docs.withColumn("hash", F.left(F.sha2(F.col(text), 256), F.lit(16)))
    return d.join(seen.select(key, "hash"), [key, "hash"], "left_anti")


def pending(docs: DataFrame, done: DataFrame, checkpoint: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys neither done nor checkpointed, the first `limit`."""
    return docs.select(key).join(done.select(key), key, "left_anti").join(checkpoint.select(key), key, "left_anti").orderBy(key).limit(limit)


def latest(log: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """Last record of each key; the first one of several at the same time."""
    w = Window.partitionBy(key).orderBy(F.desc(at), seq)
    return log.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def numbered_duplicates(df: DataFrame, keys: Sequence[str], order: str, base: Column) -> DataFrame:
    """Base, then base_dup1, base_dup2, ... for repeats of keys in order."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return df.withColumn("name", F.when(k == 0, base).otherwise(F.concat(base, F.lit("_dup"), k.cast("string"))))


def diverging(log: DataFrame, by: str, seq: str, sha: str, parent: str) -> DataFrame:
    """Rows whose parent is not the one before them; an empty parent starts anew."""
    w = Window.partitionBy(by).orderBy(seq)
    before = F.lag(sha).over(w)
    return log.withColumn("expected", before).filter(F.col("expected").isNotNull() & ~is_blank(F.col(parent)) & (F.col(parent) != F.col("expected")))


def triples(rows: DataFrame, kinds: dict[str, str], relations: dict[str, str]) -> DataFrame:
    """Edges from (subject, subject_kind, relation, object, object_kind); unmapped kinds and relations are dropped."""
    from .search import lookup

    k = lambda c: lookup(F.col(c), kinds, None)
    named = rows.select(k("subject_kind").alias("a"), k("object_kind").alias("b"), lookup(F.col("relation"), relations, None).alias("rel_type"), "subject", "object")
    named = named.filter("a IS NOT NULL AND b IS NOT NULL AND rel_type IS NOT NULL")
    return named.select(F.concat_ws(":", "a", "subject").alias("src"), F.concat_ws(":", "b", "object").alias("dst"), "rel_type").distinct()


def first_per_window(requests: DataFrame, by: str, at: str, key: str = "event_id", seconds: int = 60, most: int = 10) -> DataFrame:
    """Z2 over a finished log: whether each request is refused. A window starts with the first request after the
    previous window's end, which no fixed grid expresses: each partition walks its clients' requests in order, with one
    client's window as its only state."""
    rows = requests.select(F.col(by).alias("by"), F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"))

    def walk(batches):
        client, start, n = object(), 0, 0
        for p in batches:
            refused = []
            for c, t in zip(p["by"], p["t"]):
                if c != client or t - start > seconds * 1_000_000:
                    client, start, n = c, t, 0
                n += 1
                refused.append(n > most)
            yield p.assign(refused=refused)[["by", "key", "refused"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    walked = rows.repartition("by").sortWithinPartitions("by", "t", "key").mapInPandas(walk, f"by {kinds['by']}, key {kinds['key']}, refused boolean")
    return walked.toDF(by, key, "refused")


def delete_label(nodes: DataFrame, *labels: str) -> DataFrame:
    """K8: a graph's nodes without those of some labels; a table that is stored by label drops whole folders."""
    return nodes.filter(~F.col("label").isin(*labels))


def add_column(df: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    """K8: a new column with a default; an existing one of that name stays as it is."""
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(kind))


def reset_label(spark: SparkSession, schema: str) -> DataFrame:
    """K8: an empty table of a label's declared columns, to be written over the old one."""
    return spark.createDataFrame([], schema)
