"""Property-graph views over the driver's tables, and scans of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the unified views.
NODE_COLUMNS = ("id", "label", "name", "title", "content")
EDGE_COLUMNS = ("src", "dst", "rel_type")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(label: str, key: str) -> Column:
    return F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))


def _nodes(df: DataFrame, label: str, key: str, name: Column | None = None, title: Column | None = None, content: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    pick = lambda c: null if c is None else c
    return df.select(node_id(label, key).alias("id"), F.lit(label).alias("label"), pick(name).alias("name"), pick(title).alias("title"), pick(content).alias("content"))


#: label: (table, key, name, title, content).
NODES = {
    "Region": ("region", "r_regionkey", "r_name", None, None),
    "Nation": ("nation", "n_nationkey", "n_name", None, None),
    "Customer": ("customer", "c_custkey", "c_name", "c_mktsegment", None),
    "Supplier": ("supplier", "s_suppkey", "s_name", None, None),
    "Part": ("part", "p_partkey", "p_name", "p_type", "p_brand"),
    "Order": ("orders", "o_orderkey", None, "o_orderpriority", "o_orderstatus"),
    "Document": ("documents", "doc_id", None, "left(split_part(text, '\n', 1), 80)", "text"),
}


def _labelled(spark: SparkSession, sf_dir: str, label: str, key: int | None = None) -> DataFrame:
    name, column, *fields = NODES[label]
    rows = table(spark, sf_dir, name)
    rows = rows if key is None else rows.filter(F.col(column) == key)
    return _nodes(rows, label, column, *[None if f is None else F.expr(f) for f in fields])


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, name, title, content of every node. A filter on label prunes the other tables' branches."""
    return reduce(DataFrame.unionByName, [_labelled(spark, sf_dir, label) for label in NODES])


def node_at(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """The node with this id, if there is one: only its label's table is read, and its key reaches the scan."""
    label, _, number = key.partition(":")
    if label not in NODES or not number.isdigit():
        return _labelled(spark, sf_dir, next(iter(NODES))).limit(0)
    return _labelled(spark, sf_dir, label, int(number)).limit(1)


#: (table, source, target, relation) of every edge; an end is (label, column). Rows of MANY repeat edges.
EDGES = (
    ("orders", ("Customer", "o_custkey"), ("Order", "o_orderkey"), "PLACED"),
    ("lineitem", ("Order", "l_orderkey"), ("Part", "l_partkey"), "CONTAINS"),
    ("lineitem", ("Part", "l_partkey"), ("Supplier", "l_suppkey"), "SUPPLIED_BY"),
    ("customer", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), "IN_NATION"),
    ("supplier", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), "IN_NATION"),
    ("nation", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), "IN_REGION"),
)
MANY = frozenset(("lineitem",))
#: Ids that are broadcast to find their edges, at most; more are shuffled.
SMALL = 100_000


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, rel_type of every edge. A filter on rel_type prunes the other branches."""
    parts = []
    for name, src, dst, rel in EDGES:
        ends = table(spark, sf_dir, name).select(src[1], dst[1])
        ends = ends.distinct() if name in MANY else ends
        parts.append(ends.select(node_id(*src).alias("src"), node_id(*dst).alias("dst"), F.lit(rel).alias("rel_type")))
    return reduce(DataFrame.unionByName, parts)


def incident_to(spark: SparkSession, sf_dir: str, start: str | DataFrame, labels: set[str] | None = None, ways: tuple[str, ...] = ("out", "in")) -> tuple[DataFrame, set[str]]:
    """(node, direction, rel_type, other, other_label, other_key of all edges at some nodes, the labels that others can have).

    start: one node's id, or a table (label, key) of nodes of these labels. Only tables that have such nodes at an end are
    read, each once for a label; one node's key is a filter on the table's own column, which reaches the scan."""
    one = start if isinstance(start, str) else None
    label_, _, key = one.partition(":") if one else ("", "", "")
    labels = {label_} if one else labels or set()
    by: dict[tuple[str, tuple[str, str]], list[tuple[str, str, tuple[str, str]]]] = {}
    for name, src, dst, rel in EDGES:
        for way, own, other in (("out", src, dst), ("in", dst, src)):
            if way in ways and own[0] in labels and (not one or key.isdigit()):
                by.setdefault((name, own), []).append((way, rel, other))
    parts = []
    for (name, (label, column)), targets in by.items():
        rows = table(spark, sf_dir, name).select(column, *{o[1] for _, _, o in targets})
        if one:
            rows = rows.filter(F.col(column) == int(key))
        else:
            rows = rows.join(start.filter(F.col("label") == label).select(F.col("key").alias(column)), column, "left_semi")
        each = F.array(*[F.struct(F.lit(way).alias("direction"), F.lit(rel).alias("rel_type"), F.lit(o[0]).alias("other_label"), F.col(o[1]).cast("long").alias("other_key")) for way, rel, o in targets])
        rows = rows.select(node_id(label, column).alias("node"), F.explode(each).alias("e")).select("node", "e.*")
        parts.append(rows.distinct() if name in MANY else rows)
    if not parts:
        empty = "node string, direction string, rel_type string, other_label string, other_key long, other string"
        return spark.createDataFrame([], empty), set()
    found = reduce(DataFrame.unionByName, parts).withColumn("other", F.concat_ws(":", "other_label", F.col("other_key").cast("string")))
    return found, {o[0] for targets in by.values() for _, _, o in targets}


def edges_at(spark: SparkSession, sf_dir: str, ids: DataFrame, end: str) -> DataFrame:
    """src, dst, rel_type of the edges whose `end` (src or dst) is among ids (id, a computed table). Rows of MANY repeat edges.

    Only tables that have such labels at that end are read, and their own columns meet the ids before anything is built of them. Ids of a
    label are broadcast up to SMALL, so that the table's rows are not shuffled; whether they are does not depend on the other labels' ids."""
    label, key = F.split_part("id", F.lit(":"), F.lit(1)), F.split_part("id", F.lit(":"), F.lit(2))
    sizes = {r[0]: r[1] for r in ids.groupBy(label).agg(F.count("*")).collect()}  # one for a kind of node
    parts = [ids.limit(0).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("").alias("rel_type"))]
    for name, src, dst, rel in EDGES:
        own = src if end == "src" else dst
        if own[0] in sizes:
            number = key.try_cast("long")
            wanted = ids.filter((label == own[0]) & (F.concat(F.lit(f"{own[0]}:"), number.cast("string")) == F.col("id"))).select(number.alias(own[1]))
            rows = table(spark, sf_dir, name).select(src[1], dst[1]).join(F.broadcast(wanted) if sizes[own[0]] <= SMALL else wanted, own[1], "left_semi")
            parts.append(rows.select(node_id(*src).alias("src"), node_id(*dst).alias("dst"), F.lit(rel).alias("rel_type")))
    return reduce(DataFrame.unionByName, parts)


def label_scan(nodes: DataFrame, label: str) -> DataFrame:
    """S1."""
    return nodes.filter(F.col("label") == label)


def rel_scan(edges: DataFrame, rel: str) -> DataFrame:
    """S2."""
    return edges.filter(F.col("rel_type") == rel)


def point_lookup(nodes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The node with this id; if several labels have it, the first in `order`."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("label"))
    return nodes.filter(F.col("id") == key).orderBy(F.when(rank == 0, len(order) + 1).otherwise(rank), "label").limit(1)


def catalog(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Name, kind (NODE or REL) and rows of every table of the graph."""
    n = nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("rows")).withColumn("kind", F.lit("NODE"))
    e = edges.groupBy(F.col("rel_type").alias("name")).agg(F.count("*").alias("rows")).withColumn("kind", F.lit("REL"))
    return n.unionByName(e)
