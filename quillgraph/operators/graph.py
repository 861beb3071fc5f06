"""Traversal: one-hop expansion, context, multi-hop joins, breadth-first impact, reasoning chains, communities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import display_label
from ..sources import views
from ..sources.scratch import pinned, scratch_path, written
from .ranks import in_order


def incident(edges: DataFrame) -> DataFrame:
    """node, direction, rel_type, other: each edge from both of its ends."""
    out = edges.select(F.col("src").alias("node"), F.lit("out").alias("direction"), "rel_type", F.col("dst").alias("other"))
    return out.unionByName(edges.select(F.col("dst").alias("node"), F.lit("in").alias("direction"), "rel_type", F.col("src").alias("other")))


def expand(nodes: DataFrame, at: DataFrame, backbone: list[str], limit: int = 100) -> DataFrame:
    """Neighbours of a node both ways, backbone relations first, at most `limit`. at: the node's incident edges."""
    named = at.join(nodes, F.col("other") == F.col("id"))
    first = F.when(F.col("rel_type").isin(backbone), 0).otherwise(1)
    w = Window.partitionBy("node").orderBy(first, "rel_type", "direction", "id")
    cols = ("direction", "rel_type", "id", "label", display_label("id", title="title", name="name", content="content").alias("display"))
    return named.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(*cols, F.col("rank").cast("long").alias("rank"))


def context(at: DataFrame) -> DataFrame:
    """Every relation of a node in both directions. at: the node's incident edges."""
    return at.select("direction", "rel_type", "other")


def seed_expansion(seeds: DataFrame, edges: DataFrame, per_side: int = 5, cap: int = 20) -> DataFrame:
    """Neighbours of ranked seeds (id, seed_rank), per_side each way and seed, each neighbour once, in seed order."""
    at = incident(edges).join(F.broadcast(seeds), F.col("node") == F.col("id")).drop("id")
    side = Window.partitionBy("node", "direction").orderBy("rel_type", "other")
    some = at.withColumn("k", F.row_number().over(side)).filter(F.col("k") <= per_side)
    way = F.when(F.col("direction") == "out", 0).otherwise(1)
    once = Window.partitionBy("other").orderBy("seed_rank", way, "k")
    first = some.withColumn("n", F.row_number().over(once)).filter("n = 1")
    return first.orderBy("seed_rank", way, "k", "other").limit(cap).select("node", "direction", "rel_type", "other")


#: Sources of a target that meet all its others in one group, about.
BLOCK = 1000


def v_pattern(edges: DataFrame, left: str, right: str, existing: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) with (a)-[left]->(t)<-[right]-(b), a < b, without existing pairs.

    A pair comes from the least of the targets that it shares, so that pairs, which may be many more than edges, are neither
    shuffled nor compared with each other. The sources of a large target are dealt over blocks, each of which meets all others."""

    def side(rel: str, name: str) -> DataFrame:
        ends = edges.filter((F.col("rel_type") == rel) & F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.col("src").alias(name), F.col("dst").alias("t")).distinct()
        several = ends.groupBy(name).agg(F.sort_array(F.collect_list("t")).alias(f"{name}_all")).filter(F.size(f"{name}_all") > 1)
        return ends.join(several, name, "left")  # null for the one target of most

    a, b = side(left, "a"), side(right, "b")
    sizes = a.groupBy("t").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    a = a.join(sizes, "t").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")).drop("blocks")
    b = b.join(sizes, "t").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    # few rows make many pairs: partitions by number of groups, which the size of the rows would merge
    parts = min(4096, max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * (sizes.agg(F.sum("blocks")).first()[0] or 0)))
    a, b = a.repartition(parts, "t", "block"), b.repartition(parts, "t", "block")
    once = F.col("a_all").isNull() | F.col("b_all").isNull() | (F.col("t") == F.array_min(F.array_intersect("a_all", "b_all")))
    pairs = a.join(b.hint("shuffle_merge"), ["t", "block"]).filter("a < b").filter(once).select("a", "b")
    return pairs if existing is None else pairs.join(existing, ["a", "b"], "left_anti")


def chain(edges: DataFrame, *steps: tuple[str, str]) -> DataFrame:
    """Distinct paths along typed steps ((rel_type, "out" or "in"), ...): columns n0, n1, ..."""
    out: DataFrame | None = None
    for i, (rel, way) in enumerate(steps):
        a, b = ("src", "dst") if way == "out" else ("dst", "src")
        step = edges.filter(F.col("rel_type") == rel).select(F.col(a).alias(f"n{i}"), F.col(b).alias(f"n{i + 1}"))
        out = step if out is None else out.join(step, f"n{i}")
    return out.select(*[f"n{i}" for i in range(len(steps) + 1)]).distinct()


def impact(edges: DataFrame, start: DataFrame, direction: str = "out", depth: int = 3) -> DataFrame:
    """Id, depth of everything reached from start (id) within `depth` steps, at its first depth.

    Level by level: the frontier joins the edges and loses what has been seen. depth is the API's bound, so the
    plan has that many joins and no driver loop over data."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    links = edges.select(F.col(a).alias("id"), F.col(b).alias("to"))
    seen = start.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        fresh = frontier.select("id").join(links, "id").select(F.col("to").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = fresh.withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def reasoning_chain(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Hop 1 both ways and hop 2 beyond it, without the root; one row with node_resolved = false if it is missing."""
    both = incident(edges)
    one = both.filter(F.col("node") == key).select(F.lit(1).alias("hop"), F.lit(key).alias("via"), "direction", "rel_type", F.col("other").alias("id"))
    two = one.select(F.col("id").alias("node")).distinct().join(both, "node").filter(F.col("other") != key)
    two = two.select(F.lit(2).alias("hop"), F.col("node").alias("via"), "direction", "rel_type", F.col("other").alias("id"))
    found = one.unionByName(two).withColumn("node_resolved", F.lit(True))
    here = nodes.filter(F.col("id") == key).agg((F.count("*") > 0).alias("resolved"))
    missing = here.filter("not resolved").select(F.lit(0).alias("hop"), F.lit(key).alias("via"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("string").alias("rel_type"), F.lit(None).cast("string").alias("id"), F.lit(False).alias("node_resolved"))
    return found.unionByName(missing)


#: step(start, labels, ways) gives the edges at some nodes and their others' labels, as views.incident_to does.
Step = Callable[[str | DataFrame, set[str] | None, tuple[str, ...]], tuple[DataFrame, set[str]]]


def impact_of(step: Step, key: str, direction: str = "out", depth: int = 3) -> DataFrame:
    """J7 from one node: each level reads only the tables that its labels are in, the first one by a pushed key."""
    label, _, number = key.partition(":")
    at, labels = step(key, None, (direction,))
    seen: DataFrame | None = None
    for level in range(1, depth + 1):
        fresh = at.select(F.col("other_label").alias("label"), F.col("other_key").alias("key")).distinct().filter(~((F.col("label") == label) & (F.col("key") == int(number))))
        fresh = fresh if seen is None else fresh.join(seen.select("label", "key"), ["label", "key"], "left_anti")
        found = fresh.withColumn("depth", F.lit(level))
        seen = found if seen is None else seen.unionByName(found)
        if level == depth or not labels:
            break
        at, labels = step(fresh, labels, (direction,))
    return seen.select(F.concat_ws(":", "label", F.col("key").cast("string")).alias("id"), "depth")


def reasoning_chain_of(node: DataFrame, step: Step, key: str) -> DataFrame:
    """J9 from one node of typed tables (its row, or none): as reasoning_chain, but it reads only tables that its labels are in."""
    at, labels = step(key, None, ("out", "in"))
    one = at.select(F.lit(1).alias("hop"), F.lit(key).alias("via"), "direction", "rel_type", F.col("other").alias("id"))
    beyond, _ = step(at.select(F.col("other_label").alias("label"), F.col("other_key").alias("key")).distinct(), labels, ("out", "in"))
    two = beyond.filter(F.col("other") != key).select(F.lit(2).alias("hop"), F.col("node").alias("via"), "direction", "rel_type", F.col("other").alias("id"))
    found = one.unionByName(two).withColumn("node_resolved", F.lit(True))
    here = node.agg((F.count("*") > 0).alias("resolved"))
    missing = here.filter("not resolved").select(F.lit(0).alias("hop"), F.lit(key).alias("via"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("string").alias("rel_type"), F.lit(None).cast("string").alias("id"), F.lit(False).alias("node_resolved"))
    return found.unionByName(missing)


def co_presence(edges: DataFrame, ids: DataFrame, per_rel: int = 1000) -> DataFrame:
    """Edges between two different members of ids (id), at most per_rel of a relation."""
    kept = edges.filter("src != dst").join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    w = Window.partitionBy("rel_type").orderBy("src", "dst")
    return kept.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_rel).select("src", "dst", "rel_type")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_anti")


def profile(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """Q21: (direction, rel_type, neighbour's label) counts of a label's nodes, with their share."""
    own = nodes.filter(F.col("label") == label).select(F.col("id").alias("node"))
    at = incident(edges).join(own, "node", "left_semi")
    other = F.split_part("other", F.lit(":"), F.lit(1))
    counts = at.groupBy("direction", "rel_type", other.alias("neighbour")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Id, community by synchronous label propagation over undirected links; the commonest label among a node's
    neighbours, the least one on ties; a node keeps its label until it has a neighbour. Deterministic.

    The edges are read once: links become pairs of numbers, given in the order of ids, in a written table by node. A round recounts
    only the nodes with a neighbour that has changed in the round before."""
    spark = edges.sparkSession
    raw = edges.select("src", "dst").filter("src != dst")
    ends = raw.select(F.col("src").alias("id")).union(raw.select("dst")).distinct()
    folder = scratch_path(spark, "links")
    ids = written(in_order(ends, ["id"], "n"), f"{folder}/ids")
    pairs = raw.join(ids.toDF("src", "a"), "src").join(ids.toDF("dst", "b"), "dst").select("a", "b")
    links = written(pairs.union(pairs.select("b", "a")).distinct().repartition("a"), f"{folder}/links")
    labels = pinned(ids.select("n", F.col("n").alias("label")))
    changed = labels.select("n")
    for k in range(rounds):
        # all nodes have a label of their own at first, so the first round asks for all
        open_ = links if k == 0 else links.join(links.join(changed.withColumnRenamed("n", "b"), "b", "left_semi").select("a").distinct(), "a", "left_semi")
        votes = open_.join(labels.toDF("b", "label"), "b").groupBy("a", "label").agg(F.count("*").alias("votes"))
        best = votes.groupBy(F.col("a").alias("n")).agg(F.min_by("label", F.struct(-F.col("votes"), "label")).alias("to"))
        after = pinned(labels.join(best, "n", "left").select("n", F.coalesce("to", "label").alias("label"), (F.col("to") != F.col("label")).alias("moved")))
        changed, labels = after.filter("moved").select("n"), after.select("n", "label")
        if not changed.limit(1).count():
            break
    named = ids.toDF("community", "label")
    return labels.join(ids, "n").join(named, "label").select("id", "community")


def shortest_paths(edges: DataFrame, depth: int) -> DataFrame:
    """A, b, steps of the shortest walk of 1 to `depth` steps; each level joins only pairs that are new. All pairs of a
    relation: for given ends use shortest_between."""
    links = edges.select(F.col("src").alias("b"), F.col("dst").alias("to")).distinct()
    level = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct().withColumn("steps", F.lit(1))
    seen = level
    for n in range(2, depth + 1):
        level = pinned(level.join(links, "b").select("a", F.col("to").alias("b")).distinct().join(seen.select("a", "b"), ["a", "b"], "left_anti").withColumn("steps", F.lit(n)))
        seen = seen.unionByName(level)
    return seen


def _spread(links: DataFrame, start: DataFrame, levels: int, include: bool) -> DataFrame:
    """root, at, steps: what is reached from each root (root, at) within `levels` steps, at its first one; roots with `include`."""
    seen = start.withColumn("steps", F.lit(0)) if include else None
    level = start
    for n in range(1, levels + 1):
        level = level.join(links, "at").select("root", F.col("to").alias("at")).distinct()
        if seen is not None:
            level = level.join(seen.select("root", "at"), ["root", "at"], "left_anti")
        level = pinned(level)
        found = level.withColumn("steps", F.lit(n))
        seen = found if seen is None else seen.unionByName(found)
    return seen


#: near(ids, end) gives src, dst, rel_type of the edges whose `end` ("src" or "dst") is among ids (id), as views.edges_at does; they may repeat.
Near = Callable[[DataFrame, str], DataFrame]


def _region(edges: DataFrame | Near, starts: DataFrame, ends: DataFrame, depth: int) -> DataFrame:
    """src, dst, rel_type: some of the edges, among them all those of walks of up to `depth` steps from starts (id) to ends (id).

    Nodes spread from both sides, a step at a time on the side whose next step has fewer edges, until the steps of both make up
    the depth: an edge of a walk starts near enough to the starts or else ends near enough to the ends. What is kept are edges of
    nodes so reached, each once, not the graph's. Of a step that may not be made edges are only estimated, by a sketch a task:
    repeats are told apart without a shuffle of rows."""

    def among(ids: DataFrame, end: str) -> DataFrame:
        wanted = ids.select(F.col("id").alias(end))
        return edges.join(F.broadcast(wanted) if ids.count() <= views.SMALL else wanted, end, "left_semi").select("src", "dst", "rel_type")

    near: Near = among if isinstance(edges, DataFrame) else edges
    sides = {}
    for end, roots in (("src", starts), ("dst", ends)):
        level = pinned(roots.select("id").filter("id IS NOT NULL").distinct())
        sides[end] = {"level": level, "seen": level, "found": None}

    def step(side: dict, end: str) -> None:
        side["edges"] = near(side["level"], end)
        side["cost"] = side["edges"].agg(F.approx_count_distinct(F.xxhash64("src", "dst", "rel_type"))).first()[0]  # 0 only if there are none

    for end, side in sides.items():
        step(side, end)
    for left in range(depth, 0, -1):
        end = min(sides, key=lambda e: sides[e]["cost"])
        side, other = sides[end], "dst" if end == "src" else "src"
        if not side["cost"]:
            break  # all that this side can reach has been reached
        links = pinned(side["edges"].distinct())
        side["found"] = links if side["found"] is None else side["found"].unionByName(links)
        side["level"] = pinned(links.select(F.col(other).alias("id")).distinct().join(side["seen"], "id", "left_anti"))
        side["seen"] = side["seen"].unionByName(side["level"])
        if left > 1:
            step(side, end)
    found = [side["found"] for side in sides.values() if side["found"] is not None]
    if not found:
        return sides["src"]["edges"]
    return found[0] if len(found) == 1 else pinned(found[0].unionByName(found[1]).distinct())


def shortest_between(edges: DataFrame | Near, starts: DataFrame, ends: DataFrame, depth: int) -> DataFrame:
    """A, b, steps of the shortest walk of 1 to `depth` steps from each of starts (id) to each of ends (id) that has one.

    edges: src, dst, rel_type, or a function that gives those at some nodes. Only edges that such walks can use are looked at (_region).
    Over these both sides spread over half the depth and meet in the middle: a pair of ends is only formed where their halves share a node."""
    links = _region(edges, starts, ends, depth).select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct()
    back = links.select(F.col("to").alias("at"), F.col("at").alias("to"))
    root = lambda df: df.select(F.col("id").alias("root"), F.col("id").alias("at")).distinct()
    ahead = _spread(links, root(starts), (depth + 1) // 2, False).toDF("a", "at", "x")
    behind = _spread(back, root(ends), depth // 2, True).toDF("b", "at", "y")
    return ahead.join(behind, "at").groupBy("a", "b").agg(F.min(F.col("x") + F.col("y")).alias("steps"))


def paths_between(edges: DataFrame | Near, starts: DataFrame, ends: DataFrame, depth: int) -> DataFrame:
    """A, b, steps, nodes, rels of every path of 1 to `depth` steps from starts (id) to ends (id) that uses no edge twice.

    edges: src, dst, rel_type, or a function that gives those at some nodes. Only edges that such paths can use are looked at (_region).
    Ends spread backwards first, nodes only: how few steps lead from a node to some end. Paths then grow from the starts, over nodes
    from which an end can still be reached in the steps that are left, so no path is built that must fail by its length."""
    links = _region(edges, starts, ends, depth).select(F.col("src").alias("at"), F.col("rel_type").alias("rel"), F.col("dst").alias("to")).distinct()
    links = pinned(links.withColumn("edge", F.struct("at", "rel", "to")))
    left = ends.select(F.col("id").alias("at")).distinct().withColumn("left", F.lit(0))
    level = left
    for n in range(1, depth):
        level = pinned(links.join(level.select(F.col("at").alias("to")), "to", "left_semi").select("at").distinct().join(left.select("at"), "at", "left_anti").withColumn("left", F.lit(n)))
        left = left.unionByName(level)
    left = pinned(left)
    nothing = F.array().cast("array<struct<at:string,rel:string,to:string>>")
    grown = starts.select(F.col("id").alias("a"), F.col("id").alias("at")).distinct().withColumn("edges", nothing)
    found = None
    for n in range(1, depth + 1):
        step = grown.join(links, "at").filter(~F.array_contains("edges", F.col("edge"))).select("a", F.col("to").alias("at"), F.array_append("edges", F.col("edge")).alias("edges"))
        grown = pinned(step.join(left.filter(F.col("left") <= depth - n).select("at"), "at", "left_semi"))
        here = grown.join(left.filter("left = 0").select("at"), "at", "left_semi").select("a", F.col("at").alias("b"), F.lit(n).alias("steps"), F.concat(F.array("a"), F.col("edges.to")).alias("nodes"), F.col("edges.rel").alias("rels"))
        found = here if found is None else found.unionByName(here)
    return found
