"""Queries: scans, traversal, joins along the graph."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import display_label
from ..operators import graph as G
from ..sources.views import catalog, edges, edges_at, incident_to, label_scan, node_at, nodes, point_lookup, rel_scan
from .registry import register

_INCIDENT = """both_ways AS (SELECT src AS node, 'out' AS direction, rel_type, dst AS other FROM edges
 UNION ALL SELECT dst, 'in', rel_type, src FROM edges)"""
#: E1 in DuckDB over id, title, name, content.
_SHOWN = r"""CASE WHEN length(trim({0}, E' \t\n\r')) >= 2 AND NOT starts_with(trim({0}, E' \t\n\r'), '{{''_id'':') AND NOT regexp_matches(trim({0}, E' \t\n\r'), '^[0-9.\-%/]+$') AND NOT (length(trim({0}, E' \t\n\r')) <= 3) THEN left(trim({0}, E' \t\n\r'), 40) END"""
_DISPLAY = f"""coalesce({_SHOWN.format('title')}, {_SHOWN.format('name')},
 CASE WHEN length(trim(content, E' \\t\\n\\r')) >= 5 THEN left(trim(content, E' \\t\\n\\r'), 35) || '...' END,
 CASE WHEN length(id) > 12 THEN '...' || right(id, 8) ELSE id END)"""


@register("j1_expand", f"""WITH @NODES, @EDGES, {_INCIDENT}
SELECT direction, rel_type, id, label, {_DISPLAY} AS display,
 row_number() OVER (ORDER BY CASE WHEN rel_type = 'IN_REGION' THEN 0 ELSE 1 END, rel_type, direction, id) AS rank
FROM both_ways JOIN nodes ON other = id WHERE node = 'Nation:3' QUALIFY rank <= 100""")  # fmt: skip
def j1_expand(spark, d):
    at, labels = incident_to(spark, d, "Nation:3")
    return G.expand(nodes(spark, d).filter(F.col("label").isin(*labels)), at, ["IN_REGION"])


@register("s1_label_page", "WITH @NODES SELECT id, name, title FROM nodes WHERE label = 'Customer' ORDER BY id LIMIT 20 OFFSET 10")
def s1_label_page(spark, d):
    return label_scan(nodes(spark, d), "Customer").select("id", "name", "title").orderBy("id").offset(10).limit(20)


@register("s2_rel_scan", "WITH @EDGES SELECT src, dst FROM edges WHERE rel_type = 'PLACED'")
def s2_rel_scan(spark, d):
    return rel_scan(edges(spark, d), "PLACED").select("src", "dst")


@register("s4_catalog", "WITH @NODES, @EDGES SELECT label AS name, 'NODE' AS kind, count(*) AS rows FROM nodes GROUP BY 1 UNION ALL SELECT rel_type, 'REL', count(*) FROM edges GROUP BY 1")
def s4_catalog(spark, d):
    return catalog(nodes(spark, d), edges(spark, d))


@register("s18_point_lookup", "WITH @NODES SELECT id, label, name FROM nodes WHERE id = 'Part:7'")
def s18_point_lookup(spark, d):
    return point_lookup(nodes(spark, d), "Part:7", ["Customer", "Part"]).select("id", "label", "name")


@register("s18_typed_lookup", "WITH @NODES SELECT * FROM nodes WHERE id IN ('Part:7', 'Document:3', 'Order:1', 'Nation:x')")
def s18_typed_lookup(spark, d):
    """Nodes of four ids; one has no such key."""
    found = [node_at(spark, d, key) for key in ("Part:7", "Document:3", "Order:1", "Nation:x")]
    return reduce(DataFrame.unionByName, found)


@register("e1_display_label", f"WITH @NODES SELECT id, {_DISPLAY} AS display FROM nodes")
def e1_display_label(spark, d):
    return nodes(spark, d).select("id", display_label("id", title="title", name="name", content="content").alias("display"))


@register("j8_context", f"WITH @EDGES, {_INCIDENT} SELECT direction, rel_type, other FROM both_ways WHERE node = 'Customer:1'")
def j8_context(spark, d):
    return G.context(incident_to(spark, d, "Customer:1")[0])


@register("j3_seed_expansion", f"""WITH @NODES, @EDGES, {_INCIDENT},
seeds AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS seed_rank FROM nodes WHERE label = 'Nation' ORDER BY id LIMIT 5),
few AS (SELECT node, direction, rel_type, other, seed_rank, row_number() OVER (PARTITION BY node, direction ORDER BY rel_type, other) AS k FROM both_ways JOIN seeds ON node = id QUALIFY k <= 5),
once AS (SELECT *, row_number() OVER (PARTITION BY other ORDER BY seed_rank, CASE direction WHEN 'out' THEN 0 ELSE 1 END, k) AS n FROM few QUALIFY n = 1)
SELECT node, direction, rel_type, other FROM once ORDER BY seed_rank, CASE direction WHEN 'out' THEN 0 ELSE 1 END, k, other LIMIT 20""")  # fmt: skip
def j3_seed_expansion(spark, d):
    first = label_scan(nodes(spark, d), "Nation").select("id").orderBy("id").limit(5)
    from pyspark.sql import Window

    seeds = first.withColumn("seed_rank", F.row_number().over(Window.partitionBy().orderBy("id")) - 1)  # five rows
    return G.seed_expansion(seeds, edges(spark, d))


@register("j4_typed_pattern", """WITH @EDGES SELECT DISTINCT a.src AS n0, a.dst AS n1, b.src AS n2 FROM edges a JOIN edges b ON a.dst = b.dst WHERE a.rel_type = 'SUPPLIED_BY' AND b.rel_type = 'SUPPLIED_BY' AND a.src = 'Part:1'""")
def j4_typed_pattern(spark, d):
    return G.chain(edges(spark, d), ("SUPPLIED_BY", "out"), ("SUPPLIED_BY", "in")).filter("n0 = 'Part:1'")


@register("j5_v_pattern", """WITH @EDGES SELECT DISTINCT a.src AS a, b.src AS b FROM edges a JOIN edges b ON a.dst = b.dst AND a.src < b.src WHERE a.rel_type = 'IN_NATION' AND b.rel_type = 'IN_NATION' AND starts_with(a.src, 'Supplier') AND starts_with(b.src, 'Supplier')""")
def j5_v_pattern(spark, d):
    return G.v_pattern(edges(spark, d).filter(F.col("src").startswith("Supplier")), "IN_NATION", "IN_NATION")


@register("j6_chain", """WITH @EDGES SELECT DISTINCT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM edges a JOIN edges b ON a.dst = b.src WHERE a.rel_type = 'IN_NATION' AND b.rel_type = 'IN_REGION'""")
def j6_chain(spark, d):
    return G.chain(edges(spark, d), ("IN_NATION", "out"), ("IN_REGION", "out"))


@register("j7_impact", """WITH RECURSIVE @EDGES, walk(id, depth) AS (SELECT 'Customer:7', 0 UNION SELECT e.dst, depth + 1 FROM walk w JOIN edges e ON e.src = w.id WHERE depth < 3)
SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY id HAVING min(depth) > 0""")  # fmt: skip
def j7_impact(spark, d):
    return G.impact_of(partial(incident_to, spark, d), "Customer:7")


@register("j7_impact_upstream", """WITH RECURSIVE @EDGES, walk(id, depth) AS (SELECT 'Supplier:3', 0 UNION SELECT e.src, depth + 1 FROM walk w JOIN edges e ON e.dst = w.id WHERE depth < 2)
SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY id HAVING min(depth) > 0""")  # fmt: skip
def j7_impact_upstream(spark, d):
    return G.impact_of(partial(incident_to, spark, d), "Supplier:3", "in", 2)


@register("j9_reasoning_chain", f"""WITH @EDGES, {_INCIDENT},
one AS (SELECT 1 AS hop, 'Order:1' AS via, direction, rel_type, other AS id FROM both_ways WHERE node = 'Order:1'),
two AS (SELECT 2 AS hop, node AS via, direction, rel_type, other AS id FROM both_ways WHERE node IN (SELECT id FROM one) AND other <> 'Order:1')
SELECT *, true AS node_resolved FROM one UNION ALL SELECT *, true FROM two""")
def j9_reasoning_chain(spark, d):
    return G.reasoning_chain_of(node_at(spark, d, "Order:1"), partial(incident_to, spark, d), "Order:1")


@register("j9_reasoning_chain_missing", "SELECT 0 AS hop, 'Order:none' AS via, NULL::VARCHAR AS direction, NULL::VARCHAR AS rel_type, NULL::VARCHAR AS id, false AS node_resolved")
def j9_reasoning_chain_missing(spark, d):
    return G.reasoning_chain_of(node_at(spark, d, "Order:none"), partial(incident_to, spark, d), "Order:none")


@register("j21_co_presence", """WITH @NODES, @EDGES, ids AS (SELECT id FROM nodes WHERE label IN ('Nation', 'Region', 'Supplier'))
SELECT src, dst, rel_type FROM edges WHERE src <> dst AND src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)
QUALIFY row_number() OVER (PARTITION BY rel_type ORDER BY src, dst) <= 1000""")  # fmt: skip
def j21_co_presence(spark, d):
    return G.co_presence(edges(spark, d), nodes(spark, d).filter(F.col("label").isin("Nation", "Region", "Supplier")))


@register("a8_isolated", "WITH @NODES, @EDGES SELECT label, count(*) AS isolated FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges) GROUP BY label")
def a8_isolated(spark, d):
    return G.isolated(nodes(spark, d), edges(spark, d)).groupBy("label").agg(F.count("*").alias("isolated"))


@register("q21_edge_profile", f"""WITH @EDGES, {_INCIDENT}, c AS (SELECT direction, rel_type, split_part(other, ':', 1) AS neighbour, count(*) AS n FROM both_ways WHERE starts_with(node, 'Part:') GROUP BY ALL)
SELECT direction, rel_type, neighbour, n, round(n / sum(n) OVER (), 4) AS share FROM c""")
def q21_edge_profile(spark, d):
    return G.profile(nodes(spark, d), edges(spark, d), "Part")


_ROUND = """v{k} AS (SELECT a, label, count(*) AS n FROM links JOIN l{j} ON id = b GROUP BY a, label), l{k} AS MATERIALIZED (SELECT a AS id, label FROM v{k} QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, label) = 1)"""
_VOTES = ", ".join(_ROUND.format(j=k, k=k + 1) for k in range(10))


@register("x19_communities", f"""WITH @EDGES, few AS (SELECT src, dst FROM edges WHERE rel_type IN ('IN_NATION', 'IN_REGION') AND src <> dst), links AS (SELECT src AS a, dst AS b FROM few UNION SELECT dst, src FROM few),
l0 AS (SELECT DISTINCT a AS id, a AS label FROM links), {_VOTES} SELECT id, label AS community FROM l10""")  # fmt: skip
def x19_communities(spark, d):
    return G.communities(edges(spark, d).filter(F.col("rel_type").isin("IN_NATION", "IN_REGION")))


@register("j36_shortest_between", """WITH RECURSIVE @EDGES, walk(a, b, n) AS (SELECT src, dst, 1 FROM edges WHERE src IN ('Customer:1', 'Customer:2', 'Customer:5', 'Customer:8') UNION SELECT w.a, e.dst, n + 1 FROM walk w JOIN edges e ON e.src = w.b WHERE n < 5)
SELECT a, b, min(n)::INT AS steps FROM walk WHERE starts_with(b, 'Nation:') OR starts_with(b, 'Region:') GROUP BY 1, 2""")  # fmt: skip
def j36_shortest_between(spark, d):
    """From four customers to nations and regions, within five steps."""
    starts = spark.createDataFrame([(f"Customer:{k}",) for k in (1, 2, 5, 8)], "id string")
    ends = nodes(spark, d).filter(F.col("label").isin("Nation", "Region")).select("id")
    return G.shortest_between(partial(edges_at, spark, d), starts, ends, 5)


@register("j36_paths_between", """WITH RECURSIVE @EDGES, walk(a, b, n, nodes, rels) AS (SELECT src, dst, 1, [src, dst], [rel_type] FROM edges WHERE src IN ('Customer:1', 'Customer:2', 'Customer:5')
 UNION ALL SELECT a, dst, n + 1, list_append(nodes, dst), list_append(rels, rel_type) FROM walk JOIN edges ON src = b WHERE n < 4)
SELECT a, b, n::INT AS steps, nodes, rels FROM walk WHERE b IN ('Nation:1', 'Nation:2', 'Nation:3', 'Nation:4', 'Nation:5', 'Nation:6')""")  # fmt: skip
def j36_paths_between(spark, d):
    """All paths of up to four steps from three customers to six nations; no edge of these relations can come twice."""
    starts = spark.createDataFrame([(f"Customer:{k}",) for k in (1, 2, 5)], "id string")
    ends = spark.createDataFrame([(f"Nation:{k}",) for k in range(1, 7)], "id string")
    return G.paths_between(partial(edges_at, spark, d), starts, ends, 4)
