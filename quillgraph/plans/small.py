"""Queries: small operators of the inventory that no other query shows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as LB
from ..functions import split as SP
from ..functions import text as X
from ..operators import evaluate as E
from ..operators import schema as SC
from ..sources import files
from ..sources.views import edges, nodes, table
from .registry import register


@register("e6_composite_id", "SELECT o_orderkey, 'order:' || o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ':' || o_custkey END AS id FROM orders")
def e6_composite_id(spark, d):
    last = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", LB.composite_id(F.lit("order"), F.col("o_orderstatus"), last).alias("id"))


@register("e10_confidence", "SELECT p_partkey, CASE p_size % 3 WHEN 1 THEN 0.95 WHEN 2 THEN least(p_size / 50, 0.6) ELSE least(p_size / 50, 0.4) END::DOUBLE AS confidence FROM part")
def e10_confidence(spark, d):
    return table(spark, d, "part").select("p_partkey", LB.resolution_confidence(F.col("p_size") % 3, F.col("p_size") / 50).alias("confidence"))


@register("e20_file_names", r"""WITH t AS (SELECT c_custkey AS id, c_name || ': a/b?' || repeat('税é', (c_custkey % 60)::INT) || '  x ' AS name FROM customer),
c AS (SELECT id, trim(regexp_replace(regexp_replace(name, '[\\/:*?"<>|#^\[\]]', '_', 'g'), '\s+', ' ', 'g')) AS name FROM t)
SELECT id, list_max(list_filter(list_transform(range(0, length(name) + 1), lambda n: left(name, n::INT)), lambda x: octet_length(encode(x)) <= 240)) AS file FROM c""")  # fmt: skip
def e20_file_names(spark, d):
    n = (F.col("c_custkey") % 60).cast("int")
    name = F.concat("c_name", F.lit(": a/b?"), F.repeat(F.lit("税é"), n), F.lit("  x "))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), LB.safe_name(name).alias("file"))


@register("j29_document_links", """WITH d AS (SELECT page_id AS id, 'docs/' || (page_id % 7) || '/p' || page_id || '.md' AS path FROM pages), l AS (SELECT id, path, './p' || (id + 7) || '.md#top' AS target FROM d)
SELECT DISTINCT l.id AS src, d.id AS dst FROM l JOIN d ON d.path = 'docs/' || (l.id % 7) || '/p' || (l.id + 7) || '.md'""")  # fmt: skip
def j29_document_links(spark, d):
    k = F.col("page_id")
    docs = table(spark, d, "pages").select(k.alias("id"), F.concat(F.lit("docs/"), (k % 7).cast("string"), F.lit("/p"), k.cast("string"), F.lit(".md")).alias("path"))
    links = docs.withColumn("target", F.concat(F.lit("./p"), (F.col("id") + 7).cast("string"), F.lit(".md#top")))
    return E.document_links(links, docs)


@register("j30_parent_codes", "SELECT DISTINCT 'Nation:' || n_nationkey AS src, 'Region:' || n_regionkey AS dst, 'PART_OF' AS rel_type FROM nation")
def j30_parent_codes(spark, d):
    from ..operators.links import key_edges

    c = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    return key_edges(table(spark, d, "nation"), c("Nation:", "n_nationkey"), c("Region:", "n_regionkey"), "PART_OF")


@register("j31_clause_references", """WITH c AS (SELECT o_orderkey AS id, o_custkey AS reg, o_orderkey % 9 AS art, 'art' || (o_custkey % 9) || ';art' || (o_orderkey % 5) AS refs FROM orders),
last AS (SELECT reg, art, max(id) AS dst FROM c GROUP BY 1, 2), r AS (SELECT id, reg, unnest(string_split(refs, ';')) AS r FROM c)
SELECT DISTINCT r.id AS src, last.dst FROM r JOIN last ON last.reg = r.reg AND 'art' || last.art = r.r WHERE r.id <> last.dst""")  # fmt: skip
def j31_clause_references(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    refs = F.concat(F.lit("art"), (c % 9).cast("string"), F.lit(";art"), (k % 5).cast("string"))
    return E.clause_references(table(spark, d, "orders").select(k.alias("id"), c.alias("regulation_id"), (k % 9).alias("article_number"), refs.alias("referenced_clauses")))


@register("x23_contract", """WITH u(path) AS (VALUES ('/api/*'), ('/api/*/x'), ('/gone')), o(path) AS (VALUES ('/api/*'), ('/api/*/x'), ('/unused'))
SELECT path, CASE WHEN u.path IS NULL THEN 'unused' WHEN o.path IS NULL THEN 'missing' ELSE 'ok' END AS status FROM u FULL JOIN o USING (path)""")
def x23_contract(spark, d):
    t = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    return E.contract_diff(t("/api/:id", "/api/{id}", "/api/:id/x", "/gone"), t("/api/{n}", "/api/{n}/x", "/unused"))


_DECLARED = "CREATE NODE TABLE IF NOT EXISTS A(id STRING, n DECIMAL(10, 2), PRIMARY KEY (id));\nCREATE REL TABLE If_Any(FROM A TO B, w DOUBLE);\n\nCREATE NODE TABLE B(id STRING)"


@register("s5_declared_tables", "SELECT * FROM (VALUES ('NODE', 'A', 1, ['id', 'n']), ('REL', 'If_Any', 2, ['w']), ('NODE', 'B', 4, ['id'])) t(kind, name, line, columns)")
def s5_declared_tables(spark, d):
    rows = [(k, n, line, c) for k, n, line, c, _ in SC.parse_ddl(_DECLARED)]
    return spark.createDataFrame(rows, "kind string, name string, line int, columns array<string>")


@register("k16_ddl_gate", """WITH s(statement) AS (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'CREATE NODE TABLE A(id STRING)' WHEN 1 THEN 'ALTER TABLE Z ADD x STRING' WHEN 2 THEN 'DELETE ' || n_name ELSE 'drop table B' END FROM nation)
SELECT statement, CASE WHEN starts_with(statement, 'CREATE') THEN 'A' WHEN starts_with(statement, 'ALTER') THEN 'Z' WHEN starts_with(statement, 'drop') THEN 'B' ELSE '' END AS name,
 CASE WHEN starts_with(statement, 'DELETE') THEN 'forbidden' WHEN starts_with(statement, 'ALTER') THEN 'undeclared' ELSE 'ok' END AS verdict FROM s""")  # fmt: skip
def k16_ddl_gate(spark, d):
    k = F.col("n_nationkey") % 4
    s = F.when(k == 0, "CREATE NODE TABLE A(id STRING)").when(k == 1, "ALTER TABLE Z ADD x STRING").when(k == 2, F.concat(F.lit("DELETE "), "n_name")).otherwise("drop table B")
    return SC.ddl_gate(table(spark, d, "nation").select(s.alias("statement")), spark.createDataFrame([("A",), ("B",)], "name string"))


@register("f12_guarded", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 100")
def f12_guarded(spark, d):
    """A read-only statement gets a limit; the order makes it the same rows each time."""
    table(spark, d, "nation").createOrReplaceTempView("guarded_nation")
    return SC.guarded(spark, "SELECT n_nationkey, n_name FROM guarded_nation ORDER BY n_nationkey")


@register("s10_sheet_rates", """WITH l AS (SELECT p_brand AS sheet, p_partkey AS i, CASE WHEN p_size % 5 = 0 THEN 'Part ' || p_type ELSE p_name || ' ' || p_size || '.5%' END AS t, p_size % 5 = 0 AS head, p_name, p_size, p_type FROM part)
SELECT sheet, section, trim(p_name) AS item, (p_size + 0.5)::DOUBLE AS rate FROM (SELECT *, last_value(CASE WHEN head THEN t END IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM l) WHERE NOT head""")  # fmt: skip
def s10_sheet_rates(spark, d):
    t = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("Part "), "p_type")).otherwise(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(".5%")))
    lines = table(spark, d, "part").select(F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("i"), t.alias("t"))
    return files.sheet_rates(lines, "sheet", "i", "t")


@register("k14_notes", """WITH @NODES, @EDGES, l AS (SELECT src, string_agg(DISTINCT '- ' || rel_type || ' [[' || dst || ']]', chr(10) ORDER BY '- ' || rel_type || ' [[' || dst || ']]') AS links FROM edges GROUP BY 1)
SELECT id, concat_ws(chr(10) || chr(10), '# ' || coalesce(title, name, id), nullif(content, ''), links) AS text FROM nodes LEFT JOIN l ON src = id WHERE label IN ('Nation', 'Part', 'Region')""")  # fmt: skip
def k14_notes(spark, d):
    return files.markdown_notes(nodes(spark, d).filter(F.col("label").isin("Nation", "Part", "Region")), edges(spark, d))


@register("k15_graph_links", "WITH @EDGES SELECT 'link' AS kind, '{\"source\":\"' || src || '\",\"target\":\"' || dst || '\",\"type\":\"' || rel_type || '\"}' AS json FROM edges")
def k15_graph_links(spark, d):
    return files.graph_json(nodes(spark, d), edges(spark, d)).filter("kind = 'link'")


@register("s17_vectors_of_ids", "SELECT vec_id, len(embedding)::INT AS n FROM embeddings WHERE vec_id IN (SELECT o_custkey FROM orders)")
def s17_vectors_of_ids(spark, d):
    """A vector table's rows of a set of ids."""
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("vec_id")).distinct()
    return table(spark, d, "embeddings").join(ids, "vec_id", "left_semi").select("vec_id", F.size("embedding").alias("n"))


@register("x14_headings", r"""WITH t AS (SELECT doc_id, regexp_replace(text, '(?m)^([A-F])', repeat('#', (doc_id % 3 + 1)::INT) || ' \1', 'g') AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM t)
SELECT doc_id, line::INT AS line, length(regexp_extract(x, '^(#{1,6})\s+(.+)', 1))::INT AS level, regexp_extract(x, '^(#{1,6})\s+(.+)', 2) AS heading FROM l WHERE regexp_matches(x, '^#{1,6}\s+.+')""")  # fmt: skip
def x14_headings(spark, d):
    marks = F.repeat(F.lit("#"), (F.col("doc_id") % 3 + 1).cast("int"))
    marked = F.regexp_replace(F.col("text"), F.lit(r"(?m)^([A-F])"), F.concat(marks, F.lit(" $1")))
    return table(spark, d, "documents").select("doc_id", F.explode(X.markdown_headings(marked)).alias("h")).select("doc_id", "h.*")


@register("x21_added_lines", """WITH t AS (SELECT o_orderkey AS id FROM orders)
SELECT id, 'f' || id || '.py' AS file, 5 AS line, 'new ' || id AS added FROM t UNION ALL SELECT id, 'f' || id || '.py', 7, '' FROM t WHERE id % 2 = 0""")
def x21_added_lines(spark, d):
    k = F.col("o_orderkey").cast("string")
    more = F.when(F.col("o_orderkey") % 2 == 0, "+\n").otherwise("")
    diff = F.concat(F.lit("--- a/x\n+++ b/f"), k, F.lit(".py\t2024\n@@ -4,2 +4,4 @@ def\n same\n+new "), k, F.lit("\n-old\n same\n"), more)
    return SP.explode_with(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), diff.alias("t")), SP.added_lines, ["t"], "file string, line int, added string")


@register("w9_frames", """SELECT o_orderkey, ntile(4) OVER w AS quarter, sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING) > 1e6 AS rich, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near
FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)""")  # fmt: skip
def w9_frames(spark, d):
    w = Window.partitionBy("o_orderstatus").orderBy("o_orderkey")
    near = Window.partitionBy("o_orderstatus").orderBy("o_custkey").rangeBetween(-10, 10)
    rich = F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)) > 1e6
    return table(spark, d, "orders").select("o_orderkey", F.ntile(4).over(w).cast("long").alias("quarter"), rich.alias("rich"), F.count("*").over(near).alias("near"))


@register("q23_spread", "SELECT p_brand, min(p_size) AS least, max(p_size) AS most, round(stddev_samp(p_size), 6) AS spread, quantile_cont(p_size, 0.5) AS median FROM part GROUP BY CUBE (p_brand)")
def q23_spread(spark, d):
    return table(spark, d, "part").cube("p_brand").agg(F.min("p_size").alias("least"), F.max("p_size").alias("most"), F.round(F.stddev_samp("p_size"), 6).alias("spread"), F.percentile("p_size", F.lit(0.5)).alias("median"))


@register("u6_set_statements", """(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)""")
def u6_set_statements(spark, d):
    c, s, n = (table(spark, d, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    return c.intersect(s).unionByName(n.subtract(c))


@register("j36_shortest_paths", """WITH RECURSIVE @EDGES, walk(a, b, n) AS (SELECT src, dst, 1 FROM edges WHERE rel_type IN ('IN_NATION', 'IN_REGION') UNION SELECT w.a, e.dst, n + 1 FROM walk w JOIN edges e ON e.src = w.b WHERE e.rel_type IN ('IN_NATION', 'IN_REGION') AND n < 3)
SELECT a, b, min(n)::INT AS steps FROM walk GROUP BY 1, 2""")  # fmt: skip
def j36_shortest_paths(spark, d):
    """Patterns of one to three steps, at their shortest."""
    from ..operators.graph import shortest_paths

    return shortest_paths(edges(spark, d).filter(F.col("rel_type").isin("IN_NATION", "IN_REGION")), 3)


@register("x26_times", """SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 1 MONTH - INTERVAL 3 DAY)::DATE AS due, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::INT AS age, map_keys(MAP {'s': o_orderstatus, 'p': o_orderpriority}) AS keys FROM orders""")
def x26_times(spark, d):
    o = F.col("o_orderdate").cast("date")
    due = (o + F.expr("INTERVAL 1 MONTH") - F.expr("INTERVAL 3 DAY")).cast("date")
    keys = F.map_keys(F.create_map(F.lit("s"), "o_orderstatus", F.lit("p"), "o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", due.alias("due"), F.datediff(o, F.lit("1990-01-01").cast("date")).alias("age"), keys.alias("keys"))
