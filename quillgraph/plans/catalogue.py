"""Queries: schema files, routes, title indexes, exports and Markdown over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions import split as SP
from ..functions import text as X
from ..operators import evaluate as E
from ..operators import ingest as I
from ..operators import links as L
from ..operators import schema as SC
from ..operators import search as S
from ..operators.graph import co_presence
from ..sources import files
from ..sources.scratch import scratch_path
from ..sources.views import edges, nodes, table
from .registry import register


@register("s5_schema_files", """WITH n AS (SELECT n_regionkey AS r, n_nationkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS line FROM nation)
SELECT r::INT AS region, CASE WHEN k % 3 = 0 THEN 'REL' ELSE 'NODE' END AS kind, 'T' || k AS name, line::INT AS line, CASE WHEN k % 3 = 0 THEN ['w'] ELSE ['id', 'n' || k] END AS columns FROM n""")  # fmt: skip
def s5_schema_files(spark, d):
    """Tables that schema files declare: a file a region, a statement a nation."""
    k = F.col("n_nationkey")
    name = F.concat(F.lit("T"), k.cast("string"))
    rel = F.concat(F.lit("CREATE REL TABLE IF NOT EXISTS "), name, F.lit("(FROM A TO B, w DOUBLE);"))
    node = F.concat(F.lit("create node table "), name, F.lit("(id STRING, n"), k.cast("string"), F.lit(" DECIMAL(10, 2), PRIMARY KEY (id));"))
    path = scratch_path(spark, "schema")
    lines = F.array_sort(F.collect_list(F.struct(k.alias("k"), F.when(k % 3 == 0, rel).otherwise(node).alias("t"))))
    table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("value")).write.partitionBy("n_regionkey").text(path)
    found = SC.ddl_file_tables(files.text_tree(spark, path, ["txt"]))
    return found.select(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int").alias("region"), "kind", "name", "line", "columns")


_PATH = r"regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '[0-9]+', '*', 'g')"


@register("x23_routes", f"""WITH u AS (SELECT DISTINCT {_PATH} AS path FROM pages), o AS (SELECT DISTINCT {_PATH} AS path FROM pages WHERE page_id % 3 = 0 UNION SELECT '/' || r_name || '/*' FROM region)
SELECT path, CASE WHEN u.path IS NULL THEN 'unused' WHEN o.path IS NULL THEN 'missing' ELSE 'ok' END AS status FROM u FULL JOIN o USING (path)""")  # fmt: skip
def x23_routes(spark, d):
    """Paths that pages use against routes that are offered: those of every third page, and one a region."""
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+", ""), "[?#].*$", "")
    used = table(spark, d, "pages").select(F.regexp_replace(bare, "[0-9]+", "{id}").alias("path"), "page_id")
    offered = used.filter("page_id % 3 = 0").select("path").union(table(spark, d, "region").select(F.concat(F.lit("/"), "r_name", F.lit("/:key"))))
    return E.contract_diff(used.select("path"), offered)


_NAMES = sorted({x for pair in (*D.STACKS_WITH, *D.EXCLUDES) for x in pair})
_LISTED = ", ".join(f"('{r}', '{a}', '{b}')" for r, pairs in (("STACKS_WITH", D.STACKS_WITH), ("EXCLUDES", D.EXCLUDES)) for a, b in pairs)
_INCENTIVES = "[" + ", ".join(f"'{x}'" for x in _NAMES) + "]"


@register("b5_claimed_pairs", f"""WITH p(rel_type, src, dst) AS (VALUES {_LISTED}), c AS (SELECT ({_INCENTIVES})[(o_orderkey % {len(_NAMES)} + 1)::INT] AS src, ({_INCENTIVES})[(o_custkey % {len(_NAMES)} + 1)::INT] AS dst FROM orders)
SELECT rel_type, src, dst, count(*) AS claims FROM c JOIN p USING (src, dst) GROUP BY ALL""")  # fmt: skip
def b5_claimed_pairs(spark, d):
    """How often two incentives that the rules relate are claimed together, one by an order and one by its customer."""
    names = F.array(*map(F.lit, _NAMES))
    pick = lambda c: F.element_at(names, (F.col(c) % len(_NAMES) + 1).cast("int"))
    rules = [(r, a, b) for r, pairs in (("STACKS_WITH", D.STACKS_WITH), ("EXCLUDES", D.EXCLUDES)) for a, b in pairs]
    claims = table(spark, d, "orders").groupBy(pick("o_orderkey").alias("src"), pick("o_custkey").alias("dst")).agg(F.count("*").alias("claims"))
    return claims.join(spark.createDataFrame(rules, "rel_type string, src string, dst string"), ["src", "dst"]).select("rel_type", "src", "dst", "claims")


@register("k8_reset_in_graph", "WITH @NODES SELECT label, count(*) FILTER (label <> 'Supplier') AS rows FROM nodes GROUP BY label")
def k8_reset_in_graph(spark, d):
    """Rows of each label after one of them was emptied and declared anew."""
    n = nodes(spark, d)
    fresh = I.reset_label(spark, "id string, label string, name string, title string, content string")
    left = I.delete_label(n, "Supplier").unionByName(fresh)
    return n.select("label").distinct().join(left.groupBy("label").agg(F.count("*").alias("rows")), "label", "left").select("label", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


@register("b3_title_index", """WITH t AS (SELECT p_partkey AS target, CASE WHEN p_partkey % 2 = 0 THEN 'Grand ' || p_name || ' ' || p_size ELSE p_name || ' ' || p_size END AS title FROM part),
i AS (SELECT name, arg_min(target, form * 1000000000 + target) AS target, min(form) AS form FROM (SELECT target, title AS name, 0 AS form FROM t UNION ALL SELECT target, replace(title, 'Grand ', ''), 1 FROM t) WHERE length(name) >= 4 GROUP BY name),
r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'Grand ' ELSE '' END || p_name || ' ' || (p_size + p_partkey % 2) AS ref FROM part)
SELECT id, ref, target, CASE form WHEN 0 THEN 'title' ELSE 'short' END AS form FROM r JOIN i ON ref = name""")  # fmt: skip
def b3_title_index(spark, d):
    """Names of parts against an index of titles, whole and without a prefix."""
    p = table(spark, d, "part")
    sized = lambda size: F.concat("p_name", F.lit(" "), size.cast("string"))
    grand = lambda when, c: F.concat(F.when(when, "Grand ").otherwise(""), c)
    titles = p.select(F.col("p_partkey").alias("target"), grand(F.col("p_partkey") % 2 == 0, sized(F.col("p_size"))).alias("title"))
    refs = p.select(F.col("p_partkey").alias("id"), grand(F.col("p_partkey") % 3 == 0, sized(F.col("p_size") + F.col("p_partkey") % 2)).alias("ref"))
    return L.title_lookup(refs, titles, "Grand ")


@register("b21_numbered_questions", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, (i % 1000)::INT AS number, length(trim(x, E' \t\n\r'))::INT AS n FROM l""")  # fmt: skip
def b21_numbered_questions(spark, d):
    """Questions of the documents, a line each, numbered in four forms."""
    def line(x, i):
        n = ((i + 1) % 1000).cast("string")
        mark = F.when(i % 4 == 0, F.concat(n, F.lit("、"))).when(i % 4 == 1, F.concat(F.lit("（ "), n, F.lit(" )"))).when(i % 4 == 2, F.concat(F.lit("第"), n, F.lit("题"))).otherwise(F.concat(n, F.lit("．")))
        return F.concat(mark, x)

    text = F.array_join(F.transform(F.split("text", "\n", -1), line), "\n")
    return table(spark, d, "documents").select("doc_id", F.explode(D.numbered_questions(text)).alias("q")).select("doc_id", "q.number", F.length("q.text").alias("n"))


@register("k14_manifest", r"SELECT doc_id, 'docs/' || source || '/' || doc_id || '.md' AS path, left(split_part(text, chr(10), 1), 80) AS title, len(string_split(text, chr(10)))::BIGINT AS lines, sha256(text) AS sha256 FROM documents")
def k14_manifest(spark, d):
    """A manifest of the documents, written as JSON lines and read back."""
    path = scratch_path(spark, "manifest")
    row = F.struct("doc_id", F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(80)).alias("title"), F.size(F.split("text", "\n", -1)).cast("long").alias("lines"), F.sha2("text", 256).alias("sha256"))
    files.append_manifest(table(spark, d, "documents").select(row.alias("r")).select("r.*"), path)
    return files.json_lines(spark, path, "doc_id long, path string, title string, lines long, sha256 string")


_RANK = "list_position(['Region', 'Nation', 'Supplier', 'Part'], label)"


@register("k15_sampled_graph", f"""WITH @NODES, @EDGES, r AS (SELECT id, label, name, {_RANK} AS r, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM nodes WHERE {_RANK} > 0), c AS (SELECT r, count(*) FILTER (label <> 'Part' OR k <= 20) AS n FROM r GROUP BY r),
b AS (SELECT r, coalesce(sum(n) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
s AS (SELECT id, label, name FROM r JOIN b USING (r) WHERE (label <> 'Part' OR k <= 20) AND before + k <= 200)
SELECT 'node' AS kind, '{{"id":"' || id || '","label":"' || label || '","name":"' || name || '"}}' AS json FROM s
UNION ALL SELECT 'link', '{{"source":"' || src || '","target":"' || dst || '","type":"' || rel_type || '"}}' FROM edges WHERE src <> dst AND src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)""")  # fmt: skip
def k15_sampled_graph(spark, d):
    """A graph export of nodes within a budget, labels in order, and the links between them."""
    n, e = nodes(spark, d), edges(spark, d)
    ids = S.budget_sample(n, ["Region", "Nation", "Supplier", "Part"], 200, ["Part"], cap=20).select("id")
    return files.graph_json(n.join(ids, "id", "left_semi"), co_presence(e, ids, per_rel=10**9))


@register("x14_links_and_topics", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, count(*) FILTER (i % 2 = 1) AS links, coalesce(sum(i) FILTER (i % 2 = 1), 0)::BIGINT AS targets, list_sort(list_distinct(coalesce(list(lower(trim(x, E' \t\n\r'))) FILTER (i % 2 = 0 AND i % 3 < 2 AND regexp_matches(x, '\S')), []))) AS topics FROM l GROUP BY doc_id""")  # fmt: skip
def x14_links_and_topics(spark, d):
    """Links and topics of the documents: odd lines get a link and an image, even ones are headings of one to three levels."""
    def line(x, i):
        link = F.concat(F.lit("![i](x.png) [to]("), (i + 1).cast("string"), F.lit(".md) "))
        return F.when(i % 2 == 0, link).otherwise(F.concat(F.repeat(F.lit("#"), (i + 1) % 3 + 1), F.lit(" "), x))

    text = F.array_join(F.transform(F.split("text", "\n", -1), line), "\n")
    rows = table(spark, d, "documents").select("doc_id", X.markdown_links(text).alias("links"), X.topics(X.markdown_headings(text)).alias("topics"))
    targets = F.aggregate("links", F.lit(0).cast("long"), lambda s, x: s + F.regexp_extract(x["target"], r"^(\d+)", 1).cast("long"))
    return rows.select("doc_id", F.size("links").cast("long").alias("links"), targets.alias("targets"), "topics")


@register("s17_vectors_whole", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x, i: x * i)), 4) AS weighed FROM embeddings WHERE vec_id IN (SELECT o_custkey FROM orders)")
def s17_vectors_whole(spark, d):
    """Components of the vectors of a set of ids, weighed by place."""
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("vec_id")).distinct()
    weighed = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").join(ids, "vec_id", "left_semi").select("vec_id", F.round(weighed, 4).alias("weighed"))


@register("j11_section_edges", "WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) SELECT doc_id || '_section_' || i AS src, doc_id::VARCHAR AS dst, 'PART_OF' AS rel_type FROM l")
def j11_section_edges(spark, d):
    """Sections of the documents, a line each, linked with what stands before `_section_` in their ids."""
    line = F.posexplode(F.split("text", "\n", -1)).alias("i", "line")
    sections = table(spark, d, "documents").select("doc_id", line).select(F.concat(F.col("doc_id").cast("string"), F.lit("_section_"), (F.col("i") + 1).cast("string")).alias("id"))
    return L.key_edges(sections, F.col("id"), F.split_part("id", F.lit("_section_"), F.lit(1)), "PART_OF")


@register("j18_heritage", """WITH s AS (SELECT p_brand AS name, 'Class:' || p_partkey AS dst, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, 'Class:' || p_partkey) AS k FROM part WHERE p_size % 2 = 0),
c AS (SELECT 'Class:c' || c_custkey AS src, CASE WHEN c_custkey % 4 = 0 THEN 'Outer' ELSE 'Brand#' || (c_nationkey % 5 + 1) || (c_custkey % 5 + 1) END AS name FROM customer)
SELECT DISTINCT src, name, coalesce(dst, 'external:' || name) AS dst, CASE WHEN n = 1 THEN 0.95 WHEN dst IS NOT NULL THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence FROM c LEFT JOIN (SELECT * FROM s WHERE k <= 2) USING (name)""")  # fmt: skip
def j18_heritage(spark, d):
    """Bases of classes against at most two classes of their name, else an external one."""
    classes = table(spark, d, "part").filter("p_size % 2 = 0").select(F.concat(F.lit("Class:"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("seq"))
    k = F.col("c_custkey")
    brand = F.concat(F.lit("Brand#"), (F.col("c_nationkey") % 5 + 1).cast("string"), (k % 5 + 1).cast("string"))
    bases = table(spark, d, "customer").select(F.concat(F.lit("Class:c"), k.cast("string")).alias("src"), F.when(k % 4 == 0, "Outer").otherwise(brand).alias("name"), F.lit(0.9).alias("confidence"))
    return L.resolve_names(bases, classes, most=2)


def _kept_lines(spark, d):
    """doc_id, lines that hold something, without white space around them."""
    bare = F.transform(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return table(spark, d, "documents").select("doc_id", F.filter(bare, lambda x: x != "").alias("l"))


_KEPT = r"""l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, count(*) OVER (PARTITION BY doc_id) AS of, sum(length(x)) OVER (PARTITION BY doc_id) AS chars FROM l WHERE x <> '')"""


@register("x7_numbered_sections", f"WITH {_KEPT} SELECT doc_id, n::INT AS article, least(length(x), 5000)::INT AS size FROM k WHERE of >= 3 AND n <= 200 AND length(x) >= 30")
def x7_numbered_sections(spark, d):
    """Numbered sections of texts without articles, a line each."""
    text = F.array_join(F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit("、 "), x)), "\n")
    found = SP.explode_with(_kept_lines(spark, d).select("doc_id", text.alias("t")), SP.split_clauses, ["t"], "article int, paragraph int, title string, body string, refs string")
    return found.select("doc_id", "article", F.length("body").alias("size"))


@register("x9_clause_parts", f"""WITH {_KEPT}, p AS (SELECT *, count(*) FILTER (length(x) >= 20) OVER (PARTITION BY doc_id) AS long FROM k)
SELECT doc_id, CASE WHEN n = 1 THEN '' ELSE '（一）' END AS number, length(x)::INT AS size, count(*) AS parts FROM p WHERE length(x) >= 20 AND long >= 2 AND chars + 3 * (of - 1) >= 100 GROUP BY ALL""")  # fmt: skip
def x9_clause_parts(spark, d):
    """Parts of clauses between marks, a line each."""
    found = SP.explode_with(_kept_lines(spark, d).select("doc_id", F.array_join("l", "（一）").alias("t")), SP.split_parts, ["t"], "number string, body string")
    return found.groupBy("doc_id", "number", F.length("body").alias("size")).agg(F.count("*").alias("parts"))


@register("x13_subject_cells", "SELECT p_partkey, p_brand || '费用' AS token, 'additive+alternative' AS kind FROM part UNION ALL SELECT p_partkey, 'C' || p_size || '费用', 'additive+alternative' FROM part UNION ALL SELECT p_partkey, replace(p_name, ' ', ''), 'additive' FROM part")
def x13_subject_cells(spark, d):
    """Cells in which two alternatives share a suffix and a third subject is added."""
    cell = F.concat("p_brand", F.lit("/C"), F.col("p_size").cast("string"), F.lit("费用 (x) + as_"), "p_name")
    return SP.explode_with(table(spark, d, "part").select("p_partkey", cell.alias("c")), SP.subjects, ["c"], "token string, kind string")
