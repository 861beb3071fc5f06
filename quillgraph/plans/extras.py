"""Queries: evaluation, subgraphs, parsers over the driver's texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import sections as TX
from ..operators.schema import rogue_bucket
from ..sources.views import edges, nodes, table
from .registry import register


@register("q17_score_cases", r"""WITH c AS (SELECT item_id AS id, left(text, 60) AS expected, 'Doc:' || left(text, 8) AS anchor FROM benchmark), a AS (SELECT c.id, expected, coalesce(max(d.text), '') AS answer, anchor FROM c LEFT JOIN documents d ON d.doc_id = c.id GROUP BY ALL),
w AS (SELECT id, answer, anchor, list_distinct(regexp_extract_all(expected, '[A-Za-z]{4,}')) AS words FROM a),
s AS (SELECT id, CASE WHEN contains(answer, replace(anchor, 'Doc:', '')) THEN 1.0 ELSE 0.0 END::DOUBLE AS ar, len(list_filter(words, lambda x: contains(answer, x))) / greatest(len(words), 1) AS ko FROM w)
SELECT id, round((ar + ko) / 3, 4) AS composite, round(ar, 4) AS anchor_recall, round(ko, 4) AS keyword_overlap, 0.0::DOUBLE AS source_citation FROM s""")  # fmt: skip
def q17_score_cases(spark, d):
    b = table(spark, d, "benchmark")
    cases = b.select(F.col("item_id").alias("id"), F.left("text", F.lit(60)).alias("expected_answer"), F.array(F.concat(F.lit("Doc:"), F.left("text", F.lit(8)))).alias("reasoning_anchors"), F.array().cast("array<string>").alias("sources"))
    answers = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"), F.array().cast("array<string>").alias("source_strings"))
    return E.score_cases(cases, answers)


@register("q18_averages", "SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))")
def q18_averages(spark, d):
    return E.averages(table(spark, d, "orders"), "o_totalprice", "o_orderstatus", "o_orderpriority")


@register("t11_type_subgraph", """WITH @NODES, @EDGES, first AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM nodes WHERE label = 'Supplier' QUALIFY k <= 100),
both_ways AS (SELECT src AS node, 'out' AS direction, rel_type, dst AS other FROM edges UNION ALL SELECT dst, 'in', rel_type, src FROM edges),
near AS (SELECT other FROM both_ways JOIN first ON node = id WHERE k <= 80 QUALIFY row_number() OVER (PARTITION BY node, direction ORDER BY rel_type, other) <= 10),
others AS (SELECT DISTINCT other AS id FROM near WHERE other NOT IN (SELECT id FROM first) ORDER BY id LIMIT 200), ids AS (SELECT id FROM first UNION SELECT id FROM others)
SELECT DISTINCT src, dst, rel_type FROM edges WHERE src <> dst AND src IN (FROM ids) AND dst IN (FROM ids)""")  # fmt: skip
def t11_type_subgraph(spark, d):
    return E.type_subgraph(nodes(spark, d), edges(spark, d), "Supplier")


@register("j22_rescue", """WITH @NODES, @EDGES, s AS (SELECT id FROM nodes WHERE label IN ('Customer', 'Region')), alone AS (SELECT id FROM s WHERE id NOT IN (SELECT src FROM edges WHERE src IN (FROM s) AND dst IN (FROM s) UNION SELECT dst FROM edges WHERE src IN (FROM s) AND dst IN (FROM s)) ORDER BY id LIMIT 50)
SELECT src, dst, rel_type FROM edges JOIN alone ON src = id QUALIFY row_number() OVER (PARTITION BY src ORDER BY rel_type, dst) <= 5""")  # fmt: skip
def j22_rescue(spark, d):
    n = nodes(spark, d)
    return E.rescue(n, edges(spark, d), n.filter(F.col("label").isin("Customer", "Region")))


@register("a12_metadata_composite", "SELECT p_type, count(*) AS sampled, round(least(count(*) FILTER (p_size > 25) / count(*) * 100 / 90 * 100, 100), 1) AS score FROM part GROUP BY 1")
def a12_metadata_composite(spark, d):
    return E.metadata_composite(table(spark, d, "part").withColumn("x", F.when(F.col("p_size") > 25, F.col("p_name"))), "p_type", ["x"])


@register("a16_short_sources", "WITH @NODES, @EDGES SELECT count(*) FILTER (coalesce(title, name) IS NULL OR length(coalesce(title, name)) < 5) AS unlabeled FROM edges JOIN nodes ON src = id WHERE rel_type = 'CONTAINS'")
def a16_short_sources(spark, d):
    return E.short_sources(nodes(spark, d), edges(spark, d), "CONTAINS")


@register("q16_rogue_buckets", "WITH @EDGES SELECT rel_type, CASE WHEN rel_type = 'CONTAINS' THEN 'code_analysis_residue' WHEN starts_with(rel_type, 'IN_') THEN 'legacy_prefixes' ELSE 'other' END AS bucket, count(*) AS n FROM edges GROUP BY 1, 2")
def q16_rogue_buckets(spark, d):
    b = rogue_bucket(F.col("rel_type"), {}, {"code_analysis_residue": ["CALLS_", "CONTAINS"], "legacy_prefixes": ["IN_", "FT_"]})
    return edges(spark, d).groupBy("rel_type", b.alias("bucket")).agg(F.count("*").alias("n"))


@register("x22_path_buckets", r"SELECT page_id, CASE WHEN regexp_matches(url, '\?page=') THEN 'paged' WHEN regexp_matches(url, '\.html$') THEN 'static' ELSE 'other' END AS bucket FROM pages")
def x22_path_buckets(spark, d):
    return table(spark, d, "pages").select("page_id", E.path_bucket(F.col("url"), [("paged", r"\?page="), ("static", r"\.html$")]).alias("bucket"))


@register("x10_title_terms", r"SELECT p_partkey, list_sort(list_distinct(list_filter(regexp_split_to_array(p_name, '\s+'), lambda w: length(w) >= 2))) AS terms FROM part")
def x10_title_terms(spark, d):
    from ..functions.text import title_terms

    return table(spark, d, "part").select("p_partkey", F.array_sort(title_terms(F.col("p_name"))).alias("terms"))


def _marked(spark, d):
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.when(x.rlike("^[A-Z]"), F.concat(F.repeat(F.lit("#"), F.length(x) % 4 + 1), F.lit(" "), x)).otherwise(x))
    return table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("t"))


@register("w5_sections", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT doc_id, i, CASE WHEN regexp_matches(x, '^[A-Z]') THEN repeat('#', (length(x) % 4 + 1)::INT) || ' ' || x ELSE x END AS x FROM l),
h AS (SELECT doc_id, i, length(regexp_extract(x, '^(#{1,6})\s+(.+)', 1)) AS level, len(regexp_extract_all(x, '\S+')) AS w FROM m),
n AS (SELECT a.doc_id, a.i, a.level, min(b.i) AS stop FROM h a LEFT JOIN h b ON b.doc_id = a.doc_id AND b.i > a.i AND b.level BETWEEN 1 AND a.level WHERE a.level > 0 GROUP BY ALL),
e AS (SELECT doc_id, max(i) AS last FROM h GROUP BY doc_id),
s AS (SELECT n.doc_id, n.i, n.level, coalesce(n.stop - 1, last) AS stop FROM n JOIN e USING (doc_id))
SELECT s.doc_id, (row_number() OVER (PARTITION BY s.doc_id ORDER BY s.i) - 1)::INT AS idx, s.level::INT AS level, s.i::INT AS start_line, s.stop::INT AS end_line, coalesce(sum(h.w), 0)::BIGINT AS words
FROM s LEFT JOIN h ON h.doc_id = s.doc_id AND h.i > s.i AND h.i <= s.stop GROUP BY s.doc_id, s.i, s.level, s.stop""")  # fmt: skip
def w5_sections(spark, d):
    """Sections of the documents, lines that begin with a capital taken as headings."""
    return TX.markdown_sections(_marked(spark, d), "doc_id", "t").select(F.col("key").alias("doc_id"), "idx", "level", "start_line", "end_line", "words")


_LAW = r"(?:^|\n)\s*第([0-9]+)条\s*"


@register("x6_clauses", rf"""WITH t AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: '第' || i || '条 ' || x), chr(10)) AS t FROM documents),
p AS (SELECT doc_id, regexp_extract_all(t, '{_LAW}', 1) AS n, regexp_split_to_array(t, '{_LAW}') AS b FROM t),
c AS (SELECT doc_id, unnest(n)::INT AS article, regexp_replace(unnest(b[len(b) - len(n) + 1:]), '^\s+|\s+$', '', 'g') AS body FROM p)
SELECT doc_id, article, least(length(body), 5000)::INT AS n FROM c WHERE length(body) >= 30 AND article > 0""")  # fmt: skip
def x6_clauses(spark, d):
    """Clauses of a law that is laid over the documents' lines."""
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("条 "), x)), "\n")
    found = TX.law_clauses(table(spark, d, "documents").select("doc_id", text.alias("t")), "doc_id", "t")
    return found.select(F.col("key").alias("doc_id"), "article", F.length("body").alias("n"))


@register("b14_journal_blocks", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT doc_id, i, trim(CASE WHEN regexp_matches(x, '^[AEIOU]') THEN '借：' || x WHEN length(x) % 5 = 0 THEN '' ELSE x END, E' \t\n\r') AS x FROM l),
g AS (SELECT *, regexp_matches(x, '^[借贷][：:]') AS entry, count(*) FILTER (x = '') OVER (PARTITION BY doc_id ORDER BY i) AS part FROM m),
f AS (SELECT *, min(i) FILTER (entry) OVER (PARTITION BY doc_id, part) AS first FROM g WHERE x <> '')
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1)::INT AS block, coalesce(max_by(length(x), i) FILTER (NOT entry AND i < first), 0)::INT AS title, count(*) FILTER (entry) AS lines FROM f WHERE first IS NOT NULL GROUP BY doc_id, part""")  # fmt: skip
def b14_journal_blocks(spark, d):
    """Blocks of the documents, lines that begin with a capital vowel taken as entries and those of a length that five divides as blank."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.when(x.rlike("^[AEIOU]"), F.concat(F.lit("借："), x)).when(F.length(x) % 5 == 0, "").otherwise(x))
    found = TX.journal_blocks(table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("t")), "doc_id", "t")
    return found.select(F.col("key").alias("doc_id"), "block", F.length("title").alias("title"), "lines")
