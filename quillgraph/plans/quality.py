"""Queries: coverage, scores, survey, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import quality as Q
from ..sources.views import catalog, edges, nodes, table
from .registry import register

_COVERAGE = """cov AS (SELECT label, count(*) AS total, greatest(count(*) FILTER (length(title) >= 2), count(*) FILTER (length(name) >= 2), 0) AS with_title FROM nodes GROUP BY label)"""


@register("a1_counts", "WITH @NODES, @EDGES SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY rel_type")
def a1_counts(spark, d):
    n = nodes(spark, d).groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("node"))
    return n.unionByName(edges(spark, d).groupBy(F.col("rel_type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge")))


@register("a2_group_top", "SELECT o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, key LIMIT 3")
def a2_group_top(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(3)


@register("a4_title_coverage", f"WITH @NODES, {_COVERAGE} SELECT label, total, with_title, round(with_title / total, 3) AS coverage, CASE WHEN round(with_title / total, 3) < 0.5 THEN 'high' WHEN round(with_title / total, 3) < 0.95 THEN 'medium' END AS severity FROM cov")
def a4_title_coverage(spark, d):
    return Q.title_coverage(nodes(spark, d), ["title", "name"])


_SCORE = f"""{_COVERAGE},
con AS (SELECT label, count(*) FILTER (length(content) >= 20) AS c FROM nodes GROUP BY label),
m AS (SELECT sum(total)::BIGINT AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, round(sum(with_title) / sum(total), 3) AS title_coverage,
 round((SELECT sum(c) FROM con) / sum(total), 3) AS content_coverage, round((SELECT count(*) FROM edges) / sum(total), 3) AS density FROM cov),
sc AS (SELECT *, greatest(0, round(100 - greatest(0, (0.95 - title_coverage) * 100) - greatest(0, (0.5 - density) * 50)))::BIGINT AS score FROM m)"""


@register("a6_graph_score", f"WITH @NODES, @EDGES, {_SCORE} SELECT *, CASE WHEN score >= 60 THEN 'PASS' ELSE 'FAIL' END AS gate FROM sc")
def a6_graph_score(spark, d):
    return Q.graph_score(nodes(spark, d), edges(spark, d), ["title", "name"], ["content"])


@register("a7_score_variant", f"""WITH @NODES, @EDGES, {_SCORE},
iso AS (SELECT count(*) AS isolated FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)),
hi AS (SELECT count(*) AS high_issues FROM cov WHERE round(with_title / total, 3) < 0.5),
v AS (SELECT total_nodes, total_edges, title_coverage, content_coverage, density, greatest(0, round(score - least(20, isolated / total_nodes * 200)))::BIGINT AS score, isolated, high_issues FROM sc, iso, hi)
SELECT *, CASE WHEN score >= 60 AND high_issues = 0 THEN 'PASS' ELSE 'FAIL' END AS gate FROM v""")  # fmt: skip
def a7_score_variant(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    return Q.score_variant(Q.graph_score(n, e, ["title", "name"], ["content"]), G.isolated(n, e), Q.title_coverage(n, ["title", "name"]).filter("severity = 'high'"))


@register("a9_length_histogram", "SELECT lang, count(*) FILTER (length(text) < 5) AS empty, count(*) FILTER (length(text) BETWEEN 5 AND 49) AS short, count(*) FILTER (length(text) BETWEEN 50 AND 199) AS medium, count(*) FILTER (length(text) BETWEEN 200 AND 499) AS good, count(*) FILTER (length(text) >= 500) AS rich FROM documents GROUP BY lang")
def a9_length_histogram(spark, d):
    return Q.length_histogram(table(spark, d, "documents"), ["lang"], "text")


@register("a10_text_composite", """WITH a AS (SELECT source, count(*) AS sampled, count(*) FILTER (length(text) < 5) AS empty, count(*) FILTER (length(text) BETWEEN 50 AND 199) AS medium,
 count(*) FILTER (length(text) BETWEEN 200 AND 499) AS good, count(*) FILTER (length(text) >= 500) AS rich, count(*) FILTER (length(text) >= 20 AND NOT contains(text, '!!')) AS real,
 count(*) FILTER (length(text) >= 20 AND contains(text, '!!')) AS junk, count(*) FILTER (contains(text, 'the')::INT + contains(text, 'und')::INT + contains(text, 'de ')::INT >= 2) AS domain,
 count(DISTINCT CASE WHEN length(text) >= 20 THEN left(text, 100) END) AS "unique" FROM documents GROUP BY source),
s AS (SELECT *, round((medium + good * 2 + rich * 3) / (sampled * 3) * 30 + least(CASE WHEN sampled > empty THEN real / (sampled - empty) * 100 ELSE 0 END / 80 * 20, 20) + least(domain / sampled * 100 / 80 * 25, 25) + least("unique" / sampled * 100 / 90 * 15, 15) + (sampled - empty) / sampled * 100 / 100 * 10, 1) AS score,
 round(CASE WHEN sampled > empty THEN junk / (sampled - empty) * 100 ELSE 0 END, 1) AS junk_pct FROM a)
SELECT *, CASE WHEN score >= 70 AND junk_pct <= 50 THEN 'PASS' ELSE 'FAIL' END AS gate FROM s""")  # fmt: skip
def a10_text_composite(spark, d):
    return Q.text_composite(table(spark, d, "documents"), "source", "text", ["the", "und", "de "], F.col("text").contains("!!"))


@register("a11_structured_composite", """WITH a AS (SELECT c_mktsegment, count(*) AS sampled, count(*) FILTER (length(trim(c_name)) >= 1 AND c_nationkey IS NOT NULL) AS complete, count(DISTINCT left(c_name, 30) || '|' || left(c_nationkey::VARCHAR, 30)) AS "unique", count(*) FILTER (length(trim(c_name)) >= 1 OR c_nationkey IS NOT NULL) AS filled FROM customer GROUP BY 1)
SELECT *, round(least(complete / sampled * 100 / 90 * 60, 60) + least("unique" / sampled * 100 / 90 * 30, 30) + filled / sampled * 10, 1) AS score FROM a""")  # fmt: skip
def a11_structured_composite(spark, d):
    return Q.structured_composite(table(spark, d, "customer"), "c_mktsegment", ["c_name", "c_nationkey"])


@register("a14_overall", """WITH a AS (SELECT c_mktsegment, count(*) AS sampled, count(DISTINCT left(c_name, 30)) AS u FROM customer GROUP BY 1), s AS (SELECT sampled, round(60 + least(u / sampled * 100 / 90 * 30, 30) + 10, 1) AS score FROM a)
SELECT round(sum(score * sampled) FILTER (score > 0) / sum(sampled) FILTER (score > 0), 1) AS score, count(*) FILTER (score < 70) AS failing, CASE WHEN round(sum(score * sampled) FILTER (score > 0) / sum(sampled) FILTER (score > 0), 1) >= 70 AND count(*) FILTER (score < 70) = 0 THEN 'PASS' ELSE 'FAIL' END AS gate FROM s""")  # fmt: skip
def a14_overall(spark, d):
    return Q.overall(Q.structured_composite(table(spark, d, "customer"), "c_mktsegment", ["c_name"]))


#: A lineage envelope over orders: label, id and the survey's columns.
_LINEAGE = """lineage AS (SELECT o_orderstatus AS label, 'o' || (o_orderkey % 997) AS id, strftime(o_orderdate, '%Y-%m-%d') AS effective_from,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE '0.5' END AS confidence, CASE WHEN o_orderkey % 11 = 0 THEN ' Unknown' ELSE 'doc' || o_orderkey END AS source_doc_id, 'extractor' AS extracted_by,
 CASE WHEN o_orderkey % 3 = 0 THEN 'x' END AS reviewed_at, CASE WHEN o_orderkey % 4 = 0 THEN 'y' END AS reviewed_by,
 CASE WHEN o_orderkey % 2 = 0 THEN 'CN' WHEN o_orderkey % 13 = 0 THEN 'CN-31' END AS jurisdiction_code, CASE WHEN o_orderkey % 2 = 1 THEN 'national' WHEN o_orderkey % 17 = 0 THEN 'galactic' END AS jurisdiction_scope,
 CASE WHEN o_orderkey % 19 = 0 THEN 'FR-75' WHEN o_orderkey % 23 = 0 THEN 'CN-HK' END AS override_chain_id, CASE WHEN o_orderkey % 29 = 0 THEN 'analogy' END AS argument_role FROM orders)"""

_SURVEY = _LINEAGE + """, one AS (SELECT label, count(*) AS sampled, count(*) - count(DISTINCT id) - max((id IS NULL)::INT) AS duplicates,
 count(*) FILTER (date_diff('day', effective_from::DATE, DATE '2024-06-01') > 3650) AS stale, count(*) FILTER ((coalesce(reviewed_at, '') = '') <> (coalesce(reviewed_by, '') = '')) AS integrity_violations,
 count(*) FILTER (CASE WHEN coalesce(jurisdiction_scope, '') <> '' AND jurisdiction_scope NOT IN ('national', 'subnational', 'municipal', 'experimental_zone', 'trade_port', 'special_economic_zone') THEN true ELSE (coalesce(jurisdiction_code, '') = '') <> (coalesce(jurisdiction_scope, '') = '') END) AS jurisdiction_mismatches,
 count(*) FILTER (lower(trim(source_doc_id)) = 'unknown') AS placeholder_strings, count(*) FILTER (argument_role = 'analogy') AS prohibited_role, count(*) FILTER (override_chain_id = 'FR-75') AS invalid_chain,
 count(*) FILTER ((jurisdiction_code = 'CN' AND jurisdiction_scope <> 'national') OR (jurisdiction_code = 'CN-31' AND jurisdiction_scope <> 'subnational')) AS inconsistent_scope,
 round(avg((coalesce(effective_from, '') = '')::INT), 4) AS null_effective_from, round(avg((coalesce(confidence, '') = '')::INT), 4) AS null_confidence, round(avg((coalesce(source_doc_id, '') = '')::INT), 4) AS null_source_doc_id,
 round(avg((coalesce(jurisdiction_code, '') = '')::INT), 4) AS null_jurisdiction_code, round(avg((coalesce(jurisdiction_scope, '') = '')::INT), 4) AS null_jurisdiction_scope FROM lineage GROUP BY label),
two AS (SELECT *, (null_effective_from >= 0.5)::BIGINT + (null_confidence >= 0.5)::BIGINT + (null_source_doc_id >= 0.5)::BIGINT + (null_jurisdiction_code >= 0.5)::BIGINT + (null_jurisdiction_scope >= 0.5)::BIGINT AS null_coverage_violations FROM one),
three AS (SELECT *, duplicates + stale + integrity_violations + jurisdiction_mismatches + null_coverage_violations + placeholder_strings + prohibited_role + invalid_chain + inconsistent_scope AS defects_total FROM two),
four AS (SELECT *, round(defects_total / sampled, 4) AS defect_rate FROM three)"""


def _lineage(spark, d):
    k = F.col("o_orderkey")
    when = lambda m, v, eq=0: F.when(k % m == eq, v)
    return table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("label"), F.concat(F.lit("o"), (k % 997).cast("string")).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective_from"),
        F.when(k % 7 != 0, "0.5").alias("confidence"), when(11, " Unknown").otherwise(F.concat(F.lit("doc"), k.cast("string"))).alias("source_doc_id"), F.lit("extractor").alias("extracted_by"),
        when(3, "x").alias("reviewed_at"), when(4, "y").alias("reviewed_by"), when(2, "CN").when(k % 13 == 0, "CN-31").alias("jurisdiction_code"),
        when(2, "national", 1).when(k % 17 == 0, "galactic").alias("jurisdiction_scope"), when(19, "FR-75").when(k % 23 == 0, "CN-HK").alias("override_chain_id"), when(29, "analogy").alias("argument_role"),
    )


@register("q12_survey", f"WITH {_SURVEY} SELECT *, CASE WHEN defect_rate <= 0.1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM four")
def q12_survey(spark, d):
    return Q.survey(_lineage(spark, d), "2024-06-01", sample=None)


@register("q12_survey_total", f"""WITH {_SURVEY}, t AS (SELECT count(*) AS labels, sum(sampled)::BIGINT AS sampled, sum(defects_total)::BIGINT AS defects_total FROM four)
SELECT *, round(defects_total / sampled, 4) AS defect_rate, CASE WHEN round(defects_total / sampled, 4) <= 0.1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM t""")  # fmt: skip
def q12_survey_total(spark, d):
    return Q.survey_total(Q.survey(_lineage(spark, d), "2024-06-01", sample=None))


@register("q13_min_rows", """WITH @NODES, can(name) AS (VALUES ('Region'), ('Nation'), ('Customer'), ('Order'), ('Ghost')), cnt AS (SELECT label AS name, count(*) AS rows FROM nodes GROUP BY 1), th(name, min_rows) AS (VALUES ('Nation', 25), ('Region', 10))
SELECT c.name, coalesce(rows, 0) AS rows, coalesce(min_rows, 1000)::BIGINT AS threshold, coalesce(rows, 0) >= coalesce(min_rows, 1000) AS passes, CASE WHEN coalesce(rows, 0) = 0 THEN 'empty' WHEN rows < 50 THEN 'tiny' WHEN rows < 500 THEN 'small' ELSE 'ok' END AS tier FROM can c LEFT JOIN cnt USING (name) LEFT JOIN th USING (name)""")  # fmt: skip
def q13_min_rows(spark, d):
    return Q.min_rows(_canonical(spark), _counts(spark, d), spark.sql("SELECT * FROM VALUES ('Nation', 25), ('Region', 10) AS t(name, min_rows)"))


def _canonical(spark):
    return spark.sql("SELECT * FROM VALUES ('Region'), ('Nation'), ('Customer'), ('Order'), ('Ghost') AS t(name)")


def _counts(spark, d):
    return nodes(spark, d).groupBy(F.col("label").alias("name")).agg(F.count("*").alias("rows"))


@register("q14_ontology_gate", """WITH @NODES, can(name) AS (VALUES ('Region'), ('Nation'), ('Customer'), ('Order'), ('Ghost')), live AS (SELECT label AS name, count(*) AS rows FROM nodes GROUP BY 1),
f AS (SELECT l.name AS l, c.name AS c, rows FROM live l FULL JOIN can c ON l.name = c.name),
s AS (SELECT count(*) FILTER (c IS NULL) AS rogue, count(*) FILTER (l IS NULL) AS missing, count(*) FILTER (l IS NOT NULL AND c IS NOT NULL) AS matched,
 round(avg((coalesce(rows, 0) >= CASE c WHEN 'Nation' THEN 25 WHEN 'Region' THEN 10 ELSE 1000 END)::INT) FILTER (c IS NOT NULL), 3) AS ratio FROM f)
SELECT *, CASE WHEN rogue = 0 AND missing = 0 THEN 'ok' WHEN missing > 0 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN rogue = 0 AND missing = 0 AND ratio >= 0.5 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s""")  # fmt: skip
def q14_ontology_gate(spark, d):
    checks = q13_min_rows(spark, d)
    return Q.ontology_gate(checks, catalog(nodes(spark, d), edges(spark, d)).filter("kind = 'NODE'"), _canonical(spark))


@register("q19_vote_gate", """WITH a AS (SELECT 'u' || user_id AS node, count(*) FILTER (value > 50) AS passes, avg(value / 100) AS mean FROM events GROUP BY 1)
SELECT node, passes, CASE WHEN passes >= 4 THEN 'auto_inject' WHEN passes = 3 THEN 'human_review' ELSE 'reject' END AS decision, round(CASE WHEN passes >= 4 THEN greatest(0.95, mean) WHEN passes = 3 THEN least(0.7, mean) ELSE mean END, 4) AS confidence FROM a""")  # fmt: skip
def q19_vote_gate(spark, d):
    votes = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("node"), (F.col("value") > 50).alias("passed"), (F.col("value") / 100).alias("confidence"))
    return Q.vote_gate(votes)


@register("q20_attribution", "SELECT source, round(avg(starts_with(text, 'The')::INT), 4) AS prefixed, round(avg((coalesce(lang, '') <> '')::INT), 4) AS filled FROM documents GROUP BY source")
def q20_attribution(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(F.round(F.avg(F.col("text").startswith("The").cast("int")), 4).alias("prefixed"), F.round(F.avg((F.coalesce("lang", F.lit("")) != "").cast("int")), 4).alias("filled"))


@register("b18_confusion", """WITH j AS (SELECT source, quality = 1 AS e, NOT (contains(text, '!!') OR contains(text, '%%%') OR contains(text, ' | ')) AS a FROM documents JOIN labels USING (doc_id))
SELECT source, count(*) AS total, count(*) FILTER (e AND a) AS tp, count(*) FILTER (NOT e AND a) AS fp, count(*) FILTER (e AND NOT a) AS fn, count(*) FILTER (NOT e AND NOT a) AS tn, round(count(*) FILTER (e = a) / count(*), 4) AS accuracy, round(count(*) FILTER (NOT e AND a) / count(*), 4) AS fp_share FROM j GROUP BY source""")  # fmt: skip
def b18_confusion(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", (~(F.col("text").contains("!!") | F.col("text").contains("%%%") | F.col("text").contains(" | "))).alias("a"))
    j = docs.join(table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("e")), "doc_id")
    return Q.confusion(j, "source", "e", "a")
