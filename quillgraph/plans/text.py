"""Queries: scalar rules, predicates and text functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as LB
from ..functions import text as X
from ..operators.quality import stale
from ..sources.views import edges, nodes, table
from .registry import register


@register("f2_contains", "SELECT doc_id FROM documents WHERE contains(text, 'the.')")
def f2_contains(spark, d):
    return table(spark, d, "documents").filter(F.col("text").contains("the.")).select("doc_id")


@register("f3_starts_with", "SELECT doc_id FROM documents WHERE starts_with(text, 'The')")
def f3_starts_with(spark, d):
    return table(spark, d, "documents").filter(F.col("text").startswith("The")).select("doc_id")


@register("f4_not_null_length", "WITH @NODES SELECT id FROM nodes WHERE title IS NOT NULL AND length(title) >= 8")
def f4_not_null_length(spark, d):
    return nodes(spark, d).filter(F.col("title").isNotNull() & (F.length("title") >= 8)).select("id")


@register("f5_any_field", "WITH @NODES SELECT id FROM nodes WHERE coalesce(contains(name, '77'), false) OR coalesce(contains(title, '77'), false) OR contains(id, '77')")
def f5_any_field(spark, d):
    has = lambda c: F.coalesce(F.col(c).contains("77"), F.lit(False))
    return nodes(spark, d).filter(has("name") | has("title") | has("id")).select("id")


@register("f6_optional_clauses", "SELECT doc_id FROM documents WHERE (contains(text, 'an') OR contains(source, 'an')) AND lang = 'en' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND quality = 1)")
def f6_optional_clauses(spark, d):
    docs = table(spark, d, "documents").filter((F.col("text").contains("an") | F.col("source").contains("an")) & (F.col("lang") == "en"))
    return docs.join(table(spark, d, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id")


@register("f7_quality_label", r"WITH @NODES SELECT id FROM nodes WHERE coalesce(length(title) >= 2 AND NOT regexp_matches(title, '^([◆■●▶\s0-9.]+|-{3,}|\.{3,}|第[一二三四五六七八九十]+[章节])') AND NOT contains(title, '- - -') AND NOT contains(title, '---') AND NOT starts_with(title, '...') AND NOT (length(title) > 15 AND length(title) - length(regexp_replace(title, '[，、。]', '', 'g')) > 3), false)")
def f7_quality_label(spark, d):
    return nodes(spark, d).filter(X.quality_label(F.col("title"), strict=True)).select("id")


@register("f8_placeholder", r"WITH v AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN E' \tTBD\n' WHEN 1 THEN 'N/A' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'none ' ELSE 'real' END AS v FROM orders) SELECT o_orderkey, coalesce(lower(trim(v, E' \t\n\r')) IN ('tbd', 'n/a', '', 'none'), false) AS placeholder FROM v")
def f8_placeholder(spark, d):
    k = F.col("o_orderkey") % 9
    v = F.when(k == 0, " \tTBD\n").when(k == 1, "N/A").when(k == 2, "").when(k == 3, F.lit(None)).when(k == 4, "none ").otherwise("real")
    return table(spark, d, "orders").select("o_orderkey", X.is_placeholder(v).alias("placeholder"))


@register("f14_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def f14_exists(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@register("f15_not_exists", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def f15_not_exists(spark, d):
    return table(spark, d, "part").join(table(spark, d, "lineitem").filter("l_returnflag = 'R'"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@register("f16_stale", "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2010-06-01') > 3650 AS stale FROM orders")
def f16_stale(spark, d):
    return table(spark, d, "orders").select("o_orderkey", stale(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("2010-06-01").cast("date")).alias("stale"))


@register("f18_window_keeps_malformed", "WITH e AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'broken' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp FROM events) SELECT event_id FROM e WHERE coalesce(TRY_CAST(stamp AS TIMESTAMP) >= TIMESTAMP '2024-01-02 00:00:00', true)")
def f18_window_keeps_malformed(spark, d):
    at = F.when(F.col("event_id") % 10 == 0, "broken").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "events").filter(F.coalesce(F.try_to_timestamp(at, F.lit("yyyy-MM-dd HH:mm:ss")) >= F.lit("2024-01-02 00:00:00").cast("timestamp"), F.lit(True))).select("event_id")


@register("e2_document_category", "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'legal' WHEN 1 THEN 'qa' WHEN 2 THEN 'knowledge' WHEN 3 THEN 'template' WHEN 4 THEN 'knowledge' ELSE 'other' END AS category FROM documents")
def e2_document_category(spark, d):
    kinds = ["policy/x", "QA/list ", "kuaiji", "工具/表", "pdf_any", "blog", ""]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", LB.document_category(kind).alias("category"))


@register("e3_priority_order", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 WHEN starts_with(o_orderpriority, '1') THEN 2 ELSE 5 END AS priority FROM orders ORDER BY priority, o_orderkey LIMIT 40")
def e3_priority_order(spark, d):
    p = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderpriority").startswith("1"), 2).otherwise(5)
    return table(spark, d, "orders").select("o_orderkey", p.alias("priority")).orderBy("priority", "o_orderkey").limit(40)


@register("e5_truncate", "SELECT doc_id, left(text, 300) AS head FROM documents")
def e5_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.left("text", F.lit(300)).alias("head"))


@register("e7_hash_ids", "SELECT page_id, left(sha256(url), 16) AS sha, left(md5(url), 8) AS md FROM pages")
def e7_hash_ids(spark, d):
    return table(spark, d, "pages").select("page_id", LB.short_hash(F.col("url")).alias("sha"), LB.short_hash(F.col("url"), 8, "md5").alias("md"))


@register("e8_kind_of", "WITH @EDGES SELECT split_part(src, ':', 1) AS a, split_part(dst, ':', 1) AS b, count(*) AS n FROM edges GROUP BY 1, 2")
def e8_kind_of(spark, d):
    return edges(spark, d).groupBy(LB.kind_of(F.col("src")).alias("a"), LB.kind_of(F.col("dst")).alias("b")).agg(F.count("*").alias("n"))


@register("e9_kind_map", "WITH @EDGES, m(a, b, name) AS (VALUES ('Customer', 'Order', 'BUYS'), ('Part', 'Supplier', 'FROM')) SELECT name, count(*) AS n FROM edges JOIN m ON a = split_part(src, ':', 1) AND b = split_part(dst, ':', 1) GROUP BY name")
def e9_kind_map(spark, d):
    m = spark.sql("SELECT * FROM VALUES ('Customer', 'Order', 'BUYS'), ('Part', 'Supplier', 'FROM') AS m(a, b, name)")
    e = edges(spark, d).select(LB.kind_of(F.col("src")).alias("a"), LB.kind_of(F.col("dst")).alias("b"))
    return e.join(F.broadcast(m), ["a", "b"]).groupBy("name").agg(F.count("*").alias("n"))


@register("e18_piped_rows", "SELECT n_regionkey, string_agg(n_nationkey || ' | ' || n_name, chr(10) ORDER BY n_nationkey) AS rows FROM nation GROUP BY 1")
def e18_piped_rows(spark, d):
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    return n.select("n_regionkey", F.array_join(F.transform("r", lambda x: F.concat_ws(" | ", x["n_nationkey"].cast("string"), x["n_name"])), "\n").alias("rows"))


@register("e19_token_estimate", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def e19_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", LB.tokens_estimate(F.col("text")).alias("tokens"))


@register("x3_model_text", r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, CASE WHEN text = '' THEN 'empty' WHEN len(ls) > 5 AND len(list_filter(ls, lambda x: regexp_matches(trim(x, E' \t\n\r'), '^(- |\* |• |1\.|2\.|3\.)'))) / len(ls) > 0.5 THEN 'high_bullet_ratio' ELSE 'ok' END AS reason FROM l""")  # fmt: skip
def x3_model_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.model_reason(F.col("text")).alias("reason"))


@register("x11_classifier", "SELECT doc_id, CASE WHEN contains(source, '7') OR contains(text, 'pathetic') THEN 'WARNS' WHEN contains(text, '!!') THEN 'SHOUTS' ELSE 'INTERPRETS' END AS rel FROM documents")
def x11_classifier(spark, d):
    rules = [("WARNS", ["7"], ["pathetic"]), ("SHOUTS", [], ["!!"])]
    return table(spark, d, "documents").select("doc_id", X.classify(F.col("text"), F.col("source"), rules, "INTERPRETS").alias("rel"))


@register("x12_keyword_context", "SELECT doc_id, substring(text, greatest(instr(text, 'pathetic') - 50, 1), instr(text, 'pathetic') - greatest(instr(text, 'pathetic') - 50, 1) + 150) AS ctx FROM documents WHERE contains(text, 'pathetic')")
def x12_keyword_context(spark, d):
    c = X.keyword_context(F.col("text"), "pathetic")
    return table(spark, d, "documents").select("doc_id", c.alias("ctx")).filter("ctx IS NOT NULL")


@register("x15_html_title", r"SELECT page_id, trim(regexp_extract(left(html, 3000), '(?is)<title[^>]*>(.*?)</title>', 1), E' \t\n\r') AS title FROM pages")
def x15_html_title(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_title(F.col("html")).alias("title"))


@register("x25_json", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def x25_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("b6_longest_per_key", "SELECT source, max_by(doc_id, length(text) * 1000000 - doc_id) AS doc_id FROM documents GROUP BY source")
def b6_longest_per_key(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("doc_id"))


@register("b9_description", "SELECT p_partkey, concat_ws('; ', nullif('name: ' || p_name, 'name: '), 'brand: ' || p_brand, 'size: ' || p_size) AS description FROM part")
def b9_description(spark, d):
    part = lambda n, c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{n}: "), F.col(c).cast("string")))
    return table(spark, d, "part").select("p_partkey", F.concat_ws("; ", part("name", "p_name"), part("brand", "p_brand"), part("size", "p_size")).alias("description"))


@register("b11_maximal_keywords", "WITH f AS (SELECT doc_id, list_filter(['tion', 'ation', 'the', 'theation', 'und'], lambda k: contains(text, k)) AS found FROM documents) SELECT doc_id, list_filter(found, lambda x: len(list_filter(found, lambda y: y <> x AND contains(y, x))) = 0) AS keywords FROM f")
def b11_maximal_keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", X.maximal_keywords(F.col("text"), ["tion", "ation", "the", "theation", "und"]).alias("keywords"))


@register("b13_page_kinds", "SELECT page_id, list_sort(list_filter([CASE WHEN len(regexp_extract_all(html, '<p>')) >= 3 THEN 'prose' END, CASE WHEN len(regexp_extract_all(html, '<li>')) >= 3 THEN 'list' END, CASE WHEN len(regexp_extract_all(html, '<h[1-6]')) >= 2 THEN 'sections' END], lambda x: x IS NOT NULL)) AS kinds FROM pages")
def b13_page_kinds(spark, d):
    rule = lambda p, n, k: F.when(F.regexp_count("html", F.lit(p)) >= n, F.lit(k))
    return table(spark, d, "pages").select("page_id", F.array_sort(F.array_compact(F.array(rule("<p>", 3, "prose"), rule("<li>", 3, "list"), rule("<h[1-6]", 2, "sections")))).alias("kinds"))


@register("b20_source_summary", "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status FROM documents GROUP BY source")
def b20_source_summary(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.when(F.count("*") > 0, "ok").otherwise("empty").alias("status"))


@register("q1_null_rates", "SELECT label, round(avg((name IS NULL OR name = '')::INT), 4) AS name_null, round(avg((title IS NULL OR title = '')::INT), 4) AS title_null FROM (SELECT 'P' AS label, NULLIF(p_name, 'small ring') AS name, p_type AS title FROM part) GROUP BY label")
def q1_null_rates(spark, d):
    p = table(spark, d, "part").select(F.lit("P").alias("label"), F.nullif("p_name", F.lit("small ring")).alias("name"), F.col("p_type").alias("title"))
    rate = lambda c: F.round(F.avg(LB.is_blank(F.col(c)).cast("int")), 4).alias(f"{c}_null")
    return p.groupBy("label").agg(rate("name"), rate("title"))


@register("q22_first_keyword_counts", "WITH k(w, i) AS (VALUES ('the', 0), ('und', 1), ('de', 2)), m AS (SELECT doc_id, arg_min(w, i) AS w FROM documents JOIN k ON contains(text, w) GROUP BY doc_id) SELECT w, count(*) AS n FROM m GROUP BY w ORDER BY n DESC, w LIMIT 30")
def q22_first_keyword_counts(spark, d):
    t = F.col("text")
    w = F.when(t.contains("the"), "the").when(t.contains("und"), "und").when(t.contains("de"), "de")
    return table(spark, d, "documents").select(w.alias("w")).filter("w IS NOT NULL").groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(30)
