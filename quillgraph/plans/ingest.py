"""Queries: gates, merges, migrations, change detection, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..sources.views import edges, nodes, table
from .registry import register


@register("k1_dedup_first", "SELECT l_orderkey, l_partkey, arg_min(l_quantity, l_linenumber * 1e6 + l_extendedprice) AS l_quantity FROM lineitem GROUP BY 1, 2")
def k1_dedup_first(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", (F.col("l_linenumber") * 1e6 + F.col("l_extendedprice")).alias("seq"))
    return I.dedup_first(rows, ["l_orderkey", "l_partkey"], "seq").select("l_orderkey", "l_partkey", "l_quantity")


@register("k2_insert_absent", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def k2_insert_absent(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return I.insert_absent(s, table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), "k")


@register("k3_upsert", "SELECT coalesce(b.k, a.k) AS k, coalesce(b.name, a.name) AS name FROM (SELECT c_custkey AS k, c_name AS name FROM customer) a FULL JOIN (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name FROM supplier) b ON a.k = b.k")
def k3_upsert(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"))
    return I.upsert(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), s, "k")


@register("k5_gated_ingest", r"""WITH @NODES, r AS (SELECT id, label, CASE WHEN trim(coalesce(id, '')) = '' THEN 'missing_id' WHEN length(trim(coalesce(title, ''), E' \t\n\r')) < 2 THEN 'title_too_short' WHEN label <> 'Part' AND length(trim(coalesce(content, ''), E' \t\n\r')) < 20 THEN 'content_too_short' WHEN starts_with(trim(title), '{''_id'':') THEN 'title_is_raw_id' END AS reason FROM nodes)
SELECT label, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY 1, 2""")  # fmt: skip
def k5_gated_ingest(spark, d):
    r = I.gate_reason(F.col("id"), F.col("title"), F.col("content"), F.col("label") == "Part")
    return nodes(spark, d).groupBy("label", F.coalesce(r, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@register("f11_batch_gate", r"""WITH @NODES, i AS (SELECT label, unnest(list_filter([CASE WHEN length(trim(coalesce(title, ''), E' \t\n\r')) < 5 THEN 'high:title_too_short' END, CASE WHEN length(trim(coalesce(content, ''), E' \t\n\r')) < 20 THEN 'medium:content_too_short' END, CASE WHEN starts_with(trim(coalesce(title, '')), 'TRM_') THEN 'medium:title_is_code' END], lambda x: x IS NOT NULL)) AS x FROM nodes)
SELECT label, split_part(x, ':', 1) AS severity, split_part(x, ':', 2) AS reason, count(*) AS n FROM i GROUP BY ALL""")  # fmt: skip
def f11_batch_gate(spark, d):
    issues = nodes(spark, d).select("label", F.explode(I.gate_issues(F.col("id"), F.col("title"), F.col("content"))).alias("i"))
    return issues.groupBy("label", "i.severity", "i.reason").agg(F.count("*").alias("n"))


@register("k6_migrate", "SELECT c_name AS name, coalesce(TRY_CAST(right(c_name, 3) AS BIGINT), 0) AS num, coalesce(TRY_CAST(c_mktsegment AS DOUBLE), 0.0)::DOUBLE AS seg FROM customer")
def k6_migrate(spark, d):
    c = table(spark, d, "customer").withColumn("tail", F.right("c_name", F.lit(3)))
    return I.migrate(c, {"name": ("c_name", "string"), "num": ("tail", "bigint"), "seg": ("c_mktsegment", "double")})


@register("k7_repair", "SELECT p_partkey, CASE WHEN p_size > 40 THEN p_type || ' ' || p_name ELSE p_name END AS p_name FROM part")
def k7_repair(spark, d):
    return I.repair(table(spark, d, "part"), "p_name", F.col("p_size") > 40, F.concat_ws(" ", "p_type", "p_name")).select("p_partkey", "p_name")


@register("k9_rewire", "WITH @EDGES, m AS (SELECT 'Nation:' || n_nationkey AS o, 'Nation:' || (n_nationkey % 5) AS n FROM nation WHERE n_nationkey >= 20), x AS (SELECT coalesce(a.n, src) AS src, coalesce(b.n, dst) AS dst, rel_type, a.n IS NOT NULL OR b.n IS NOT NULL AS moved FROM edges LEFT JOIN m a ON src = a.o LEFT JOIN m b ON dst = b.o) SELECT DISTINCT src, dst, rel_type FROM x WHERE NOT (moved AND src = dst)")
def k9_rewire(spark, d):
    c = lambda k: F.concat(F.lit("Nation:"), k.cast("string"))
    ids = table(spark, d, "nation").filter("n_nationkey >= 20").select(c(F.col("n_nationkey")), c(F.col("n_nationkey") % 5))
    return I.rewire(edges(spark, d), ids)


@register("k10_fold", "SELECT 'C_' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'S_' || s_suppkey, s_name FROM supplier")
def k10_fold(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return I.fold([("C_", c), ("S_", table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))], "id")


@register("k11_lineage_merge", "SELECT coalesce(b.k, a.k) AS k, coalesce(b.n, a.n) AS n, CASE WHEN a.k IS NULL THEN ['v2'] WHEN b.k IS NULL THEN ['v1'] ELSE ['v1', 'v2'] END AS _lineage_present FROM (SELECT s_suppkey AS k, s_name AS n FROM supplier) a FULL JOIN (SELECT c_custkey AS k, c_name AS n FROM customer WHERE c_custkey % 3 = 0) b ON a.k = b.k")
def k11_lineage_merge(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n"))
    b = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"))
    return I.lineage_merge(a, b, "k")


@register("k17_relabel", "WITH @EDGES SELECT CASE WHEN rel_type = 'IN_NATION' AND starts_with(src, 'Supplier') THEN 'BASED_IN' ELSE rel_type END AS rel_type, count(*) AS n FROM edges GROUP BY 1")
def k17_relabel(spark, d):
    e = I.repair(edges(spark, d), "rel_type", (F.col("rel_type") == "IN_NATION") & F.col("src").startswith("Supplier"), F.lit("BASED_IN"))
    return e.groupBy("rel_type").agg(F.count("*").alias("n"))


@register("b7_overwrite_longer", "SELECT p_partkey, CASE WHEN length(x) >= 8 AND length(x) > length(p_name) THEN x ELSE p_name END AS p_name FROM part LEFT JOIN (SELECT p_partkey, p_brand || p_type AS x FROM part WHERE p_size < 25) USING (p_partkey)")
def b7_overwrite_longer(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    new = table(spark, d, "part").filter("p_size < 25").select("p_partkey", F.concat("p_brand", "p_type").alias("p_name"))
    return I.overwrite_longer(p, new, "p_partkey", "p_name", 8)


@register("z3_changed", "WITH s AS (SELECT doc_id, left(sha256(CASE WHEN source = 'src3' THEN 'old' ELSE text END), 16) AS hash FROM documents) SELECT doc_id FROM documents WHERE (doc_id, left(sha256(text), 16)) NOT IN (SELECT (doc_id, hash) FROM s)")
def z3_changed(spark, d):
    docs = table(spark, d, "documents")
    seen = docs.select("doc_id", F.left(F.sha2(F.when(F.col("source") == "src3", "old").otherwise(F.col("text")), 256), F.lit(16)).alias("hash"))
    return I.changed(docs, seen, "doc_id", "text").select("doc_id")


@register("z4_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT item_id FROM benchmark) ORDER BY doc_id LIMIT 100")
def z4_pending(spark, d):
    return I.pending(table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", 100)


@register("w3_latest", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def w3_latest(spark, d):
    return I.latest(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@register("w4_duplicates", "WITH k AS (SELECT event_id, user_id || '_' || event_type AS base, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS k FROM events) SELECT event_id, CASE WHEN k = 0 THEN base ELSE base || '_dup' || k END AS name FROM k")
def w4_duplicates(spark, d):
    return I.numbered_duplicates(table(spark, d, "events"), ["user_id", "event_type"], "event_id", F.concat_ws("_", F.col("user_id").cast("string"), "event_type")).select("event_id", "name")


@register("w6_diverging", "WITH e AS (SELECT event_id, user_id, event_type AS sha, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'click' END AS parent FROM events), x AS (SELECT *, lag(sha) OVER (PARTITION BY user_id ORDER BY event_id) AS expected FROM e) SELECT event_id, expected FROM x WHERE expected IS NOT NULL AND parent <> '' AND parent <> expected")
def w6_diverging(spark, d):
    log = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("sha"), F.when(F.col("event_id") % 3 == 0, "").otherwise("click").alias("parent"))
    return I.diverging(log, "user_id", "event_id", "sha", "parent").select("event_id", "expected")


@register("z2_rate_limit", """WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w(event_id, user_id, k, start, n) AS (SELECT event_id, user_id, k, t, 1 FROM r WHERE k = 1 UNION ALL SELECT r.event_id, r.user_id, r.k, CASE WHEN r.t - w.start > 43200000000 THEN r.t ELSE w.start END, CASE WHEN r.t - w.start > 43200000000 THEN 1 ELSE n + 1 END FROM w JOIN r ON r.user_id = w.user_id AND r.k = w.k + 1)
SELECT event_id, user_id, n > 3 AS refused FROM w""")  # fmt: skip
def z2_rate_limit(spark, d):
    return I.first_per_window(table(spark, d, "events"), "user_id", "ts", seconds=43_200, most=3)


@register("z7_fresh_sources", "SELECT event_type, max(ts) >= TIMESTAMP '2024-01-10' AS fresh FROM events GROUP BY 1")
def z7_fresh_sources(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg((F.max("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).alias("fresh"))


@register("b10_triples", "SELECT DISTINCT 'Cust:' || o_custkey AS src, 'Pri:' || o_orderpriority AS dst, 'WANTS' AS rel_type FROM orders WHERE o_orderstatus = 'O'")
def b10_triples(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("subject"), F.lit("c").alias("subject_kind"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("else").alias("relation"), F.col("o_orderpriority").alias("object"), F.lit("p").alias("object_kind"))
    return I.triples(rows, {"c": "Cust", "p": "Pri"}, {"open": "WANTS"})
