"""Queries: edge builders, windows over groups, set differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import links as L
from ..sources.views import edges, nodes, table
from .registry import register


@register("j10_key_edges", "SELECT DISTINCT 'Order:' || l_orderkey AS src, 'Supplier:' || l_suppkey AS dst, 'FILLED_BY' AS rel_type FROM lineitem")
def j10_key_edges(spark, d):
    c = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    return L.key_edges(table(spark, d, "lineitem"), c("Order:", "l_orderkey"), c("Supplier:", "l_suppkey"), "FILLED_BY")


@register("j12_mapped_edges", "SELECT o_orderkey AS src, o_orderpriority AS value, dst, dst IS NULL AS unmapped FROM orders LEFT JOIN (VALUES ('1-URGENT', 'fast'), ('2-HIGH', 'fast'), ('5-LOW', 'slow')) m(value, dst) ON o_orderpriority = value")
def j12_mapped_edges(spark, d):
    return L.mapped_edges(table(spark, d, "orders"), "o_orderkey", "o_orderpriority", spark.sql("SELECT * FROM VALUES ('1-URGENT', 'fast'), ('2-HIGH', 'fast'), ('5-LOW', 'slow') AS m(value, dst)"))


@register("j13_tiered_lookup", """WITH t AS (SELECT DISTINCT o_orderpriority AS token FROM orders), n(name, id) AS (VALUES ('1-URGENT', 'n1'), ('important', 'n2'), ('3', 'n3')), a(alias, name) AS (VALUES ('2-HIGH', 'important'))
SELECT token, coalesce(x.id, y.id, z.id) AS id, CASE WHEN x.id IS NOT NULL THEN 1 WHEN y.id IS NOT NULL THEN 2 WHEN z.id IS NOT NULL THEN 3 END AS tier FROM t LEFT JOIN n x ON token = x.name LEFT JOIN a ON token = alias LEFT JOIN n y ON a.name = y.name LEFT JOIN n z ON contains(token, '-') AND trim(split_part(token, '-', 1)) = z.name""")  # fmt: skip
def j13_tiered_lookup(spark, d):
    names = spark.sql("SELECT * FROM VALUES ('1-URGENT', 'n1'), ('important', 'n2'), ('3', 'n3') AS n(name, id)")
    aliases = spark.sql("SELECT * FROM VALUES ('2-HIGH', 'important') AS a(alias, name)")
    return L.tiered_lookup(table(spark, d, "orders").select(F.col("o_orderpriority").alias("token")), names, aliases)


_WORDS = "kw AS (SELECT left(text, 12) AS keyword, min(item_id) AS seq FROM benchmark GROUP BY 1)"


def _words(spark, d):
    return table(spark, d, "benchmark").groupBy(F.left("text", F.lit(12)).alias("keyword")).agg(F.min("item_id").alias("seq"))


@register("j14_keyword_links", f"WITH {_WORDS} SELECT DISTINCT doc_id AS key, keyword FROM documents JOIN kw ON contains(text, keyword)")
def j14_keyword_links(spark, d):
    return L.keyword_links(table(spark, d, "documents"), _words(spark, d), "doc_id", "text")


@register("b2_first_keyword", f"WITH {_WORDS} SELECT doc_id AS key, min_by(keyword, seq) AS keyword FROM documents JOIN kw ON contains(left(text, 2000), keyword) GROUP BY 1")
def b2_first_keyword(spark, d):
    return L.keyword_links(table(spark, d, "documents"), _words(spark, d), "doc_id", "text", window=2000, first_only=True)


_HEADS = "kw AS (SELECT DISTINCT left(text, n) AS keyword FROM benchmark, range(3, 13) r(n) WHERE length(text) >= n)"


def _heads(spark, d):
    """Beginnings of 3 to 12 characters: keywords that stand inside one another."""
    sizes = table(spark, d, "benchmark").withColumn("n", F.explode(F.sequence(F.lit(3), F.lit(12)))).filter(F.length("text") >= F.col("n"))
    return sizes.select(F.left("text", F.col("n")).alias("keyword"), F.lit(0).alias("seq")).distinct()


@register("j14_nested_keywords", f"WITH {_HEADS} SELECT source, keyword, count(*) AS docs FROM documents JOIN kw ON contains(text, keyword) GROUP BY source, keyword")
def j14_nested_keywords(spark, d):
    """Documents of each source by keyword, over a dictionary of nested keywords."""
    docs = table(spark, d, "documents")
    return L.keyword_links(docs, _heads(spark, d), "doc_id", "text").join(docs.select(F.col("doc_id").alias("key"), "source"), "key").groupBy("source", "keyword").agg(F.count("*").alias("docs"))


@register("b11_maximal_links", f"WITH {_HEADS}, f AS (SELECT DISTINCT doc_id AS key, keyword FROM documents JOIN kw ON contains(text, keyword)) SELECT key, keyword FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.key = f.key AND g.keyword <> f.keyword AND contains(g.keyword, f.keyword))")
def b11_maximal_links(spark, d):
    return L.maximal_links(table(spark, d, "documents"), _heads(spark, d), "doc_id", "text")


@register("j15_references", """WITH r AS (SELECT DISTINCT doc_id AS id, left(text, 10) AS ref FROM documents WHERE length(left(text, 10)) >= 4), p AS (SELECT DISTINCT ref FROM r), f AS (SELECT ref, min(item_id) AS target FROM p JOIN benchmark b ON starts_with(b.text, ref) GROUP BY ref) SELECT id, ref, target FROM r JOIN f USING (ref)""")
def j15_references(spark, d):
    units = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.left("text", F.lit(10)).alias("r"))
    titles = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("title"))
    return L.references(units, titles, F.array("r"), cut=10)


@register("j16_resolve_names", """WITH s AS (SELECT p_brand AS name, 'Part:' || p_partkey AS dst, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, 'Part:' || p_partkey) AS k FROM part),
c AS (SELECT 'Order:' || o_orderkey AS src, CASE WHEN o_orderkey % 5 = 0 THEN 'gone' ELSE 'Brand#' || (o_custkey % 25 + 1) END AS name FROM orders)
SELECT DISTINCT src, name, coalesce(dst, 'external:' || name) AS dst, CASE WHEN n = 1 THEN 0.95 WHEN dst IS NOT NULL THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence FROM c LEFT JOIN (SELECT * FROM s WHERE k <= 3) USING (name)""")  # fmt: skip
def j16_resolve_names(spark, d):
    symbols = table(spark, d, "part").select(F.concat(F.lit("Part:"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("seq"))
    k = F.col("o_orderkey")
    calls = table(spark, d, "orders").select(F.concat(F.lit("Order:"), k.cast("string")).alias("src"), F.when(k % 5 == 0, "gone").otherwise(F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string"))).alias("name"), F.lit(0.8).alias("confidence"))
    return L.resolve_names(calls, symbols)


@register("j17_last_writer", "SELECT o_custkey, max_by(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS o_orderkey FROM orders GROUP BY 1")
def j17_last_writer(spark, d):
    o = table(spark, d, "orders").withColumn("seq", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")))
    return L.last_writer(o, "o_custkey", "o_orderkey", "seq")


@register("w1_version_chain", "SELECT newer, older FROM (SELECT p_partkey AS newer, lead(p_partkey) OVER w AS older, p_size AS y, lead(p_size) OVER w AS y2 FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_size DESC, p_partkey)) WHERE y > y2")
def w1_version_chain(spark, d):
    return L.version_chain(table(spark, d, "part"), "p_name", "p_size", "p_partkey")


@register("w2_adjacency_chain", "SELECT a, b FROM (SELECT p_partkey AS a, lead(p_partkey) OVER w AS b, row_number() OVER w AS k FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_partkey)) WHERE k < 20 AND b IS NOT NULL")
def w2_adjacency_chain(spark, d):
    return L.adjacency_chain(table(spark, d, "part"), "p_type", "p_partkey")


@register("w7_next_in_order", "SELECT a, b FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NOT NULL")
def w7_next_in_order(spark, d):
    return L.next_in_order(table(spark, d, "orders"), "o_custkey", "o_orderkey", F.col("o_orderkey"))


@register("j20_similar_titles", r"""WITH t AS (SELECT p_brand AS g, p_partkey AS id, p_size AS at, list_distinct(list_filter(regexp_split_to_array(p_name || ' ' || p_type, '\s+'), lambda w: length(w) >= 2)) AS terms, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part QUALIFY k <= 200)
SELECT a.id AS newer, b.id AS older FROM t a JOIN t b ON a.g = b.g AND a.k < b.k AND a.at <> b.at WHERE len(list_intersect(a.terms, b.terms)) / (len(a.terms) + len(b.terms) - len(list_intersect(a.terms, b.terms))) >= 0.5""")  # fmt: skip
def j20_similar_titles(spark, d):
    return L.similar_titles(table(spark, d, "part").withColumn("title", F.concat_ws(" ", "p_name", "p_type")), "p_brand", "title", "p_size", "p_partkey")


@register("j24_product", """SELECT r_name, p_type, c_mktsegment FROM region JOIN (VALUES ('REGION_0', 'PROMO'), ('REGION_1', 'SMALL'), ('REGION_1', 'LARGE')) a(r_name, p_type) USING (r_name) JOIN (SELECT DISTINCT p_type FROM part) USING (p_type)
JOIN (SELECT DISTINCT r_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) USING (r_name)""")  # fmt: skip
def j24_product(spark, d):
    """Regions by the types that apply to them by the segments that they have."""
    applies = spark.sql("SELECT * FROM VALUES ('REGION_0', 'PROMO'), ('REGION_1', 'SMALL'), ('REGION_1', 'LARGE') AS a(r_name, p_type)")
    pairs = L.product(table(spark, d, "region").select("r_name"), table(spark, d, "part").select("p_type").distinct(), applies, "r_name", "p_type")
    lands = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    present = table(spark, d, "customer").join(lands, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "c_mktsegment").distinct()
    return pairs.join(present, "r_name").select("r_name", "p_type", "c_mktsegment")


@register("j25_overlap", "SELECT count(*) AS overlap FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)")
def j25_overlap(spark, d):
    return L.overlap(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").select(F.col("o_custkey").alias("id")))


@register("j26_only_new", "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def j26_only_new(spark, d):
    items = table(spark, d, "lineitem").select("l_returnflag", F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return L.only_new(items.filter("l_returnflag = 'R'").drop("l_returnflag"), items.filter("l_returnflag = 'A'").drop("l_returnflag"))


@register("j27_adopt", "SELECT 'Customer:' || c_custkey AS src, 'Region:0' AS dst, 'DEFAULT' AS rel_type FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j27_adopt(spark, d):
    idle = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return L.adopt(idle.select(F.concat(F.lit("Customer:"), F.col("c_custkey").cast("string")).alias("id")), "Region:0", "DEFAULT")


@register("j28_bilingual", "WITH x AS (SELECT doc_id, lang, source || ':' || (doc_id // 20) AS stem FROM documents) SELECT a.stem, a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.stem = b.stem WHERE a.lang = 'en' AND b.lang = 'fr'")
def j28_bilingual(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.concat_ws(":", "source", F.floor(F.col("doc_id") / 20).cast("string")).alias("stem"))
    return L.bilingual(docs, "stem", "lang", "doc_id", "en", "fr")


@register("j33_as_of", "SELECT event_id, user_id, ts, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING) AS last_value FROM events QUALIFY event_type <> 'purchase'")
def j33_as_of(spark, d):
    e = table(spark, d, "events")
    return L.as_of(e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", "value")


@register("j33_overlaps", """WITH x AS (SELECT o_custkey AS by, o_orderkey AS k, o_orderdate AS s, o_orderdate + to_days((o_orderkey % 150)::INT) AS e FROM orders)
SELECT a.k AS a_key, b.k AS b_key, a.by FROM x a JOIN x b ON a.by = b.by AND a.s < b.e AND b.s < a.e WHERE a.k < b.k AND a.s < a.e AND b.s < b.e""")  # fmt: skip
def j33_overlaps(spark, d):
    """Orders of one customer that are open at the same time, each for 0 to 149 days."""
    from ..operators.intervals import overlaps

    days = (F.col("o_orderkey") % 150).cast("int")
    x = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderdate") + F.make_dt_interval(days)).alias("until"))
    pairs = overlaps(x, x, ("o_custkey",) * 2, ("o_orderkey",) * 2, ("o_orderdate",) * 2, ("until",) * 2)
    return pairs.filter("a_key < b_key")


@register("j33_valid_facts", """WITH f AS (SELECT user_id, event_id, ts AS s, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events WHERE event_type IN ('purchase', 'signup'))
SELECT p.event_id AS a_key, f.event_id AS b_key, p.user_id AS by FROM events p JOIN f ON p.user_id = f.user_id AND f.s <= p.ts AND (f.e IS NULL OR p.ts < f.e) WHERE p.event_type = 'error'""")  # fmt: skip
def j33_valid_facts(spark, d):
    """The purchase or signup in force at each error: from its time to the user's next one, the last for ever."""
    from pyspark.sql import Window

    from ..operators.intervals import valid_during

    e = table(spark, d, "events")
    facts = e.filter(F.col("event_type").isin("purchase", "signup")).withColumn("until", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return valid_during(e.filter("event_type = 'error'"), facts, ("user_id",) * 2, ("event_id",) * 2, "ts", "ts", "until")


@register("j35_hash_key", "SELECT DISTINCT left(sha256(url), 16) AS src, 'host:' || split_part(url, '/', 3) AS dst, 'ON_HOST' AS rel_type FROM pages")
def j35_hash_key(spark, d):
    from ..functions.labels import short_hash

    return L.key_edges(table(spark, d, "pages"), short_hash(F.col("url")), F.concat(F.lit("host:"), F.split_part("url", F.lit("/"), F.lit(3))), "ON_HOST")


@register("b1_longest_match", f"WITH {_WORDS} SELECT doc_id AS key, max_by(seq, length(keyword) * 1000000 - seq) AS id FROM documents JOIN (SELECT left(keyword, 3 + seq % 9) AS keyword, seq FROM kw) ON contains(text, keyword) GROUP BY 1")
def b1_longest_match(spark, d):
    names = _words(spark, d).select(F.col("seq").alias("id"), F.left("keyword", (3 + F.col("seq") % 9).cast("int")).alias("name"), "seq")
    return L.longest_match(table(spark, d, "documents"), names, "doc_id", "text")


@register("b8_inherit", "WITH @NODES, @EDGES, s AS (SELECT id FROM nodes WHERE length(coalesce(content, '')) < 5), r AS (SELECT id, left(content, 2000) AS content FROM nodes WHERE length(coalesce(content, '')) >= 5) SELECT src AS child, min_by(r.content, dst) AS content FROM edges JOIN s ON src = s.id JOIN r ON dst = r.id GROUP BY src")
def b8_inherit(spark, d):
    return L.inherit(edges(spark, d), nodes(spark, d), least=5)


@register("u1_union_dedup", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u1_union_dedup(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@register("u2_set_flags", "SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS declared, b.k IS NOT NULL AS live FROM (SELECT n_nationkey AS k FROM nation) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) b ON a.k = b.k")
def u2_set_flags(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.lit(True).alias("declared"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct().withColumn("live", F.lit(True))
    return a.join(b, "k", "full_outer").select("k", F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("live", F.lit(False)).alias("live"))


@register("u3_column_diff", "SELECT 'orders' AS name, ['o_clerk'] AS declared_only, ['o_custkey', 'o_orderdate', 'o_orderpriority', 'o_orderstatus', 'o_totalprice'] AS live_only, ['o_orderkey'] AS matched")
def u3_column_diff(spark, d):
    from ..operators.schema import column_diff

    declared = spark.sql("SELECT 'orders' AS name, array('o_orderkey', 'o_clerk') AS columns")
    live = spark.createDataFrame([("orders", table(spark, d, "orders").columns)], "name string, columns array<string>")
    return column_diff(declared, live)
