"""All registered queries of the graph engine and the SQL that each must equal."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NODES = """nodes AS (
 SELECT 'Region:' || r_regionkey AS id, 'Region' AS label, r_name AS name, NULL::VARCHAR AS title, NULL::VARCHAR AS content FROM region
 UNION ALL SELECT 'Nation:' || n_nationkey, 'Nation', n_name, NULL, NULL FROM nation
 UNION ALL SELECT 'Customer:' || c_custkey, 'Customer', c_name, c_mktsegment, NULL FROM customer
 UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier', s_name, NULL, NULL FROM supplier
 UNION ALL SELECT 'Part:' || p_partkey, 'Part', p_name, p_type, p_brand FROM part
 UNION ALL SELECT 'Order:' || o_orderkey, 'Order', NULL, o_orderpriority, o_orderstatus FROM orders
 UNION ALL SELECT 'Document:' || doc_id, 'Document', NULL, left(split_part(text, chr(10), 1), 80), text FROM documents)"""

EDGES = """edges AS (
 SELECT 'Customer:' || o_custkey AS src, 'Order:' || o_orderkey AS dst, 'PLACED' AS rel_type FROM orders
 UNION ALL SELECT DISTINCT 'Order:' || l_orderkey, 'Part:' || l_partkey, 'CONTAINS' FROM lineitem
 UNION ALL SELECT DISTINCT 'Part:' || l_partkey, 'Supplier:' || l_suppkey, 'SUPPLIED_BY' FROM lineitem
 UNION ALL SELECT 'Customer:' || c_custkey, 'Nation:' || c_nationkey, 'IN_NATION' FROM customer
 UNION ALL SELECT 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey, 'IN_NATION' FROM supplier
 UNION ALL SELECT 'Nation:' || n_nationkey, 'Region:' || n_regionkey, 'IN_REGION' FROM nation)"""


def register(name: str, sql: str | None = None) -> Callable:
    """Decorator: fn(spark, sf_dir) is the query `name`. @NODES and @EDGES in sql stand for the views' definitions."""

    def put(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.replace("@NODES", NODES).replace("@EDGES", EDGES)
        return fn

    return put


for _module in ("graph", "search", "quality", "text", "links", "ingest", "extras", "domain", "rules", "small", "files", "catalogue"):
    importlib.import_module(f"quillgraph.plans.{_module}")
