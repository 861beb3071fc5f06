"""Ranked retrieval: text search with per-label limits, sub-terms, vector top-k, rank fusion, stratified samples."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order of labels in a search and what a label adds to its hits' scores.
SEARCH_ORDER = (
    "TaxType", "TaxRate", "TaxIncentive", "ComplianceRule", "RiskIndicator",
    "TaxAccountingGap", "SocialInsuranceRule", "InvoiceRule", "IndustryBenchmark",
    "AuditTrigger", "Penalty", "FilingForm", "TaxEntity", "BusinessActivity",
    "AccountingSubject", "Classification", "Region", "IssuingBody",
    "JournalEntryTemplate", "FinancialStatementItem", "TaxCalculationRule",
    "FilingFormField", "FinancialIndicator", "AccountingStandard", "TaxTreaty",
    "TaxItem", "TaxBasis", "TaxLiabilityTrigger", "DeductionRule", "TaxMilestoneEvent",
    "ResponseStrategy", "PolicyChange",
    "LegalDocument", "LegalClause", "KnowledgeUnit",
    "FAQEntry", "CPAKnowledge",
    "TaxClassificationCode", "HSCode",
)
TYPE_BOOST = {
    "TaxType": 25, "TaxRate": 25, "TaxIncentive": 20, "TaxCalculationRule": 20,
    "ComplianceRule": 20, "SocialInsuranceRule": 20, "DeductionRule": 20,
    "InvoiceRule": 20, "TaxAccountingGap": 20, "RiskIndicator": 15,
    "LawOrRegulation": 15, "LegalDocument": 15, "RegulationClause": 10,
    "KnowledgeUnit": 15, "AccountingStandard": 15, "PolicyChange": 15,
    "FAQEntry": 10, "CPAKnowledge": 10, "AccountingEntry": 10,
    "MindmapNode": 0, "DocumentSection": 0,
}
FUSION_BOOST = {
    "TaxType": 0.012, "TaxRate": 0.012, "TaxIncentive": 0.004,
    "TaxCalculationRule": 0.008, "ComplianceRule": 0.008,
    "SocialInsuranceRule": 0.008, "DeductionRule": 0.008,
    "KnowledgeUnit": 0.010, "PolicyChange": 0.006,
    "AccountingStandard": 0.006, "FAQEntry": 0.005, "CPAKnowledge": 0.005,
    "LawOrRegulation": 0.001, "LegalDocument": 0.001,
    "RegulationClause": 0, "MindmapNode": 0, "DocumentSection": 0,
}
DOMAIN_TERMS = (
    "小规模纳税人", "一般纳税人", "增值税", "企业所得税", "个人所得税", "消费税",
    "土地增值税", "房产税", "印花税", "契税", "关税", "车船税", "资源税",
    "城建税", "教育费附加", "税收优惠", "减免税", "加计扣除", "即征即退",
    "纳税申报", "汇算清缴", "税务登记", "发票管理", "进项税额", "销项税额",
    "小微企业", "高新技术", "研发费用", "社保", "公积金",
    "税会差异", "纳税调整", "视同销售", "税前扣除", "合规", "风险", "稽查",
    "发票", "认证", "申报", "退税", "免税", "抵扣", "征收", "缴纳",
    "税率", "税种", "税负", "税额", "纳税", "减税", "优惠", "罚款",
    "审计", "处罚", "滞纳", "行业", "基准", "预警", "科目", "会计",
)
PARTICLES = r"[，。？！、的了在是有和与或及其对于关于如何什么哪些可以怎么为被将把各多少几个 ]"


def lookup(c: Column, values: dict, default) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default)) if pairs else F.lit(default)


def rank_of(c: Column, order: Sequence[str]) -> Column:
    """Place of a label in `order`, null outside it."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), c), F.lit(0))


def text_search(nodes: DataFrame, query: str, order: Sequence[str], limit: int = 10, boost: dict | None = None, other: int = 5) -> DataFrame:
    """Id, label, title, score of the best hits.

    Per label in `order` the first max(5, limit) hits by id; a label counts only if the labels before it gave fewer
    than 5 * limit; 100 for an equal name, 80 in the name, 60 in the title, 40 in the content, plus the label's boost."""
    has = lambda c: F.coalesce(F.col(c).contains(query), F.lit(False))
    score = F.when(F.col("name") == query, 100).when(has("name"), 80).when(has("title"), 60).otherwise(40)
    hits = nodes.withColumn("rank", rank_of(F.col("label"), order)).filter(F.col("rank").isNotNull() & (has("name") | has("title") | has("content")))
    w = Window.partitionBy("label").orderBy("id")
    some = hits.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= max(5, limit))
    # a row a label: how many hits the labels before it have
    counts = some.groupBy("rank").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    admitted = counts.withColumn("before", before).filter(F.col("before") < 5 * limit).select("rank")
    kept = some.join(F.broadcast(admitted), "rank")
    out = kept.withColumn("score", (score + lookup(F.col("label"), boost or {}, other)).cast("long"))
    title = F.coalesce(F.nullif("title", F.lit("")), "name")
    return out.orderBy(F.desc("score"), "rank", "k").limit(limit).select("id", "label", title.alias("title"), "score")


def subterms(query: str, terms: Sequence[str] = DOMAIN_TERMS, most: int = 4) -> list[str]:
    """Known terms in a query, then short pieces between particles, and pairs of characters of long ones."""
    found = [t for t in terms if t in query]
    pieces = []
    for piece in map(str.strip, re.split(PARTICLES, query)):
        pieces += [piece] if 2 <= len(piece) <= 4 else [piece[i : i + 2] for i in range(0, len(piece) - 1, 2)] if len(piece) > 4 else []
    out = list(dict.fromkeys([*found, *pieces]))
    known = [t for t in out if t in terms]
    return [t for t in out if t in terms or not any(t in k for k in known)][:most]


def subterm_search(nodes: DataFrame, terms: Sequence[str], order: Sequence[str], per_label: int = 5, boost: dict | None = None) -> DataFrame:
    """Hits of single terms in names, at most per_label a term and label, each id once with its first term."""
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(terms)]))
    hits = nodes.withColumn("rank", rank_of(F.col("label"), order)).filter("rank IS NOT NULL").withColumn("term", table).filter(F.col("name").contains(F.col("term.t")))
    some = hits.withColumn("k", F.row_number().over(Window.partitionBy("term.i", "label").orderBy("id"))).filter(F.col("k") <= per_label)
    once = some.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("term.i"))).filter("n = 1")
    return once.select("id", "label", F.col("name").alias("title"), F.col("term.t").alias("term"), (60 + lookup(F.col("label"), boost or {}, 5)).cast("long").alias("score"))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Cosine, l2 or squared l2 distance of two arrays."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    if metric == "cosine":
        return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    square = F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(square) if metric == "l2" else square


def vector_topk(vectors: DataFrame, query: Sequence[float], k: int = 10, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact top-k; one scan with a bounded heap in each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, distance(F.col(vector), q, metric).alias("distance")).orderBy("distance", key).limit(k)


def fuse(lists: Sequence[DataFrame], k: int = 60, boost: dict | None = None, other: float = 0.001) -> DataFrame:
    """T4: reciprocal rank fusion of tables (id, label, rank from 0): sum of 1 / (k + rank + 1), plus the label's boost."""
    both = None
    for i, one in enumerate(lists):
        part = one.select("id", "label", "rank", F.lit(i).alias("list"))
        both = part if both is None else both.unionByName(part)
    merged = both.groupBy("id").agg(F.sum(1 / (F.col("rank") + (k + 1))).alias("s"), F.min_by("label", "list").alias("label"))
    return merged.select("id", "label", F.round(F.col("s") + lookup(F.col("label"), boost or {}, other), 6).alias("rrf_score"))


def ranked(df: DataFrame, *by) -> DataFrame:
    """df with rank from 0 in this order; for lists that are already cut to a few rows."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*by)) - 1)


def symbol_search(nodes: DataFrame, query: str, order: Sequence[str], limit: int = 20) -> DataFrame:
    """Per label at most `limit` hits by id, then cut in label order."""
    hits = nodes.withColumn("rank", rank_of(F.col("label"), order)).filter(F.col("rank").isNotNull() & F.col("name").contains(query))
    some = hits.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("id"))).filter(F.col("k") <= limit)
    return some.orderBy("rank", "k").limit(limit).select("id", "label", "name")


def stratified(nodes: DataFrame, quotas: dict[str, int], good: Column) -> DataFrame:
    """The first quota rows by id of each label among the good ones."""
    quota = lookup(F.col("label"), quotas, 0)
    w = Window.partitionBy("label").orderBy("id")
    return nodes.filter((quota > 0) & good).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= quota).drop("k")


def budget_sample(nodes: DataFrame, order: Sequence[str], budget: int, minor: Sequence[str] = (), cap: int = 200) -> DataFrame:
    """Labels in order until the budget is used; minor labels give at most `cap`."""
    rank = rank_of(F.col("label"), order)
    rows = nodes.withColumn("rank", rank).filter("rank IS NOT NULL")
    k = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    rows = rows.withColumn("k", k).filter(~F.col("label").isin(*minor) | (F.col("k") <= cap)) if minor else rows.withColumn("k", k)
    sizes = rows.groupBy("rank").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sizes.select("rank", before.alias("before"))), "rank").filter(F.col("before") + F.col("k") <= budget).select("id", "label")


def tiered_context(hits: DataFrame, text: str, full: int = 3, budget: int = 1400, per_token: int = 2) -> DataFrame:
    """The first `full` hits with their text, others by title, as long as the running token estimate fits."""
    part = F.when(F.col("rank") < full, F.coalesce(F.col(text), F.col("title"))).otherwise(F.col("title"))
    tokens = F.floor(F.length(part) / per_token).cast("long")
    total = F.sum("tokens").over(Window.partitionBy().orderBy("rank"))
    return hits.withColumn("part", part).withColumn("tokens", tokens).withColumn("total", total).filter(F.col("total") <= budget).select("id", "rank", "part", "tokens")


def neighbour_edges(vectors: DataFrame, by: str, k: int = 5, most: float = 0.35, key: str = "vec_id", vector: str = "embedding", block: int = 2048) -> DataFrame:
    """A, b, distance: each vector's k nearest of its own group within `most` (cosine).

    A group is dealt into blocks of about `block` rows; each pair of blocks is one matrix product, so a task holds two blocks
    and sends on k rows a vector. The result is exact, so all pairs of a group are measured; rows with null ids or
    vectors, zero vectors and null components take no part."""
    rows = vectors.select(F.col(by).alias("g"), F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull()))
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = rows.join(sizes.withColumnRenamed("g", "__g"), F.col("g").eqNullSafe(F.col("__g"))).drop("__g").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.select("g", F.col("mine").alias("x"), meets.alias("y"), "id", "v")
    right = dealt.select(F.col("g").alias("h"), meets.alias("x"), F.col("mine").alias("y"), F.col("id").alias("rid"), F.col("v").alias("rv")).toDF("h", "rx", "ry", "rid", "rv")
    kind = rows.schema["id"].dataType.simpleString()

    def near(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = {"a": [], "b": [], "distance": []}
        if len(p) and len(q):
            u, v = np.array(p["v"].tolist()), np.array(q["rv"].tolist())
            u, v = (z / np.sqrt((z * z).sum(1))[:, None] for z in (u, v))
            a, b = p["id"].to_numpy(), q["rid"].to_numpy()
            for at in range(0, len(u), 256):
                d = 1 - u[at : at + 256] @ v.T
                d[a[at : at + 256, None] == b] = np.inf
                for i, row in enumerate(d):
                    some = np.flatnonzero(row <= most)
                    if len(some) > k:
                        some = some[row[some] <= np.partition(row[some], k - 1)[k - 1]]
                    some = some[np.lexsort((b[some], row[some]))][:k]
                    found["a"] += [a[at + i]] * len(some)
                    found["b"] += b[some].tolist()
                    found["distance"] += row[some].tolist()
        return pd.DataFrame(found)

    pairs = left.groupBy("g", "x", "y").cogroup(right.groupBy("h", "rx", "ry")).applyInPandas(near, f"a {kind}, b {kind}, distance double")
    w = Window.partitionBy("a").orderBy("distance", "b")
    return pairs.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k).select("a", "b", F.round("distance", 6).alias("distance"))


def structured_dump(questions: DataFrame, dumps: list[tuple[str, DataFrame, list[str], int, list[str]]], cap: int = 40) -> DataFrame:
    """Question, part, line, text: rows of each table (name, rows, columns, limit, words) of which a question holds a word,
    its columns joined by ` | ` under a heading, at most `cap` lines a question.

    The tables' first rows are limits by their first column, so what meets the questions is at most `cap` rows a table."""
    parts = []
    for k, (name, df, columns, limit, words) in enumerate(dumps, 1):
        w = Window.partitionBy(F.lit(0)).orderBy(columns[0])
        first = df.select(*columns).orderBy(columns[0]).limit(min(limit, cap))
        body = first.select(F.row_number().over(w).alias("line"), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("text"))
        head = df.sparkSession.createDataFrame([(0, f"[Structured {name}] {' | '.join(columns)}")], "line int, text string")
        asked = questions.filter(reduce(Column.__or__, [F.lower("question").contains(x) for x in words])).withColumn("part", F.lit(k))
        parts.append(asked.join(F.broadcast(head.union(body).withColumn("p", F.lit(k))), F.col("part") == F.col("p")).drop("p"))
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy("part", "line"))).filter(F.col("n") <= cap).drop("n")
