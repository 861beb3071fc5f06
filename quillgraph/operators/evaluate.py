"""Evaluation records, type-focused subgraphs, document triage and other small compositions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import incident


def score_cases(cases: DataFrame, responses: DataFrame, most: int = 30) -> DataFrame:
    """Q17: anchor recall, keyword overlap, source citation and their mean for each case (id).

    cases: expected_answer, reasoning_anchors, sources; responses: answer, source_strings."""
    j = cases.join(responses, "id", "left").withColumn("answer", F.coalesce("answer", F.lit(""))).withColumn("strings", F.coalesce("source_strings", F.array().cast("array<string>")))
    anchors = F.coalesce("reasoning_anchors", F.array().cast("array<string>"))
    bare = lambda a: F.when(a.contains(":"), F.regexp_replace(a, "^[^:]*:", "")).otherwise(a)
    hit = F.filter(anchors, lambda a: F.exists("strings", lambda s: s.contains(bare(a))) | F.col("answer").contains(bare(a)))
    words = F.slice(F.array_distinct(F.regexp_extract_all("expected_answer", F.lit(r"([\x{4e00}-\x{9fff}]{2,}|[A-Za-z]{4,})"))), 1, most)
    found = F.filter(words, lambda w: F.col("answer").contains(w))
    sources = F.coalesce("sources", F.array().cast("array<string>"))
    cited = F.filter(sources, lambda s: F.exists(F.filter(F.split(s, r"[\s§【】\[\]()（）]+"), lambda t: F.length(t) >= 2), lambda t: F.col("answer").contains(t)))
    share = lambda a, b: F.size(a) / F.greatest(F.size(b), F.lit(1))
    out = j.select("id", *[c for c in ("domain", "difficulty") if c in cases.columns], share(hit, anchors).alias("a"), share(found, words).alias("k"), share(cited, sources).alias("s"))
    mean = F.round((F.col("a") + F.col("k") + F.col("s")) / 3, 4)
    return out.withColumn("composite", mean).withColumn("anchor_recall", F.round("a", 4)).withColumn("keyword_overlap", F.round("k", 4)).withColumn("source_citation", F.round("s", 4)).drop("a", "k", "s")


def averages(scored: DataFrame, value: str, *by: str) -> DataFrame:
    """Q18: overall and by each dimension in one pass."""
    sets = [F.col(b) for b in by]
    g = scored.rollup(*sets) if len(by) == 1 else scored.groupingSets([[], *[[s] for s in sets]], *sets)
    return g.agg(F.round(F.avg(value), 4).alias("mean"), F.count("*").alias("n"))


def type_subgraph(nodes: DataFrame, edges: DataFrame, label: str, seeds: int = 100, expanded: int = 80, per_side: int = 10, neighbours: int = 200) -> DataFrame:
    """Edges of the subgraph around a label's first nodes: seeds, their first neighbours each way, and what links them."""
    w = Window.partitionBy(F.lit(0)).orderBy("id")
    first = nodes.filter(F.col("label") == label).select("id").orderBy("id").limit(seeds)
    some = first.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= expanded).select(F.col("id").alias("node"))
    side = Window.partitionBy("node", "direction").orderBy("rel_type", "other")
    near = incident(edges).join(some, "node").withColumn("k", F.row_number().over(side)).filter(F.col("k") <= per_side)
    others = near.select(F.col("other").alias("id")).distinct().join(first, "id", "left_anti").orderBy("id").limit(neighbours)
    ids = first.union(others).distinct()
    from .graph import co_presence

    return co_presence(edges, ids, per_rel=10**9).distinct()


def rescue(nodes: DataFrame, edges: DataFrame, sample: DataFrame, most: int = 50, each: int = 5) -> DataFrame:
    """Up to `each` outgoing edges of up to `most` sampled nodes that no edge of the sample touches."""
    inside = edges.join(sample.select(F.col("id").alias("src")), "src", "left_semi").join(sample.select(F.col("id").alias("dst")), "dst", "left_semi")
    touched = inside.select(F.col("src").alias("id")).union(inside.select("dst")).distinct()
    alone = sample.select("id").join(touched, "id", "left_anti").orderBy("id").limit(most)
    w = Window.partitionBy("src").orderBy("rel_type", "dst")
    return edges.join(alone.select(F.col("id").alias("src")), "src").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= each).select("src", "dst", "rel_type")


def short_sources(nodes: DataFrame, edges: DataFrame, rel: str, least: int = 5) -> DataFrame:
    """Edges of a relation whose source has no readable label."""
    e = edges.filter(F.col("rel_type") == rel).join(nodes.select(F.col("id").alias("src"), F.coalesce("title", "name").alias("t")), "src")
    return e.agg(F.count_if(F.col("t").isNull() | (F.length("t") < least)).alias("unlabeled"))


def path_bucket(path: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """First bucket whose pattern a path matches."""
    out = F.when(F.lit(False), F.lit(default))
    for bucket, pattern in rules:
        out = out.when(path.rlike(pattern), F.lit(bucket))
    return out.otherwise(F.lit(default))


def contract_diff(used: DataFrame, offered: DataFrame) -> DataFrame:
    """Path, status: used only, offered only or both."""
    u = used.select(F.regexp_replace("path", r"\{[^}]*\}|:[^/]+", "*").alias("path")).distinct().withColumn("u", F.lit(1))
    o = offered.select(F.regexp_replace("path", r"\{[^}]*\}|:[^/]+", "*").alias("path")).distinct().withColumn("o", F.lit(1))
    status = F.when(F.col("u").isNull(), "unused").when(F.col("o").isNull(), "missing").otherwise("ok")
    return u.join(o, "path", "full_outer").select("path", status.alias("status"))


def metadata_composite(df: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """Share of rows with any field, 90 per cent for full marks."""
    some = reduce(Column.__or__, [F.coalesce(F.length(F.col(f).cast("string")) > 0, F.lit(False)) for f in fields])
    return df.groupBy(by).agg(F.count("*").alias("sampled"), F.round(F.least(F.count_if(some) / F.count("*") * 100 / 90 * 100, F.lit(100.0)), 1).alias("score"))


def clause_references(clauses: DataFrame) -> DataFrame:
    """Src, dst within a regulation from `artN;artM` references; the last clause of a repeated article counts."""
    last = clauses.groupBy("regulation_id", F.col("article_number").alias("n")).agg(F.max("id").alias("dst"))
    refs = clauses.withColumn("r", F.explode(F.split("referenced_clauses", ";"))).withColumn("n", F.regexp_extract("r", r"art(\d+)", 1).try_cast("bigint"))
    return refs.join(last, ["regulation_id", "n"]).filter("id <> dst").select(F.col("id").alias("src"), "dst").distinct()


def document_links(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Src, dst: a link's file stem against documents of the same folder; dangling links are dropped."""
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[A-Za-z]+(#.*)?$", "")
    folder = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    d = docs.select(F.col("id").alias("dst"), stem(F.col("path")).alias("s"), folder(F.col("path")).alias("f"))
    return links.select(F.col("id").alias("src"), stem(F.col("target")).alias("s"), folder(F.col("path")).alias("f")).join(d, ["s", "f"]).select("src", "dst").distinct()


def changed_symbols(files: DataFrame, symbols: DataFrame, per_kind: int = 50) -> DataFrame:
    """Symbols of changed files, at most per_kind of a kind and file."""
    w = Window.partitionBy("file_path", "kind").orderBy("start_line", "node_id")
    hit = symbols.join(F.broadcast(files.select(F.col("path").alias("file_path")).distinct()) if files.limit(10001).count() <= 10000 else files.select(F.col("path").alias("file_path")).distinct(), "file_path")
    return hit.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_kind).drop("k")
