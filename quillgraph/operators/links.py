"""Edge builders: foreign keys, keywords, references, name resolution, time, pairs and products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, title_terms
from .automaton import PART_BYTES, contained
from .intervals import as_of  # noqa: F401 (J33)


def key_edges(df: DataFrame, src: Column, dst: Column, rel: str) -> DataFrame:
    """Edges from a key (or an expression on one) in the source rows."""
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel_type")).filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def mapped_edges(df: DataFrame, src: str, value: str, mapping: DataFrame) -> DataFrame:
    """Src, value, dst through a value mapping (value, dst); `unmapped` where the mapping lacks the value."""
    m = mapping.select(F.col("value").alias("__v"), "dst")
    return df.select(F.col(src).alias("src"), F.col(value).alias("value")).join(m, F.col("value") == F.col("__v"), "left").select("src", "value", "dst", F.col("dst").isNull().alias("unmapped"))


def tiered_lookup(tokens: DataFrame, names: DataFrame, aliases: DataFrame, token: str = "token") -> DataFrame:
    """Token, id, tier: equal name, else the alias's name, else the name before the first `-`."""
    n = names.groupBy("name").agg(F.min("id").alias("id"))
    head = F.when(F.col(token).contains("-"), F.trim(F.split_part(token, F.lit("-"), F.lit(1))))
    out = tokens.select(token).distinct().join(aliases.select(F.col("alias").alias(token), F.col("name").alias("__alias")), token, "left").withColumn("__head", head)
    for i, c in enumerate((token, "__alias", "__head"), 1):
        out = out.join(n.toDF(f"__n{i}", f"__id{i}"), F.col(c) == F.col(f"__n{i}"), "left")
    found = F.coalesce("__id1", "__id2", "__id3")
    tier = F.when(F.col("__id1").isNotNull(), 1).when(F.col("__id2").isNotNull(), 2).when(F.col("__id3").isNotNull(), 3)
    return out.select(token, found.alias("id"), tier.alias("tier"))


def keyword_links(texts: DataFrame, keywords: DataFrame, key: str, text: str, window: int | None = None, first_only: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """Key, keyword for each keyword (keyword, seq) contained in a text's first `window` characters (or all);
    first_only keeps the one with the least seq. Null and empty keywords are in no text."""
    body = F.left(F.col(text), F.lit(window)) if window else F.col(text)
    met = contained(texts, F.col(key), body, keywords, part_bytes)
    if first_only:
        return met.groupBy("key").agg(F.min_by("keyword", F.struct("seq", "keyword")).alias("keyword"))
    return met.select("key", "keyword").distinct()


def maximal_links(texts: DataFrame, keywords: DataFrame, key: str, text: str) -> DataFrame:
    """Key, keyword without those that another keyword of the same text contains.

    Which keyword contains which is asked once, of the dictionary itself."""
    words = keywords.select("keyword", "seq")
    inside = contained(words.distinct(), F.col("keyword"), F.col("keyword"), words).filter("key <> keyword").select(F.col("key").alias("longer"), F.col("keyword").alias("inner"))
    met = keyword_links(texts, keywords, key, text)
    covered = met.join(inside, F.col("keyword") == F.col("longer")).select("key", F.col("inner").alias("keyword"))
    return met.join(covered, ["key", "keyword"], "left_anti")


def references(units: DataFrame, titles: DataFrame, refs: Column, cut: int = 15, least: int = 4) -> DataFrame:
    """Id, ref, target: each reference's first title (least id) that starts with its first `cut` characters."""
    r = units.select("id", F.explode(refs).alias("ref")).withColumn("part", F.left("ref", F.lit(cut))).filter(F.length("part") >= least).distinct()
    parts = r.select("part").distinct()
    sizes = titles.select(F.col("id").alias("target"), "title").withColumn("n", F.explode(F.sequence(F.lit(least), F.lit(cut))))
    heads = sizes.filter(F.length("title") >= F.col("n")).select("target", F.left("title", F.col("n")).alias("part")).distinct()
    first = parts.join(heads, "part").groupBy("part").agg(F.min("target").alias("target"))
    return r.join(first, "part").select("id", "ref", "target")


def title_lookup(refs: DataFrame, titles: DataFrame, prefix: str, least: int = 4) -> DataFrame:
    """Id, ref, target, form: each reference (id, ref) against an index of titles (target, title): by the whole title, else by
    titles without `prefix`. Titles of under `least` characters are not indexed; of several targets the least counts."""
    whole = titles.select("target", F.col("title").alias("name"), F.lit(0).alias("form"))
    short = whole.select("target", F.replace("name", F.lit(prefix), F.lit("")).alias("name"), F.lit(1).alias("form"))
    index = whole.union(short).filter(F.length("name") >= least).groupBy("name").agg(F.min(F.struct("form", "target")).alias("t"))
    found = refs.select("id", "ref").join(index, F.col("ref") == F.col("name"))
    return found.select("id", "ref", F.col("t.target").alias("target"), F.when(F.col("t.form") == 0, "title").otherwise("short").alias("form"))


def resolve_names(calls: DataFrame, symbols: DataFrame, most: int = 3) -> DataFrame:
    """Src, name, dst, confidence: a call's name against symbols (node_id, name, seq), at most `most` in order;
    without any, an external node."""
    w = Window.partitionBy("name").orderBy("seq", "node_id")
    known = symbols.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("name"))).filter(F.col("k") <= most).select("name", F.col("node_id").alias("dst"), "n")
    out = calls.join(known, "name", "left")
    found = F.col("dst").isNotNull()
    confidence = F.when(F.col("n") == 1, F.lit(0.95)).when(found, F.least("confidence", F.lit(0.6))).otherwise(F.least("confidence", F.lit(0.4)))
    return out.select("src", "name", F.coalesce("dst", F.concat(F.lit("external:"), F.col("name"))).alias("dst"), confidence.alias("confidence")).distinct()


def last_writer(files: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """For keys that several rows claim, the row with the greatest seq."""
    return files.groupBy(key).agg(F.max_by(value, seq).alias(value))


def version_chain(df: DataFrame, base: str, year: str, key: str) -> DataFrame:
    """Newer, older: neighbours in year order within a base title, where the years differ."""
    w = Window.partitionBy(base).orderBy(F.desc(year), key)
    pairs = df.select(F.col(key).alias("newer"), F.lead(key).over(w).alias("older"), F.col(year).alias("y"), F.lead(year).over(w).alias("y2"))
    return pairs.filter(F.col("y") > F.col("y2")).select("newer", "older")


def adjacency_chain(df: DataFrame, by: str, key: str, most: int = 20) -> DataFrame:
    """Each of a group's first `most` rows with the next one."""
    w = Window.partitionBy(by).orderBy(key)
    return df.select(F.col(key).alias("a"), F.lead(key).over(w).alias("b"), F.row_number().over(w).alias("k")).filter((F.col("k") < most) & F.col("b").isNotNull()).select("a", "b")


def next_in_order(df: DataFrame, by: str, order: str, key: Column) -> DataFrame:
    """W7."""
    w = Window.partitionBy(by).orderBy(order)
    return df.select(key.alias("a"), F.lead(key).over(w).alias("b")).filter("b IS NOT NULL")


def similar_titles(df: DataFrame, by: str, title: str, date: str, key: str, least: float = 0.5, most: int = 200) -> DataFrame:
    """Newer, older: pairs of a group's `most` newest rows whose titles share at least half of their terms."""
    w = Window.partitionBy(by).orderBy(F.desc(date), key)
    few = df.select(F.col(by).alias("g"), F.col(key).alias("id"), F.col(date).alias("at"), title_terms(F.col(title)).alias("terms"), F.row_number().over(w).alias("k")).filter(F.col("k") <= most)
    a, b = few.toDF("g", "newer", "at1", "t1", "k1"), few.toDF("g", "older", "at2", "t2", "k2")
    met = a.join(b, "g").filter("k1 < k2 AND at1 <> at2")
    return met.filter(jaccard(F.col("t1"), F.col("t2")) >= least).select("newer", "older")


def product(left: DataFrame, right: DataFrame, applies: DataFrame, on_left: str, on_right: str) -> DataFrame:
    """Pairs that an applicability table (left key, right key) allows: two equi-joins, never all pairs."""
    return left.join(applies, on_left).join(right, on_right)


def overlap(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Number of keys that both have."""
    return a.select(key).distinct().join(b.select(key).distinct(), key).agg(F.count("*").alias("overlap"))


def only_new(new: DataFrame, existing: DataFrame, on: Sequence[str] = ("src", "dst")) -> DataFrame:
    """J26, U4."""
    return new.dropDuplicates(list(on)).join(existing, list(on), "left_anti")


def adopt(orphans: DataFrame, target: str, rel: str) -> DataFrame:
    """Orphans linked to one default node."""
    return orphans.select(F.col("id").alias("src"), F.lit(target).alias("dst"), F.lit(rel).alias("rel_type"))


def bilingual(df: DataFrame, stem: str, lang: str, key: str, one: str = "en", two: str = "zh") -> DataFrame:
    """Ids of the two language versions of one document."""
    a = df.filter(F.col(lang) == one).select(F.col(stem).alias("stem"), F.col(key).alias("a"))
    b = df.filter(F.col(lang) == two).select(F.col(stem).alias("stem"), F.col(key).alias("b"))
    return a.join(b, "stem").select("stem", "a", "b")


def valid_at(facts: DataFrame, when: Column, start: str = "effective_at", end: str = "superseded_at") -> DataFrame:
    """Facts in force at a time: open ends count, the end itself does not."""
    return facts.filter((F.col(start).isNull() | (F.col(start) <= when)) & (F.col(end).isNull() | (when < F.col(end))))


def longest_match(texts: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """B1: for each text the longest name (id, name, seq) that it contains, the first one on ties."""
    best = F.max_by("id", F.struct(F.length("name"), -F.col("seq")))
    pairs = keyword_links(texts, names.select(F.col("name").alias("keyword"), "seq"), key, text)
    return pairs.join(names, F.col("keyword") == F.col("name")).groupBy("key").agg(best.alias("id"))


def inherit(edges: DataFrame, nodes: DataFrame, least: int = 100, cut: int = 2000) -> DataFrame:
    """Child, content: short children get the start of their parent's content (src child, dst parent; the parent
    with the least id on several)."""
    size = F.length(F.coalesce("content", F.lit("")))
    short = nodes.filter(size < least).select(F.col("id").alias("src"))
    rich = nodes.filter(size >= least).select(F.col("id").alias("dst"), F.left("content", F.lit(cut)).alias("content"))
    return edges.join(short, "src").join(rich, "dst").groupBy(F.col("src").alias("child")).agg(F.min_by("content", "dst").alias("content"))
