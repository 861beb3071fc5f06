"""Data quality: coverage, density, scores, gates, the lineage survey and the ontology audit.

Everything is one aggregation by label over the unified tables; gates are expressions on its few rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import is_blank, strip
from ..functions.text import is_placeholder, junk_reason

CRITICAL = ("effective_from", "confidence", "source_doc_id", "jurisdiction_code", "jurisdiction_scope")
LINEAGE_STRINGS = ("source_doc_id", "extracted_by", "reviewed_by", "jurisdiction_code", "override_chain_id")
# Assumed values: scopes and codes that the survey's cases name.
SCOPES = ("national", "subnational", "municipal", "experimental_zone", "trade_port", "special_economic_zone")
CODE_SCOPES = {"CN": ("national",), "CN-31": ("subnational",), "CN-HK": ("subnational",), "CN-GBA": ("subnational",), "CN-FTZ-SHA": ("experimental_zone",), "CN-HFTP": ("trade_port",)}
STALE_YEARS, NULL_COVERAGE, DEFECT_RATE, SAMPLE = 10, 0.50, 0.10, 100


def _with(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with absent columns as nulls."""
    return df.withColumns({c: F.lit(None).cast("string") for c in columns if c not in df.columns})


def stale(c: Column, today: Column, years: int = STALE_YEARS) -> Column:
    """F16: more than 365 * years days before today; what is no ISO date is not stale."""
    date = F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(c, "yyyy-M-d"))
    return F.coalesce(F.datediff(today, date) > 365 * years, F.lit(False))


def mismatch(code: Column, scope: Column) -> Column:
    """Q5: an unknown scope, or a code without scope or the other way round."""
    return F.when(~is_blank(scope) & ~scope.isin(*SCOPES), True).otherwise(is_blank(code) != is_blank(scope))


def inconsistent(code: Column, scope: Column) -> Column:
    """Q11: a known code with a scope that it does not go with."""
    good = reduce(Column.__or__, [(code == k) & scope.isin(*v) for k, v in CODE_SCOPES.items()])
    return F.coalesce(code.isin(*CODE_SCOPES) & ~good, F.lit(False))


def survey(rows: DataFrame, today: str, label: str = "label", sample: int | None = SAMPLE) -> DataFrame:
    """Q1-Q12: a row a label with nine counts of defects, their sum and rate, and PASS or FAIL.

    Columns that rows lack count as null. With `sample`, the first rows of each label by id are looked at."""
    columns = {*CRITICAL, *LINEAGE_STRINGS, "id", "reviewed_at", "reviewed_by", "argument_role"}
    rows = _with(rows, sorted(columns))
    if sample is not None:
        w = Window.partitionBy(label).orderBy("id", *sorted(columns - {"id"}))
        rows = rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= sample)
    text = lambda c: F.col(c).cast("string")
    now = F.lit(today).cast("date")
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    one = rows.groupBy(label).agg(
        F.count("*").alias("sampled"),
        (F.count("*") - F.count_distinct("id") - F.max(F.col("id").isNull().cast("int"))).alias("duplicates"),
        count(stale(text("effective_from"), now)).alias("stale"),
        count(is_blank(text("reviewed_at")) != is_blank(text("reviewed_by"))).alias("integrity_violations"),
        count(mismatch(text("jurisdiction_code"), text("jurisdiction_scope"))).alias("jurisdiction_mismatches"),
        reduce(Column.__add__, [count(is_placeholder(text(c))) for c in LINEAGE_STRINGS]).alias("placeholder_strings"),
        count(text("argument_role") == "analogy").alias("prohibited_role"),
        count(text("override_chain_id").isNotNull() & ~text("override_chain_id").isin(*CODE_SCOPES)).alias("invalid_chain"),
        count(inconsistent(text("jurisdiction_code"), text("jurisdiction_scope"))).alias("inconsistent_scope"),
        *[F.round(F.avg(is_blank(text(c)).cast("int")), 4).alias(f"null_{c}") for c in CRITICAL],
    )
    over = reduce(Column.__add__, [(F.col(f"null_{c}") >= NULL_COVERAGE).cast("long") for c in CRITICAL])
    one = one.withColumn("null_coverage_violations", over)
    parts = ("duplicates", "stale", "integrity_violations", "jurisdiction_mismatches", "null_coverage_violations", "placeholder_strings", "prohibited_role", "invalid_chain", "inconsistent_scope")
    one = one.withColumn("defects_total", reduce(Column.__add__, map(F.col, parts)))
    one = one.withColumn("defect_rate", F.round(F.col("defects_total") / F.col("sampled"), 4))
    return one.withColumn("verdict", F.when(F.col("defect_rate") <= DEFECT_RATE, "PASS").otherwise("FAIL"))


def survey_total(per_label: DataFrame) -> DataFrame:
    """Q12: sums over all labels, overall rate and verdict."""
    t = per_label.agg(F.count("*").alias("labels"), F.sum("sampled").alias("sampled"), F.sum("defects_total").alias("defects_total"))
    t = t.withColumn("defect_rate", F.round(F.col("defects_total") / F.col("sampled"), 4))
    return t.withColumn("verdict", F.when(F.coalesce(F.col("defect_rate"), F.lit(0.0)) <= DEFECT_RATE, "PASS").otherwise("FAIL"))


def title_coverage(nodes: DataFrame, fields: Sequence[str], least: int = 2) -> DataFrame:
    """A4: label, total, with_title (the best single field), coverage, severity of the issue if any."""
    best = F.greatest(*[F.count_if(F.coalesce(F.length(f) >= least, F.lit(False))) for f in fields], F.lit(0))
    out = nodes.groupBy("label").agg(F.count("*").alias("total"), best.alias("with_title"))
    out = out.withColumn("coverage", F.round(F.col("with_title") / F.col("total"), 3))
    return out.withColumn("severity", F.when(F.col("coverage") < 0.5, "high").when(F.col("coverage") < 0.95, "medium"))


def graph_score(nodes: DataFrame, edges: DataFrame, titles: Sequence[str], contents: Sequence[str]) -> DataFrame:
    """One row with coverages, density, score and gate."""
    t = title_coverage(nodes, titles).agg(F.sum("total").alias("total_nodes"), F.sum("with_title").alias("with_title"))
    c = title_coverage(nodes, contents, 20).agg(F.sum("with_title").alias("with_content"))
    e = edges.agg(F.count("*").alias("total_edges"))
    one = t.join(c).join(e)  # one row each
    share = lambda n: F.round(F.col(n) / F.col("total_nodes"), 3)
    one = one.select("total_nodes", "total_edges", share("with_title").alias("title_coverage"), share("with_content").alias("content_coverage"), share("total_edges").alias("density"))
    score = F.lit(100) - F.greatest(F.lit(0.0), (F.lit(0.95) - F.col("title_coverage")) * 100) - F.greatest(F.lit(0.0), (F.lit(0.5) - F.col("density")) * 50)
    one = one.withColumn("score", F.greatest(F.lit(0), F.round(score).cast("int")).cast("long"))
    return one.withColumn("gate", F.when(F.col("score") >= 60, "PASS").otherwise("FAIL"))


def score_variant(score: DataFrame, isolated: DataFrame, high_issues: DataFrame) -> DataFrame:
    """Isolated nodes cost up to 20 points, and any high issue fails the gate."""
    one = score.join(isolated.agg(F.count("*").alias("isolated"))).join(high_issues.agg(F.count("*").alias("high_issues")))
    cut = F.least(F.lit(20.0), F.col("isolated") / F.col("total_nodes") * 200)
    one = one.withColumn("score", F.greatest(F.lit(0), F.round(F.col("score") - cut).cast("int")).cast("long"))
    return one.withColumn("gate", F.when((F.col("score") >= 60) & (F.col("high_issues") == 0), "PASS").otherwise("FAIL"))


def length_histogram(df: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """A9."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    band = lambda lo, hi: F.count_if((n >= lo) & (n < hi))
    return df.groupBy(*by).agg(band(0, 5).alias("empty"), band(5, 50).alias("short"), band(50, 200).alias("medium"), band(200, 500).alias("good"), F.count_if(n >= 500).alias("rich"))


def text_composite(df: DataFrame, by: str, text: str, terms: Sequence[str], junk: Column | None = None) -> DataFrame:
    """Length 30, authenticity 20, domain 25, uniqueness 15, fill 10."""
    c = F.coalesce(F.col(text), F.lit(""))
    n = F.length(c)
    bad = junk_reason(c) != "ok" if junk is None else junk
    hits = reduce(Column.__add__, [c.contains(t).cast("int") for t in terms])
    a = df.groupBy(by).agg(
        F.count("*").alias("sampled"), F.count_if(n < 5).alias("empty"), F.count_if((n >= 50) & (n < 200)).alias("medium"),
        F.count_if((n >= 200) & (n < 500)).alias("good"), F.count_if(n >= 500).alias("rich"),
        F.count_if((n >= 20) & ~bad).alias("real"), F.count_if((n >= 20) & bad).alias("junk"),
        F.count_if(hits >= 2).alias("domain"), F.count_distinct(F.when(n >= 20, F.left(c, F.lit(100)))).alias("unique"),
    )
    pct = lambda x, of: F.when(of > 0, x / of * 100).otherwise(F.lit(0.0))
    s, filled = F.col("sampled"), F.col("sampled") - F.col("empty")
    total = (
        (F.col("medium") + F.col("good") * 2 + F.col("rich") * 3) / (s * 3) * 30 + F.least(pct(F.col("real"), filled) / 80 * 20, F.lit(20.0))
        + F.least(pct(F.col("domain"), s) / 80 * 25, F.lit(25.0)) + F.least(pct(F.col("unique"), s) / 90 * 15, F.lit(15.0)) + pct(filled, s) / 100 * 10
    )
    a = a.withColumn("score", F.round(total, 1)).withColumn("junk_pct", F.round(pct(F.col("junk"), filled), 1))
    return a.withColumn("gate", F.when((F.col("score") >= 70) & (F.col("junk_pct") <= 50), "PASS").otherwise("FAIL"))


def structured_composite(df: DataFrame, by: str, required: Sequence[str]) -> DataFrame:
    """Completeness 60, uniqueness 30, fill 10."""
    filled = [F.coalesce(F.length(strip(F.col(f).cast("string"))) >= 1, F.lit(False)) for f in required]
    key = F.concat_ws("|", *[F.left(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(30)) for f in required])
    a = df.groupBy(by).agg(F.count("*").alias("sampled"), F.count_if(reduce(Column.__and__, filled)).alias("complete"), F.count_distinct(key).alias("unique"), F.count_if(reduce(Column.__or__, filled)).alias("filled"))
    s = F.col("sampled")
    score = F.least(F.col("complete") / s * 100 / 90 * 60, F.lit(60.0)) + F.least(F.col("unique") / s * 100 / 90 * 30, F.lit(30.0)) + F.col("filled") / s * 10
    return a.withColumn("score", F.round(score, 1))


def overall(scores: DataFrame) -> DataFrame:
    """Mean weighted by rows over types that score, PASS from 70 without a failing type."""
    one = scores.filter("score > 0").agg(F.round(F.sum(F.col("score") * F.col("sampled")) / F.sum("sampled"), 1).alias("score"))
    fails = scores.agg(F.count_if(F.col("score") < 70).alias("failing"))
    return one.join(fails).withColumn("gate", F.when((F.col("score") >= 70) & (F.col("failing") == 0), "PASS").otherwise("FAIL"))


def junk_audit(df: DataFrame, by: str, text: str) -> DataFrame:
    """Counts of empty, junk and real texts with the junk's share and status."""
    reason = junk_reason(F.col(text))
    a = df.groupBy(by).agg(F.count("*").alias("total"), F.count_if(reason == "empty_or_too_short").alias("empty"), F.count_if(~reason.isin("ok", "empty_or_too_short")).alias("junk"), F.count_if(reason == "ok").alias("real"))
    a = a.withColumn("ratio", F.round((F.col("empty") + F.col("junk")) / F.col("total"), 4))
    return a.withColumn("status", F.when(F.col("ratio") < 0.1, "ok").when(F.col("ratio") < 0.3, "warn").otherwise("bad"))


def min_rows(canonical: DataFrame, counts: DataFrame, thresholds: DataFrame, default: int = 1000) -> DataFrame:
    """Q13: name, rows, threshold, passes, tier for every canonical name."""
    t = canonical.select("name").distinct().join(counts, "name", "left").join(F.broadcast(thresholds), "name", "left")
    rows = F.coalesce(F.col("rows"), F.lit(0)).cast("long")
    least = F.coalesce(F.col("min_rows"), F.lit(default)).cast("long")
    tier = F.when(rows == 0, "empty").when(rows < 50, "tiny").when(rows < 500, "small").otherwise("ok")
    return t.select("name", rows.alias("rows"), least.alias("threshold"), (rows >= least).alias("passes"), tier.alias("tier"))


def ontology_gate(checks: DataFrame, live: DataFrame, canonical: DataFrame, target: float = 0.5) -> DataFrame:
    """Rogue and missing names, coverage by rows and verdict."""
    flags = live.select("name", F.lit(1).alias("live")).join(canonical.select("name", F.lit(1).alias("declared")), "name", "full_outer")
    sums = flags.agg(F.count_if(F.col("declared").isNull()).alias("rogue"), F.count_if(F.col("live").isNull()).alias("missing"), F.count_if(F.col("live").isNotNull() & F.col("declared").isNotNull()).alias("matched"))
    ratio = checks.agg(F.round(F.avg(F.col("passes").cast("int")), 3).alias("ratio"))
    one = sums.join(ratio)
    severity = F.when((F.col("rogue") == 0) & (F.col("missing") == 0), "ok").when(F.col("missing") > 0, "high").otherwise("medium")
    return one.withColumn("severity", severity).withColumn("verdict", F.when((severity == "ok") & (F.col("ratio") >= target), "PASS").otherwise("FAIL"))


def vote_gate(votes: DataFrame, by: str = "node") -> DataFrame:
    """Q19: by the number of passing votes: inject, review or reject, with a confidence."""
    a = votes.groupBy(by).agg(F.count_if("passed").alias("passes"), F.avg("confidence").alias("mean"))
    decision = F.when(F.col("passes") >= 4, "auto_inject").when(F.col("passes") == 3, "human_review").otherwise("reject")
    confidence = F.when(F.col("passes") >= 4, F.greatest(F.lit(0.95), F.col("mean"))).when(F.col("passes") == 3, F.least(F.lit(0.70), F.col("mean"))).otherwise(F.col("mean"))
    return a.select(by, "passes", decision.alias("decision"), F.round(confidence, 4).alias("confidence"))


def confusion(df: DataFrame, by: str, expected: str, accepted: str) -> DataFrame:
    """Counts by category, accuracy and share of false positives."""
    e, a = F.col(expected), F.col(accepted)
    out = df.groupBy(by).agg(F.count("*").alias("total"), F.count_if(e & a).alias("tp"), F.count_if(~e & a).alias("fp"), F.count_if(e & ~a).alias("fn"), F.count_if(~e & ~a).alias("tn"))
    return out.withColumn("accuracy", F.round((F.col("tp") + F.col("tn")) / F.col("total"), 4)).withColumn("fp_share", F.round(F.col("fp") / F.col("total"), 4))
