"""Mixing sources to target weights by entropy balancing.

Rates r_i (expected copies of document i) minimise the relative entropy sum_i m_i (r_i log(r_i / q_i) - r_i + q_i),
m_i tokens, q_i prior rates, under one token constraint a source: sum_i m_i r_i = target. The solution is an
exponential tilt r_i = q_i exp(lambda_source), held at `most` copies; the convex dual is solved by distributed
Newton steps: each is one aggregation of gradient and curvature by source over a table that is pre-aggregated by
(source, prior). Priors differ with a text's length (`length_prior`), so a source's documents have several rates, some of them
held, and its multiplier has no closed form. Rates are then rounded to the copies below or above them by error diffusion: documents of a source
are dealt by hash into cells of about `cell` rows, and each cell keeps its running total of taken tokens as near to
the rates' total as whole documents allow, long documents first so that short ones settle the rest.

Scale: texts are read once, for their word counts, and never shuffled. What follows moves narrow rows. A hot source
has as many cells as its rows ask for. Targets and multipliers are tables; the driver sees only sums of them.

Defined cases: null source is a source of its own, the last one; null or empty texts have size 0 and take 0 words
(copies: the rate, rounded); rows that are equal in all columns get the same place in the order of their cell and
may differ in copies; an empty table gives an empty mix; other columns of the input are carried by `mixed` only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, global_rank, n_words

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
TOLERANCE = 1e-10
STEPS = 60
#: Places where the rows of one source meet its rate.
SALTS = 64


def length_prior(size: Column) -> Column:
    """Prior rate by words: fragments are asked for half as often as others."""
    return F.when(size < 64, 0.5).otherwise(1.0)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of a table (source, source_size) with one row a source.

    Targets are weight shares of `share` times all sizes; those above `most` times their source's size stop there and
    the rest is shared again by weight among the others, until none is above."""
    ranked = global_rank(sizes, [F.col("source")])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    t = durable(ranked.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap")))
    total = (t.agg(F.sum("source_size")).first()[0] or 0) * share
    level, held = 0.0, -1
    while True:
        full = F.col("w") * level >= F.col("cap") if held >= 0 else F.lit(False)
        r = t.agg(F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("w"))).alias("w"), F.count_if(full).alias("n")).first()
        if r["w"] is None or r["n"] == held:
            break
        held, level = r["n"], (total - (r["cap"] or 0.0)) / r["w"]
    return t.select("source", "source_size", F.least(F.col("cap"), F.col("w") * level).cast("double").alias("target"))


def balance(cells: DataFrame, targets: DataFrame, most: float = 2.0) -> DataFrame:
    """source, lambda: the dual's solution. cells: source, prior, tokens; targets: source, target."""
    both = durable(cells.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    at = both.groupBy("source").agg(F.lit(0.0).alias("lambda"), F.lit(-64.0).alias("low"), F.lit(64.0).alias("high"))
    for _ in range(STEPS):
        x = both.join(at.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        raw = F.col("prior") * F.exp("lambda")
        sums = x.groupBy("source").agg(
            *[F.first(c).alias(c) for c in ("lambda", "low", "high", "target")],
            F.sum(F.col("tokens") * F.least(raw, F.lit(most))).alias("got"), F.sum(F.col("tokens") * F.when(raw < most, raw).otherwise(0.0)).alias("curve"),
        )
        # Newton's step, kept between the bounds seen so far: past the cap the dual is straight and has no curvature
        error = F.col("target") - F.col("got")
        off = F.abs(error) > TOLERANCE * F.greatest(F.col("target"), F.lit(1.0))
        sums = sums.withColumn("low", F.when(error > 0, F.col("lambda")).otherwise(F.col("low"))).withColumn("high", F.when(error < 0, F.col("lambda")).otherwise(F.col("high")))
        newton = F.when(F.col("curve") > 0, F.col("lambda") + error / F.col("curve"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        after = F.when(~off, F.col("lambda")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        sums = durable(sums.select("source", after.alias("lambda"), "low", "high", (off & (F.col("high") - F.col("low") > 1e-13)).alias("off")))
        at = sums.drop("off")
        if not sums.filter("off").limit(1).count():
            break
    else:
        raise ArithmeticError(f"the dual has not converged in {STEPS} steps")
    return at.select("source", "lambda")


def _diffuse(most: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h", "doc_id", "none"], ascending=[False, True, True, True], kind="stable")
        sizes, rates = pdf["size"].to_numpy(np.float64), pdf["rate"].to_numpy(np.float64)
        low = np.floor(rates + 1e-9)
        copies = np.empty(len(pdf), np.int64)
        owed = 0.0
        for i, (m, r, b) in enumerate(zip(sizes, rates, low)):
            owed += m * r
            n = b if m == 0 and r - b < 0.5 or m > 0 and (owed - b * m < m / 2 or r - b < 1e-9) else min(b + 1, most)
            copies[i] = n
            owed -= n * m
        return pdf.assign(copies=copies).drop(columns=["rate", "cell", "h"])

    return run


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, cell: int = 20_000, seed: int = 7, prior: Callable[[Column], Column] = length_prior) -> DataFrame:
    """doc_id, source, size, th (hash of the text), source_size, target, rate, copies, taken for every row of df."""
    narrow = durable(df.select(F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("th")).withColumn("prior", prior(F.col("size")).cast("double")))
    cells = durable(narrow.groupBy("source", "prior").agg(F.sum("size").alias("tokens"), F.count("*").alias("n")))
    sizes = durable(cells.groupBy("source").agg(F.sum("tokens").alias("source_size"), F.sum("n").alias("n")))
    targets = source_targets(sizes.drop("n"), weights, share, most)
    cells = cells.select("source", "prior", F.col("tokens").cast("double").alias("tokens"))
    tilt = balance(cells, targets.select("source", "target"), most)
    s = lambda d, n: d.withColumnRenamed("source", n)
    by = sizes.join(s(targets.drop("source_size"), "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").join(s(tilt, "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    by = by.select(F.col("source").alias("s"), "source_size", "target", F.exp("lambda").alias("tilt"), F.ceil(F.col("n") / cell).alias("cells"))
    # a hot source's rows meet its one row of `by` in SALTS places
    by = by.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = narrow.withColumn("h", F.xxhash64("doc_id", "th", F.lit(seed))).withColumn("at", F.pmod("h", F.lit(SALTS)).cast("int"))
    rows = rows.join(by, F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("salt"))).drop("s", "at", "salt")
    rows = rows.withColumn("rate", F.least(F.lit(most), F.col("prior") * F.col("tilt"))).drop("prior", "tilt")
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("h", F.lit("cell")), F.col("cells"))).drop("cells")
    out = "doc_id long, none boolean, source string, size long, th long, source_size long, target double, copies long"
    # pandas has no null among whole numbers: a null id goes as 0 and a flag
    rows = rows.withColumn("none", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")))
    rounded = rows.groupBy("source", "cell").applyInPandas(_diffuse(most), out)
    return rounded.withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id"))).drop("none").withColumn("taken", F.col("copies") * F.col("size"))


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: df's rows, each as often as its copies say.

    Rows that are equal in key, source and text share the sum of their copies: each gets the whole part of the mean, and
    the first ones of them one more, until the sum is dealt."""
    group = lambda k, t, s: [F.xxhash64(k, s, t, F.lit(n)).alias(f"__g{n}") for n in (0, 1)]
    dealt = mix(df, key, text, source, **how).select(*group("doc_id", "th", "source"), "copies")
    dealt = dealt.groupBy("__g0", "__g1").agg(F.sum("copies").alias("__sum"), F.count("*").alias("__n")).filter("__sum > 0")
    rows = df.select("*", *group(F.col(key).cast("long"), F.xxhash64(text), source)).join(dealt, ["__g0", "__g1"])
    nth = F.row_number().over(Window.partitionBy("__g0", "__g1").orderBy("__g0"))
    most = F.floor(F.col("__sum") / F.col("__n")) + F.when(nth <= F.pmod("__sum", "__n"), 1).otherwise(0)
    times = rows.withColumn("__copies", most.cast("int")).filter("__copies > 0").withColumn("__t", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return times.select(*df.columns)
