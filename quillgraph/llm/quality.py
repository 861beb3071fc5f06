"""Quality classifier: random Fourier features, partition-summed normal equations, isotonic calibration.

A document is described by statistics of its whole text (sizes, character classes, repetition, entropy). A Gaussian
kernel over the standardised statistics is approximated by random Fourier features; ridge regression on them is
fitted from normal equations that each partition sums by itself, and isotonic regression on rows that the ridge fit
has not seen turns its output into a probability.

Labels are learned from a bounded sample: the `fit_rows` labelled rows with the smallest keyed hash of their id. Only
those ids are broadcast (8 bytes each), texts are never shuffled, and scoring is one row-local pass.

Inputs of a score: the text and nothing else. Defined cases: null text counts as empty and gets the score of an
empty text; labels that are null are ignored, repeated ones averaged; without any label, or with one class only,
every score is that class's rate (0.5 without labels); repeated rows score alike; empty tables give no rows; other
columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log, log1p, sqrt
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, whole_texts

FIT_ROWS = 20_000
FEATURES = 256
RIDGE = 1e-2
SEED = 11
#: Standardised statistics are held within so many deviations.
CLIP = 4.0

_PUNCTUATION = frozenset(".,;:?!'\"()-")
_CLASS = np.zeros(0x500, np.uint8)  # 0 letter, 1 upper, 2 digit, 3 space, 4 punctuation, 5 other symbol
for _i in range(0x500):
    _ch = chr(_i)
    _CLASS[_i] = 3 if _ch.isspace() else 2 if _ch.isdigit() else 1 if _ch.isupper() else 0 if _ch.isalpha() else 4 if _ch in _PUNCTUATION else 5


def statistics(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_CLASS[np.minimum(code, 0x4FF)], minlength=6)
    letters = max(1, int(kinds[0] + kinds[1]))
    share = np.bincount(np.minimum(code, 0x4FF))
    share = share[share > 0] / chars
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    ends = [w[-1] for w in words]
    odd = sum(1 for e in ends if not e.isalnum() and e not in _PUNCTUATION)
    return [
        log1p(len(text)), log1p(len(words)), min(30.0, float(sizes.mean())), min(30.0, float(sizes.std())),
        kinds[1] / letters, kinds[2] / chars, kinds[4] / chars, kinds[5] / chars, odd / n, ends.count("!") / n, ends.count(".") / n,
        sum(1 for w in words if len(w) == 1 and not w.isalnum()) / n, log1p(len(counts)) / log(n + 2), counts.most_common(1)[0][1] / n if counts else 0.0,
        sum(map(eq, words, words[1:])) / n, pairs / n, log1p(len(text) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        float((sizes <= 3).mean()), float(-(share * np.log2(share)).sum()),
    ]


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    x: np.ndarray  # calibration: raw scores, ascending
    y: np.ndarray  # and their probabilities

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([np.ones((len(z), 1)), sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, texts: pd.Series) -> np.ndarray:
        if not len(texts):
            return np.empty(0)
        return np.interp(self.raw(np.array([statistics(t) for t in texts])), self.x, self.y)


def isotonic(raw: np.ndarray, y: np.ndarray, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; each block's mean, drawn to the rate of all by `smooth` rows, stands at its middle."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of raw
    for r, v in zip(raw[order], y[order]):
        blocks.append([v, 1, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    rate = float(y.mean())
    means = np.array([(s + smooth * rate) / (n + smooth) for s, n, _ in blocks])
    return np.array([x / n for _, n, x in blocks]), np.maximum.accumulate(means)


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """y and the statistics of at most fit_rows documents of at most fit_rows labelled ids, none of them held out."""
    y = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("__key")).agg(F.avg(label).alias("__y"))
    y = y.orderBy(F.xxhash64("__key", F.lit(SEED)), "__key").limit(fit_rows)
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(durable(y)), "__key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"k": p["__key"], "y": p["__y"], "s": [statistics(t) for t in p["__text"]]})

    # an id may stand on many rows: the bound holds for rows too
    return durable(rows.mapInPandas(run, "k long, y double, s array<double>").orderBy(F.xxhash64("k", "s", F.lit(SEED)), "k", "s").limit(fit_rows))


def _sums(model: Model):
    """Normal equations, summed in each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = model.w.shape[1] + 1
        a, c = np.zeros((d, d)), np.zeros(d)
        for p in batches:
            if len(p):
                x = model.features(np.array(p["s"].tolist()))
                a += x.T @ x
                c += x.T @ p["y"].to_numpy()
        yield pd.DataFrame({"a": [a.tobytes()], "c": [c.tobytes()]})

    return run


def fit(docs: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, fit_rows: int = FIT_ROWS, **names) -> Model:
    sample = labelled(docs, labels, fit_rows=fit_rows, **names)
    size = len(statistics(""))
    agg = sample.agg(F.count("*").alias("n"), F.avg("y").alias("rate"), *[f(F.get("s", F.lit(i))).alias(f"{n}{i}") for i in range(size) for n, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    rng = np.random.default_rng(SEED)
    mean = np.array([agg[f"m{i}"] or 0.0 for i in range(size)])
    scale = np.array([agg[f"d{i}"] or 0.0 for i in range(size)])
    scale[scale < 1e-9] = 1.0
    # kernel width: the root of the number of statistics is the usual distance of standardised rows, over sqrt(2)
    w = rng.standard_normal((size, features)) / sqrt(size) * 1.4
    model = Model(mean, scale, w, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.full(1, 0.5))
    if not agg["n"] or agg["rate"] in (0.0, 1.0):
        return model._replace(y=np.full(1, agg["rate"] if agg["n"] else 0.5))
    fifth = F.pmod(F.xxhash64("k", F.lit(SEED + 1)), F.lit(5)) == 0
    d = features + 1
    parts = sample.filter(~fifth).coalesce(8).mapInPandas(_sums(model), "a binary, c binary").collect()  # at most 8 sums
    a = sum(np.frombuffer(r["a"]).reshape(d, d) for r in parts)
    c = sum(np.frombuffer(r["c"]) for r in parts)
    rows = max(1.0, a[0, 0])
    model = model._replace(beta=np.linalg.solve(a + ridge * rows / d * np.eye(d), c))
    rest = sample.filter(fifth).select("y", "s").toPandas()  # a fifth of fit_rows, 160 bytes a row
    if not len(rest):
        rest = sample.select("y", "s").toPandas()
    x, y = isotonic(model.raw(np.array(rest["s"].tolist())), rest["y"].to_numpy())
    return model._replace(x=x, y=y)


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """key, held_out, score, predicted for every row of docs."""
    whole_texts(docs.sparkSession)
    model = fit(docs, labels, key=key, text=text, **how)
    scored = docs.select(F.col(key).alias(key), score_column(model, F.col(text)).alias("score"))
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs without the rows whose score is under one half."""
    whole_texts(docs.sparkSession)
    model = fit(docs, labels, text=text, **how)
    return docs.withColumn("__score", score_column(model, F.col(text))).filter("__score >= 0.5").drop("__score")
