"""The quality classifier against plain versions: exact kernel, normal equations solved otherwise, isotonic fit by its definition."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillgraph.llm import quality

FOLDER = "/root/testdata/sf0.001"


def plain_isotonic(y):
    """Least squares under order, by the formula of greatest least means."""
    n = len(y)
    return np.array([max(min(y[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_isotonic_is_the_constrained_least_squares_fit():
    rng = np.random.default_rng(0)
    for _ in range(40):
        raw, y = rng.permutation(25).astype(float), rng.integers(0, 2, 25).astype(float)
        x, got = quality.isotonic(raw, y, smooth=0.0)
        want = plain_isotonic(y[np.argsort(raw)])
        blocks = [list(g.index) for _, g in pd.Series(want).groupby(want, sort=True)]
        assert np.allclose(got, [want[b[0]] for b in blocks]) and np.allclose(x, [np.mean(b) for b in blocks])


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(1)
    size = len(quality.statistics(""))
    w = rng.standard_normal((size, 20_000)) / math.sqrt(size) * 1.4
    m = quality.Model(np.zeros(size), np.ones(size), w, rng.uniform(0, 2 * np.pi, 20_000), np.zeros(1), np.zeros(1), np.zeros(1))
    z = rng.normal(size=(30, size))
    x = m.features(z)[:, 1:]
    far = ((z[:, None] - z[None]) ** 2).sum(2)
    assert np.abs(x @ x.T - np.exp(-far * 1.4**2 / size / 2)).max() < 0.05


def test_scores_equal_a_plain_fit(spark):
    """One process, all rows in arrays, the ridge fit as least squares over stacked rows."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    fifth = F.pmod(F.xxhash64("k", F.lit(quality.SEED + 1)), F.lit(5)) == 0
    rows = quality.labelled(docs, labels).withColumn("rest", fifth).toPandas()
    known = labels.toPandas().groupby("doc_id")["quality"].mean()
    assert len(rows) and all(known[k] == y for k, y in zip(rows.k, rows.y))
    texts = docs.toPandas().set_index("doc_id")["text"]
    s = np.array([quality.statistics(texts[k]) for k in rows.k])
    assert np.allclose(s, np.array(rows.s.tolist()))
    mean, scale = s.mean(0), s.std(0)
    scale[scale < 1e-9] = 1
    rng = np.random.default_rng(quality.SEED)
    w = rng.standard_normal((s.shape[1], quality.FEATURES)) / math.sqrt(s.shape[1]) * 1.4
    b = rng.uniform(0, 2 * np.pi, quality.FEATURES)

    def features(v):
        z = np.clip((v - mean) / scale, -quality.CLIP, quality.CLIP)
        return np.hstack([np.ones((len(z), 1)), math.sqrt(2 / quality.FEATURES) * np.cos(z @ w + b)])

    fit, rest = rows[~rows.rest], rows[rows.rest]
    x = features(np.array(fit.s.tolist()))
    d = x.shape[1]
    penalty = math.sqrt(quality.RIDGE * len(fit) / d)
    beta = np.linalg.lstsq(np.vstack([x, penalty * np.eye(d)]), np.append(fit.y, np.zeros(d)), rcond=None)[0]
    raw, y = features(np.array(rest.s.tolist())) @ beta, rest.y.to_numpy()
    order = np.argsort(raw, kind="stable")
    level = plain_isotonic(y[order])
    blocks = [np.flatnonzero(level == v) for v in np.unique(level)]
    at = np.array([raw[order][g].mean() for g in blocks])
    up = np.maximum.accumulate([(y[order][g].sum() + y.mean()) / (len(g) + 1) for g in blocks])
    want = {k: float(np.interp(features(np.array([quality.statistics(t)])) @ beta, at, up)[0]) for k, t in texts.items()}
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_very_long_texts_and_repeated_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = [(i, "good plain words here. " * 40 if i % 2 else "B@D!! " * 30, "x") for i in range(60)] + [(100, "good plain words here. " * 100_000, "y"), (100, "good plain words here. " * 100_000, "y"), (101, None, None)]
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string, score string"), labels).collect()
    long = [r.score for r in got if r.doc_id == 100]
    assert len(got) == 63 and len(long) == 2 and math.isclose(*long, rel_tol=1e-12) and all(0 <= r.score <= 1 for r in got)
