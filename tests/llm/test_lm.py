"""The Kneser-Ney model against a plain one with exact counts, and its probabilities against one."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import kneser_ney, queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")), "\n"]


def out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def discount(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
    made = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0 for k in (1, 2, 3)]
    return [0, *(x if 0 < x <= k else k / 2 for k, x in enumerate(made, 1))]


class Plain:
    def __init__(self, texts):
        self.count = Counter(x for t in texts for x in t)
        self.pairs = Counter(p for t in texts for p in zip(["<s>", *t], t))
        self.after, self.before = defaultdict(list), Counter()
        for (v, w), n in self.pairs.items():
            self.after[v].append(n)
            self.before[w] += 1
        self.d, self.e = discount(self.pairs.values()), discount(self.before.values())
        self.v = len(self.count)
        self.g0 = sum(self.e[min(x, 3)] for x in self.before.values()) / (self.v + 1)
        self.sums = {v: (sum(n), sum(self.d[min(x, 3)] for x in n)) for v, n in self.after.items()}

    def q(self, w):
        if not self.v:
            return 1.0
        u, e = self.before[w], self.e
        return (max(u - e[min(u, 3)], 0) + self.g0) / len(self.pairs)

    def p(self, w, v):
        if v not in self.after:
            return self.q(w)
        n, (total, less) = self.pairs[v, w], self.sums[v]
        return (max(n - self.d[min(n, 3)], 0) + less * self.q(w)) / total

    def score(self, t):
        return sum(math.log10(self.p(w, v)) for v, w in zip(["<s>", *t], t))

    def base(self, t):
        n = sum(self.count.values())
        return sum(math.log10((self.count[w] + 0.1) / (n + 0.1 * (self.v + 1))) for w in t)


def agree(rows, got):
    plain = Plain([tokens(t) for i, t in rows if not out(i)])
    want = sorted((str(i), out(i), len(tokens(t)), sum(w in plain.count for w in tokens(t)), sum(plain.count.values()), plain.base(tokens(t)), plain.score(tokens(t))) for i, t in rows)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


def test_query(spark):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    agree(list(zip(docs.doc_id, docs.text)), queries.op13_lm_scoring(spark, FOLDER).collect())


@pytest.mark.parametrize("piece,tally", [(400_000, 1_500_000), (7, 5)])
def test_odd_rows(spark, piece, tally):
    """Nulls, empty and long texts, repeated rows and a clashing column; also with tables that are handed on all the time."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["a", "B", "c", "É", "dd", "e"], int(rng.integers(0, 30)))), "x") for i in range(120)]
    rows += [(None, "a b", None), (None, None, None), (500, None, "y"), (501, "", "y"), (502, "a\tb\x0bc d " * (20_000 if piece > 7 else 200), "z"), (3, rows[3][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    agree([r[:2] for r in rows], kneser_ney.scores(df, piece=piece, tally=tally).collect())


def test_nothing_to_learn_from(spark):
    assert kneser_ney.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    ids = [i for i in range(100) if out(i)][:3]
    rows = [(ids[0], "a b"), (ids[1], None), (ids[2], "a")]
    agree(rows, kneser_ney.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_probabilities_add_up(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40)
    model = kneser_ney.train(kneser_ney.token_rows(docs))
    maps = kneser_ney.Mapped(model)
    every = np.append(np.arange(model.words), -1)
    for v in (model.begin, 0, 1, model.words // 2, -1):
        assert math.isclose(kneser_ney.probabilities(maps, np.full(len(every), v), every).sum(), 1, rel_tol=1e-9)


def test_keys_of_large_numbers():
    v, w = np.array([0, 5, 1 << 40, (1 << 40) + 1, 5]), np.array([7, 1 << 33, 3, 3, 1 << 33])
    keys = kneser_ney.pair_keys(v, w, 1 << 41)
    assert len(set(keys.tolist())) == 4 and keys[1] == keys[4]
    small = kneser_ney.pair_keys(np.array([2**32 - 1, 0]), np.array([3, 2**32 - 2]), 2**32 - 1)
    assert small.view(np.uint64).tolist() == [((2**32 - 1) << 32) + 3, 2**32 - 2]


def test_held_out_texts_are_likelier_than_under_single_words(spark):
    """Held-out rows of a language with strong pairs."""
    words = spark.range(600).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 60), i -> concat('w', (id * 7 + i) % 40)), ' ')").alias("text"))
    got = kneser_ney.scores(words).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.1 * got[1]
