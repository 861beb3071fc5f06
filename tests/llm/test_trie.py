"""The prefix trie against a plain one, on branching, repeated and very long conversations."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, tie, (role, text)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    nodes = defaultdict(lambda: ([], []))
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        family = c - int(np.fmod(c, 5))
        seq = tuple(turns.get(family, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            nodes[seq[:d]][0].append(c)
        nodes[seq][1].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    out = {}

    def walk(p):
        members, ends = nodes[p]
        leaves, saved = int(not kids[p]), (len(members) - 1) * (len(p[-1][1].encode()) if p else 0)
        for k in kids[p]:
            a, b = walk(k)
            leaves, saved = leaves + a, saved + b
        out[min(members), len(p)] = (min(nodes[p[:-1]][0]) if p else None, len(members), len(kids[p]), leaves, saved, hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest())
        return leaves, saved

    if turns:
        walk(())
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    out = {r[:2]: r[2:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 4), (3, 3)])
def test_trie(spark, seed, block):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.permutation(np.arange(-12, 90)).tolist():
        for i in range(int(rng.integers(0, 14))):
            rows.append((c, None if rng.random() < 0.05 else int(rng.integers(0, 9)), rng.choice(["user", "assistant", ""]), rng.choice(["é", "b", "c c", ""]) if rng.random() < 0.7 else "a", "x"))
    rows += [(c, i, "user", "same", None) for c in range(200, 240) for i in range(5)]
    rows += [(300, i, "user", "same", None) for i in range(40)] + [(5000, i, "user", "same", None) for i in range(60)] + [(400, None, None, None, None)] * 12
    rows += [(None, 1, "user", "lost", None), (7, 1, None, None, "y"), (7, 1, "", "", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(prefix_trie.trie(df, block=block)) == plain(rows)


def test_trie_of_little(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    for rows in ([(5, None, None, None, None)], [(None, 1, "user", "a", "x")], [(3, 1, "user", "a " * 30_000, None)], [(4, 0, "user", "a", None), (9, 0, "user", "a", None)]):
        assert got(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_turns_over_ranges(spark):
    """A conversation that fills many ranges is numbered as one."""
    rows = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.col("id") % 50).otherwise(F.lit(7)).alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    got_ = prefix_trie.numbered(rows).filter("c = 7").select("i").toPandas()["i"]
    assert sorted(got_) == list(range(1, len(got_) + 1)) and len(got_) == 3000


def test_many_ends_of_a_node(spark):
    ends = spark.range(20_000).select(F.lit(0).cast("long").alias("owner"), F.lit(2).cast("long").alias("d"), (F.col("id") - 9000).alias("c"))
    want = hashlib.sha256(",".join(str(i - 9000) for i in range(20_000)).encode()).hexdigest()
    assert prefix_trie.ends_digests(ends).collect()[0].ends_sha256 == want


def test_sums_over_a_tree_of_chains(spark):
    """A path of 40 chains, each hanging on the one before, and a fan."""
    path = [(i, i - 1 if i else None, 1, i) for i in range(40)] + [(100 + i, 20, 1, 0) for i in range(30)]
    got_ = {r.c: (r.n, r.s) for r in prefix_trie.below(spark.createDataFrame(path, "c long, a long, n long, s long"), ["n", "s"]).collect()}
    assert got_[0] == (70, sum(range(40))) and got_[20] == (50, sum(range(20, 40))) and got_[39] == (1, 39) and got_[129] == (1, 0)
