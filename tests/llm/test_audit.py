"""The filter audit against a plain version, over ranges that cut runs of copies anywhere."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    rows = [(i, t or "", s or "") for i, t, s in docs]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    fails = []
    for i, t, s in rows:
        w = WORD.findall(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        good, toxic = (any(l[0] == i and l[k] == 1 for l in labels) if i is not None else False for k in (1, 2))
        fails.append((s, {x for x in f if f[x]}, good, toxic))
    out = {}
    for part in {x[0] for x in fails}:
        mine = [x for x in fails if x[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                all_ = [r for r in mine if x in r[1]]
                out[part, "".join(order), k] = [len(left), len(gone), len(all_) - len(gone), sum(r[1] == {x} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for x in "ABCDE":
            total = sum(v[1] for (p, o, k), v in out.items() if p == part and o[k - 1] == x)
            for (p, o, k), v in out.items():
                if p == part and o[k - 1] == x:
                    v.append(total)
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_audit(spark, parts):
    long = " ".join(f"Word{i % 90}" for i in range(30_000))
    texts = [None, "", "a b c", "A LOUD ONE", "cost: 5$", " ".join(f"w{i}" for i in range(60)), " ".join("same" for _ in range(60)), long, "é" * 10 + "X"]
    rows = [(i, texts[5] if i % 3 else texts[i % len(texts)], "hot" if i % 3 else f"s{i % 4}", "x") for i in range(300)]
    rows += [(None, texts[5], None, "y"), (None, None, "s1", None), (7, texts[5], "hot", "z"), (7, texts[5], "hot", "z"), (0, texts[5], "", "z"), (-4, texts[6], "s2", "")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (7, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mask string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert got(filter_audit.audit(docs, marks)) == plain([r[:3] for r in rows], labels)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, marks).count() == 0
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string")
    assert got(filter_audit.audit(one, marks)) == plain([(None, None, None)], [])


def test_weights_are_additive(spark):
    """Counters of two halves of a table add up to the table's."""
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "x y").otherwise("A").alias("text"), F.lit("s").alias("source"))
    marks = spark.createDataFrame([(2, 1, 1)], "doc_id long, quality int, toxic int")
    masks = filter_audit.failure_masks(docs)
    halves = [filter_audit.counters(masks.filter(F.col("doc_id") % 4 < 2), marks), filter_audit.counters(masks.filter(F.col("doc_id") % 4 >= 2), marks)]
    total = halves[0].union(halves[1]).groupBy("part", "mask").agg(F.sum("docs").alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    assert sorted(map(tuple, total.collect())) == sorted(map(tuple, filter_audit.counters(masks, marks).collect()))
