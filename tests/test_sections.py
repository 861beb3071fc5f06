"""Sections, clauses and blocks as expressions against the plain parsers."""

import random

import pytest

from quillgraph.functions import split as SP
from quillgraph.operators import sections as TX


def some_texts(pieces, n, seed):
    rng = random.Random(seed)
    return ["\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["", "x"]


def frame(spark, texts):
    return spark.createDataFrame([*enumerate(texts), (None, None), (9_999, None)], "id long, t string")


def test_sections(spark):
    texts = some_texts(["# a", "## b  c ", "### d", "#### e", "no # heading", "", "  ", "two words", "#x", "####### seven", "# \t z\u3000y", "#\u00a0é f"], 80, 1)
    got = {}
    for r in TX.markdown_sections(frame(spark, texts), "id", "t").collect():
        got.setdefault(r.key, []).append((r.idx, r.heading, r.level, r.start_line, r.end_line, r.words))
    want = {i: SP.sections(t) for i, t in enumerate(texts)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_clauses(spark):
    body = "根据第三条和适用第12条的规定" + "内容" * 14
    texts = some_texts(["第一条 " + body, "第十二条", "  第3条　【题名】" + body, "第百二十条\n\n" + body, body, "", "第xx条 " + body, "第零条 " + body, "第4条 短", "第5条 " + "长" * 6000], 60, 2)
    got = {}
    for r in TX.law_clauses(frame(spark, texts), "id", "t").collect():
        got.setdefault(r.key, []).append((r.place, (r.article, 0, r.title, r.body, r.refs)))
    want = {i: SP.split_clauses(t) for i, t in enumerate(texts) if SP.ARTICLE.search(t)}
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_blocks(spark):
    texts = some_texts(["借：a", "贷: b", "title", " other ", "", "  ", "借 no"], 80, 3)
    got = {}
    for r in TX.journal_blocks(frame(spark, texts), "id", "t").collect():
        got.setdefault(r.key, []).append((r.block, r.title, r.lines))
    want = {i: SP.journal_blocks(t) for i, t in enumerate(texts)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("fn", [TX.markdown_sections, TX.law_clauses, TX.journal_blocks])
def test_equal_rows_and_long_texts(spark, fn):
    text = "\n".join(["# head", "第一条 " + "x" * 40, "借：1", ""] * 5_000)
    df = spark.createDataFrame([(1, text), (1, text), (2, "")], "id long, t string")
    counts = {r.key: r["count"] for r in fn(df, "id", "t").groupBy("key").count().collect()}
    assert counts == {1: 10_000}
    assert fn(df.limit(0), "id", "t").count() == 0
