"""The keyword automaton against plain containment."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.operators import automaton as A
from quillgraph.operators import links as L


def pairs(words, texts):
    raw = [t.encode() for t in texts]
    a = A.build([w.encode() for w in words])
    text, word = A.found(a, np.frombuffer(b"".join(raw) or b"\0", np.uint8), np.cumsum([0, *map(len, raw)]))
    out = list(zip(text.tolist(), word.tolist()))
    assert len(out) == len(set(out))
    return set(out)


def plain(words, texts):
    return {(i, j) for i, x in enumerate(texts) for j, y in enumerate(words) if y in x}


@pytest.mark.parametrize("dense", [0, 1 << 14])
@given(st.lists(st.text("abé", min_size=1, max_size=6), min_size=1, max_size=20, unique=True), st.lists(st.text("abcé", max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_every_keyword_of_every_text(dense, words, texts):
    held, A.DENSE = A.DENSE, dense
    try:
        assert pairs(words, texts) == plain(words, texts)
    finally:
        A.DENSE = held


def test_matches_across_pieces():
    rng = random.Random(3)
    words = ["".join(rng.choice("ab中") for _ in range(n)) for n in (3, 5, 8, 13, 40, 700)]
    texts = ["".join(rng.choice("ab中") for _ in range(n)) for n in (0, 10, 5000, 30_000)]
    texts += [texts[3][:k] + words[5] + texts[3] for k in (0, 1, 675, 682, 683, 900, 2800)]  # about the edges of pieces
    assert pairs(words, texts) == plain(words, texts)


def test_many_keywords_in_parts(spark):
    """Ten keywords of a hundred thousand give what they give alone, whatever parts the dictionary is cut into."""
    rng = random.Random(5)
    ten = ["".join(rng.choice("abc") for _ in range(6)) for _ in range(10)]
    texts = spark.createDataFrame([(i, "".join(rng.choice("abc") for _ in range(2000))) for i in range(40)] + [(50, None), (51, ""), (None, ten[0]), (None, ten[0]), (52, ten[1]), (52, ten[2])], "id int, t string")
    few = spark.createDataFrame([(w, i) for i, w in enumerate(ten)], "keyword string, seq int")
    many = few.union(spark.range(100_000).selectExpr("concat('z', lpad(id, 7, '0'))", "cast(id as int)"))
    want = sorted(map(str, L.keyword_links(texts, few, "id", "t").collect()))
    assert sorted(map(str, L.keyword_links(texts, many, "id", "t").collect())) == want
    assert sorted(map(str, L.keyword_links(texts, many, "id", "t", part_bytes=150_000).collect())) == want
    assert "Row(key=None, keyword='%s')" % ten[0] in want
    assert A.build([b"z%07d" % i for i in range(100_000)]).nbytes <= 60 * 800_000


def test_no_keywords_and_no_texts(spark):
    none = spark.createDataFrame([], "keyword string, seq int")
    some = spark.createDataFrame([("a", 1), ("a", 0), ("", 2), (None, 3)], "keyword string, seq int")
    texts = spark.createDataFrame([(1, "a")], "id int, t string")
    assert L.keyword_links(texts, none, "id", "t").count() == 0
    assert L.keyword_links(texts.limit(0), some, "id", "t").count() == 0
    assert [tuple(r) for r in L.contained(texts, texts.id, texts.t, some).collect()] == [(1, "a", 0)]


def test_maximal_links(spark):
    texts = spark.createDataFrame([(1, "tax evasion and evasion"), (2, "tax"), (3, "evasion tax")], "id int, t string")
    words = spark.createDataFrame([("tax", 0), ("tax evasion", 1), ("evasion", 2), ("and", 3)], "keyword string, seq int")
    got = sorted(map(tuple, L.maximal_links(texts, words, "id", "t").collect()))
    assert got == [(1, "and"), (1, "tax evasion"), (2, "tax"), (3, "evasion"), (3, "tax")]
