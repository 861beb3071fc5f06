"""Survey scenarios: each case's rows and the count that it must give."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions.text import PLACEHOLDERS, is_placeholder, junk_reason, model_reason
from quillgraph.operators import quality as Q

BASE = {"label": "T", "id": "r", "effective_from": "2024-01-01", "confidence": "0.92", "source_doc_id": "doc", "extracted_by": "x", "reviewed_at": "2024-01-02", "reviewed_by": "a", "jurisdiction_code": "CN", "jurisdiction_scope": "national"}
KEYS = [*BASE, "override_chain_id", "argument_role"]


def survey(spark, rows, **how):
    data = [tuple(({**BASE, "id": f"r{i}"} | r).get(k) for k in KEYS) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, ", ".join(f"{k} string" for k in KEYS))
    return Q.survey(df, "2024-06-01", **how).first()


@pytest.mark.parametrize("rows, column, count", [
    ([{"jurisdiction_scope": "somewhere", "jurisdiction_code": None}], "jurisdiction_mismatches", 1),
    ([{"jurisdiction_scope": None}], "jurisdiction_mismatches", 1),
    ([{"jurisdiction_code": None}], "jurisdiction_mismatches", 1),
    ([{"jurisdiction_scope": s} for s in ("experimental_zone", "trade_port", "special_economic_zone")], "jurisdiction_mismatches", 0),
    ([{"argument_role": r} for r in ("analogy", "analogy", "yiju")], "prohibited_role", 2),
    ([{"argument_role": r} for r in ("premise", "rule", "holding", "dicta", None, "other")], "prohibited_role", 0),
    ([{"override_chain_id": c} for c in ("CN-FTZ-SHA", "XX-01", "CN-Q-9", None)], "invalid_chain", 2),
    ([{"jurisdiction_scope": "municipal"}, {"jurisdiction_code": "CN-FTZ-SHA", "jurisdiction_scope": "trade_port"}, {"jurisdiction_code": "CN-31", "jurisdiction_scope": "subnational"}], "inconsistent_scope", 2),
    ([{"override_chain_id": "\tTBD\n"}], "placeholder_strings", 1),
    ([{"jurisdiction_code": ""}], "placeholder_strings", 1),
    ([{"id": "a"}, {"id": "a"}, {"id": None}, {"id": None}], "duplicates", 2),
    ([{"effective_from": "2010-01-01"}, {"effective_from": "2014-06-04"}, {"effective_from": "2014/01/01"}, {"effective_from": None}], "stale", 1),
    ([{"reviewed_at": None}, {"reviewed_by": ""}, {"reviewed_at": "", "reviewed_by": None}], "integrity_violations", 2),
])
def test_counts(spark, rows, column, count):
    assert survey(spark, rows)[column] == count


def test_clean_and_empty(spark):
    clean = survey(spark, [{} for _ in range(20)])
    assert (clean.defects_total, clean.verdict, clean.sampled) == (0, "PASS", 20)
    assert survey(spark, []) is None
    total = Q.survey_total(Q.survey(spark.createDataFrame([], ", ".join(f"{k} string" for k in KEYS)), "2024-06-01")).first()
    assert (total.labels, total.verdict) == (0, "PASS")


def test_sample_and_null_coverage(spark):
    r = survey(spark, [{"confidence": None} for _ in range(6)] + [{} for _ in range(6)], sample=10)
    assert (r.sampled, r.null_coverage_violations) == (10, 1)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(PLACEHOLDERS), min_size=1, max_size=5), st.sampled_from(["", " ", "\t", "\n "]))
def test_placeholders_ignore_case_and_space(spark, words, pad):
    df = spark.createDataFrame([(pad + w.upper() + pad,) for w in words], "v string")
    assert df.filter(is_placeholder(F.col("v"))).count() == len(words)


def test_min_rows_tiers(spark):
    names = ["g", "a", "b", "c", "d", "e"]
    counts = spark.createDataFrame(list(zip(names[1:], [0, 49, 50, 499, 500])), "name string, rows long")
    got = {r.name: (r.tier, r.passes) for r in Q.min_rows(spark.createDataFrame([(n,) for n in names], "name string"), counts, spark.createDataFrame([("e", 500)], "name string, min_rows long")).collect()}
    assert got == {"g": ("empty", False), "a": ("empty", False), "b": ("tiny", False), "c": ("small", False), "d": ("small", False), "e": ("ok", True)}


def test_junk_rules(spark):
    cases = [
        ("首页 登录 注册 搜索 纳税服务 新闻发布 这一页只有菜单", True), ("出口退税的申报期限为货物报关出口之日次月起", False), ('{"title": "样例", "body": "没有正文"}', True),
        ("", True), (None, True), ("主办：某局 网站标识码 3100 All Rights Reserved 京公网安备", True), ("以下是对印花税计税依据所作的说明文字", False),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", junk_reason(F.col("t")).alias("r"), model_reason(F.col("t")).alias("m"))
    got = {r.i: r for r in df.collect()}
    assert [got[i].r != "ok" for i in range(len(cases))] == [j for _, j in cases]
    assert got[6].m == "llm_output_markers"
