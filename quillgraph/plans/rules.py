"""Queries: title, number and junk rules over texts that reach every branch, with the rules themselves as SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.views import table
from .domain import _quoted, _sql, _texts, _whole_sql
from .registry import SQL, register

_YEAR = "([0-9]{4})年"
NUMBERS = ("国发〔2020〕1号", "财税〔2019〕2号", "税总发〔2018〕3号", "国家公告2017年第4号", "海关总署令第5号", "other", "财税公告", "")
_LEVEL = "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN {n}" for w, n in X.HIERARCHY) + " ELSE 4 END"


@register("e11_hierarchy", f"WITH {_sql(NUMBERS)} SELECT id, {_LEVEL} AS level FROM t")
def e11_hierarchy(spark, d, whole=False):
    return _texts(spark, d, NUMBERS, whole).select("id", X.hierarchy_level(F.col("text")).alias("level"))


NUMERALS = ("十", "十二", "二十", "二十一", "一百零三", "一百一十", "三百二十五", "一千零一", "九千九百九十九", "一x", "7", "0042", "零", "百", "")
_DIGITS = "['一', '二', '三', '四', '五', '六', '七', '八', '九']"
_DIGIT = lambda unit: f"CASE WHEN contains(v, '{unit}') THEN coalesce(list_position({_DIGITS}, regexp_extract(v, '([一二三四五六七八九]){unit}', 1)), 1) ELSE 0 END"


@register("e12_numeral", f"""WITH {_sql(NUMERALS)}, n AS (SELECT id, split_part(text, ' ', 1) AS v FROM t)
SELECT id, CASE WHEN regexp_full_match(v, '[0-9]+') THEN v::INT WHEN regexp_full_match(v, '[零一二三四五六七八九十百千]+') THEN 1000 * ({_DIGIT('千')}) + 100 * ({_DIGIT('百')}) + 10 * ({_DIGIT('十')})
 + coalesce(list_position({_DIGITS}, right(v, 1)), 0) ELSE 0 END::INT AS value FROM n""")  # fmt: skip
def e12_numeral(spark, d):
    return _texts(spark, d, NUMERALS).select("id", X.numeral(F.split_part("text", F.lit(" "), F.lit(1))).alias("value"))


TITLES = ("关于2019年第3号  通知", "国家税务总局2021年公告", "无年份的标题", "第12号 2008年5月修订", "2016年3月8日 办法", "2035年6月 远期", "1999年度报告", "汇算 2018 版", "code 2045", "2020年12月 31日")


@register("e14_title_year", f"""WITH {_sql(TITLES)}, n AS (SELECT *, CASE id % 3 WHEN 0 THEN '2011-05-06' WHEN 1 THEN '于2012年' END AS day FROM t)
SELECT id, coalesce(nullif(regexp_extract(text, '{_YEAR}', 1), ''), nullif(regexp_extract(day, '{_YEAR}', 1), ''), nullif(regexp_extract(day, '^([0-9]{{4}})', 1), ''), '0')::INT AS y FROM n""")
def e14_title_year(spark, d, whole=False):
    day = F.when(F.col("id") % 3 == 0, "2011-05-06").when(F.col("id") % 3 == 1, "于2012年")
    return _texts(spark, d, TITLES, whole).select("id", X.title_year(F.col("text"), day).alias("y"))


@register("e15_base_title", rf"WITH {_sql(TITLES)} SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]{{4}}年', '', 'g'), '第[0-9]+号', '', 'g'), '\s+', ' ', 'g')) AS base FROM t")
def e15_base_title(spark, d, whole=False):
    return _texts(spark, d, TITLES, whole).select("id", X.base_title(F.col("text")).alias("base"))


_EDGE = r"[^0-9A-Za-z_\x{4e00}-\x{9fff}]"


@register("e16_title_date", rf"""WITH {_sql(TITLES)}, n AS (SELECT *, regexp_extract(text, '([0-9]{{4}})年([0-9]{{1,2}})月([0-9]{{1,2}})日', ['y', 'm', 'd']) AS f, regexp_extract(text, '([0-9]{{4}})年([0-9]{{1,2}})月', ['y', 'm']) AS m,
 regexp_extract(text, '{_YEAR}', 1) AS y, regexp_extract(text, '(?:^|{_EDGE})(20[0-2][0-9])(?:$|{_EDGE})', 1) AS b FROM t)
SELECT id, CASE WHEN f.y <> '' THEN f.y || '-' || lpad(f.m, 2, '0') || '-' || lpad(f.d, 2, '0') WHEN m.y <> '' AND try_cast(m.y AS INT) BETWEEN 2000 AND 2030 THEN m.y || '-' || lpad(m.m, 2, '0') || '-01'
 WHEN y <> '' AND try_cast(y AS INT) BETWEEN 2000 AND 2030 THEN y || '-01-01' WHEN b <> '' THEN b || '-01-01' END AS date FROM n""")  # fmt: skip
def e16_title_date(spark, d, whole=False):
    return _texts(spark, d, TITLES, whole).select("id", X.title_date(F.col("text")).alias("date"))


PAGES = (
    "首页 关于我们 联系我们 通知公告 政策法规 搜索 这里是一个导航页面的文字", "网站地图 内容很少的页面开头就是导航文字", "首页 又一个以导航开头的页面文字内容", "版权所有 ICP备123号 技术支持 某公司 的页脚文字内容在这里", "short",
    "&gt;&lt;&amp;&nbsp; some entities in text", "a|b|c|d|e|f|g|h|i|j menu", '{"title": "一个对象的正文内容"}', "规范的正文内容，说明发票如何开具，没有任何问题的一段文字。", "x" * 120, "核心要点：" + "正文" * 60,
    "正文" * 30, "正文 mixed " * 25, "正文" * 260, "",
)
_TRIM = r"trim({0}, E' \t\n\r')"
_COUNT = lambda words, c: f"len(list_filter([{_quoted(words)}], lambda w: contains({c}, w)))"
_CJK = r"(length(regexp_replace(s, '[^\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]', '', 'g')) / greatest(length(regexp_replace(s, '\s', '', 'g')), 1))"
_HEADS = " OR ".join("starts_with(s, " + " || chr(10) || ".join(f"'{x}'" for x in h.split("\n")) + ")" for h in X.NAV_HEADS)
_FOOT = " + ".join(f"regexp_matches(s, '{p}')::INT" for p in X.BOILERPLATE)
_BRIEF = f"len(list_filter(string_split(left(s, 500), '|'), lambda x: length({_TRIM.format('x')}) BETWEEN 1 AND 7))"
_JUNK = f"""CASE WHEN length(s) < 10 THEN 'empty_or_too_short' WHEN {_COUNT(X.NAV_KEYWORDS, 'left(s, 500)')} >= 5 THEN 'nav_keywords' WHEN {_HEADS} THEN 'starts_with_nav' WHEN {_FOOT} >= 3 THEN 'boilerplate'
 WHEN length(s) > 100 AND {_CJK} < 0.2 THEN 'low_cjk_ratio' WHEN len(regexp_extract_all(s, '&(?:gt|lt|amp|nbsp|quot|#[0-9]+);')) / length(s) > 0.03 THEN 'html_entities'
 WHEN length(left(s, 500)) - length(replace(left(s, 500), '|', '')) > 8 AND {_BRIEF} > 6 THEN 'pipe_menu' WHEN starts_with(s, '{{') AND contains(left(s, 50), 'title') THEN 'json_object_in_text' ELSE 'ok' END"""
_BULLETS = r"len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(" + _TRIM.format("x") + r", '^(- |\* |• |1\.|2\.|3\.)')))"
_LINES = "len(string_split(text, chr(10)))"
_MODEL = f"CASE WHEN text = '' THEN 'empty' WHEN {_COUNT(X.MODEL_MARKERS, 'text')} > 0 THEN 'llm_output_markers' WHEN {_LINES} > 5 AND {_BULLETS} / {_LINES} > 0.5 THEN 'high_bullet_ratio' ELSE 'ok' END"
_ALL = f"every_text AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'o' || id, text FROM t), m AS (SELECT id, text, {_TRIM.format('text')} AS s FROM every_text)"


def _all(spark, d):
    """The documents, and a made text for each order."""
    made = _texts(spark, d, PAGES).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("id"), "text")
    return table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text").unionByName(made)


@register("x2_junk", f"WITH {_sql(PAGES)}, {_ALL} SELECT id, {_JUNK} AS reason FROM m")
def x2_junk(spark, d):
    return _all(spark, d).select("id", X.junk_reason(F.col("text")).alias("reason"))


@register("x4_content_score", f"""WITH {_sql(PAGES)}, {_ALL} SELECT id, CASE WHEN text = '' OR ({_JUNK}) <> 'ok' THEN 0 ELSE CASE WHEN length(s) >= 500 THEN 40 WHEN length(s) >= 200 THEN 30 WHEN length(s) >= 50 THEN 20 ELSE 10 END
 + least(30, floor(CASE WHEN s = '' THEN 0 ELSE {_CJK} END * 40)::INT) + CASE WHEN ({_MODEL}) IN ('llm_output_markers', 'high_bullet_ratio') THEN 0 ELSE 20 END + CASE WHEN {_LINES} > 3 THEN 10 ELSE 0 END END::INT AS score FROM m""")  # fmt: skip
def x4_content_score(spark, d):
    return _all(spark, d).select("id", X.content_score(F.col("text")).alias("score"))


@register("a15_junk_audit", f"""WITH m AS (SELECT source, {_TRIM.format("coalesce(text, '')")} AS s FROM documents), r AS (SELECT source, {_JUNK} AS reason FROM m),
c AS (SELECT source, count(*) AS total, count(*) FILTER (reason = 'empty_or_too_short') AS empty, count(*) FILTER (reason NOT IN ('ok', 'empty_or_too_short')) AS junk, count(*) FILTER (reason = 'ok') AS real FROM r GROUP BY source)
SELECT *, round((empty + junk) / total, 4) AS ratio, CASE WHEN round((empty + junk) / total, 4) < 0.1 THEN 'ok' WHEN round((empty + junk) / total, 4) < 0.3 THEN 'warn' ELSE 'bad' END AS status FROM c""")  # fmt: skip
def a15_junk_audit(spark, d):
    from ..operators.quality import junk_audit

    return junk_audit(table(spark, d, "documents"), "source", "text")


# the rules again, over the whole texts of all documents
for _rule, _lines in ((e11_hierarchy, NUMBERS), (e14_title_year, TITLES), (e15_base_title, TITLES), (e16_title_date, TITLES)):
    register(f"{_rule.__name__}_whole", SQL[_rule.__name__].replace(_sql(_lines), _whole_sql(_lines)))(partial(_rule, whole=True))
