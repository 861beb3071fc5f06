"""Text rules as column expressions: junk and model-output detectors, content scores, titles, dates, references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import strip

# Word lists and patterns of the content rules.
NAV_KEYWORDS = (
    "首页", "网站地图", "English", "关于我们", "联系我们",
    "通知公告", "政策法规", "信息公开", "互动交流", "专题专栏",
    "纳税服务", "新闻发布", "搜索", "登录", "注册",
    "本站热词", "总局概况", "政务公开", "在线办事",
    "无障碍", "适老化", "简", "繁",
)
NAV_HEADS = ("简\n繁", "首页\n", "首页 ", "网站地图")
BOILERPLATE = (
    r"版权所有",
    r"ICP备\d+号",
    r"技术支持",
    r"建议使用.*浏览器",
    r"主办[：:]",
    r"地址[：:].*邮编",
    r"电话[：:].*传真",
    r"网站标识码",
    r"京公网安备",
    r"©\s*\d{4}",
    r"All Rights Reserved",
)
MODEL_MARKERS = (
    "核心要点：", "适用范围：", "实务影响：", "注意事项：",
    "概念定义：", "关键要点：", "以下是", "总结如下",
    "**概念定义", "**关键要点", "**适用场景", "**注意事项",
)
PLACEHOLDERS = ("unknown", "tbd", "todo", "default", "n/a", "na", "none", "null", "nil", "tba", "fixme", "?", "-", "")
TITLE_STOP_WORDS = ("关于", "的", "通知", "公告", "规定", "办法", "意见", "决定", "暂行", "实施", "试行", "印发", "转发", "批准", "国家税务总局", "财政部", "税务总局", "中华人民共和国")
HIERARCHY = (("国发", 0), ("财税", 1), ("税总", 2), ("公告", 3), ("海关", 3))
NUMERALS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "百": 100, "千": 1000}
CJK_OUTSIDE = r"[^\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"


def _hits(c: Column, words) -> Column:
    return reduce(Column.__add__, [c.contains(w).cast("int") for w in words])


def cjk_ratio(c: Column) -> Column:
    """CJK characters among those that are not white space; 0 without any."""
    seen = F.length(F.regexp_replace(c, r"(?U)\s", ""))
    return F.when(seen > 0, F.length(F.regexp_replace(c, CJK_OUTSIDE, "")) / seen).otherwise(F.lit(0.0))


def nav_density(c: Column, window: int = 500) -> Column:
    return _hits(F.left(c, F.lit(window)), NAV_KEYWORDS)


def boilerplate_density(c: Column) -> Column:
    return reduce(Column.__add__, [c.rlike(p).cast("int") for p in BOILERPLATE])


def is_placeholder(c: Column) -> Column:
    """F8: stripped and lower-cased, a word that stands for nothing. Null is not a placeholder, the empty string is."""
    return F.coalesce(strip(F.lower(c)).isin(*PLACEHOLDERS), F.lit(False))


def junk_reason(c: Column) -> Column:
    """The first rule that makes a text junk, else `ok`."""
    text = strip(F.coalesce(c, F.lit("")))
    head = F.left(text, F.lit(500))
    pipes = F.length(head) - F.length(F.replace(head, F.lit("|"), F.lit("")))
    short = F.size(F.filter(F.split(head, r"\|"), lambda x: (F.length(strip(x)) > 0) & (F.length(strip(x)) < 8)))
    entities = F.regexp_count(text, F.lit(r"&(?:gt|lt|amp|nbsp|quot|#\d+);"))
    return (
        F.when(F.length(text) < 10, "empty_or_too_short")
        .when(nav_density(text) >= 5, "nav_keywords")
        .when(reduce(Column.__or__, [text.startswith(p) for p in NAV_HEADS]), "starts_with_nav")
        .when(boilerplate_density(text) >= 3, "boilerplate")
        .when((F.length(text) > 100) & (cjk_ratio(text) < 0.2), "low_cjk_ratio")
        .when(entities / F.length(text) > 0.03, "html_entities")
        .when((pipes > 8) & (short > 6), "pipe_menu")
        .when(text.startswith("{") & F.left(text, F.lit(50)).contains("title"), "json_object_in_text")
        .otherwise("ok")
    )


def model_reason(c: Column) -> Column:
    """Why a text looks like a model's output, else `ok`."""
    lines = F.split(c, "\n", -1)
    starts = ("- ", "* ", "• ", "1.", "2.", "3.")
    bullets = F.size(F.filter(lines, lambda x: reduce(Column.__or__, [strip(x).startswith(s) for s in starts])))
    return (
        F.when(c.isNull() | (c == ""), "empty")
        .when(reduce(Column.__or__, [c.contains(m) for m in MODEL_MARKERS]), "llm_output_markers")
        .when((F.size(lines) > 5) & (bullets / F.size(lines) > 0.5), "high_bullet_ratio")
        .otherwise("ok")
    )


def content_score(c: Column) -> Column:
    """0 to 100 from length, script, origin and structure; junk has 0."""
    n = F.length(strip(c))
    size = F.when(n >= 500, 40).when(n >= 200, 30).when(n >= 50, 20).otherwise(10)
    own = F.when(model_reason(c).isin("llm_output_markers", "high_bullet_ratio"), 0).otherwise(20)
    structure = F.when(F.size(F.split(c, "\n", -1)) > 3, 10).otherwise(0)
    score = size + F.least(F.lit(30), F.floor(cjk_ratio(c) * 40).cast("int")) + own + structure
    return F.when((F.coalesce(c, F.lit("")) == "") | (junk_reason(c) != "ok"), F.lit(0)).otherwise(score)


def quality_label(name: Column, strict: bool = False) -> Column:
    """whether a label is fit to show; strict also refuses fragments with many stops."""
    bad = name.rlike(r"^(?:[◆■●▶\s\d.]+|-{3,}|\.{3,}|第[一二三四五六七八九十]+[章节])") | name.contains("- - -") | name.contains("---")
    if strict:
        stops = F.length(name) - F.length(F.regexp_replace(name, "[，、。]", ""))
        bad = bad | name.startswith("...") | ((F.length(name) > 15) & (stops > 3))
    return F.coalesce((F.length(name) >= 2) & ~bad, F.lit(False))


def numeral(c: Column) -> Column:
    """Value of a Chinese or decimal numeral; 0 if any character is neither."""
    value = F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv])
    digits = F.when(c.rlike(r"^\d+$"), c.try_cast("int"))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("now"), F.lit(True).alias("ok"))

    def step(s: Column, ch: Column) -> Column:
        v = F.try_element_at(value, ch)
        unit = F.coalesce(v >= 10, F.lit(False))
        return F.struct(
            F.when(unit, s["sum"] + F.when(s["now"] == 0, 1).otherwise(s["now"]) * v).otherwise(s["sum"]).alias("sum"),
            F.when(unit, 0).otherwise(F.coalesce(v, F.lit(0))).alias("now"),
            (s["ok"] & v.isNotNull()).alias("ok"),
        )

    chars = F.filter(F.split(c, ""), lambda x: x != "")
    done = F.aggregate(chars, start, step, lambda s: F.when(s["ok"], s["sum"] + s["now"]).otherwise(0))
    return F.coalesce(digits, done, F.lit(0)).cast("int")


def hierarchy_level(c: Column) -> Column:
    """Level of a regulation number."""
    out = F.when(F.lit(False), F.lit(0))
    for word, level in HIERARCHY:
        out = out.when(c.contains(word), F.lit(level))
    return out.otherwise(F.lit(4))


def base_title(c: Column) -> Column:
    """Title without year and number."""
    out = F.regexp_replace(F.regexp_replace(c, r"\d{4}年", ""), r"第\d+号", "")
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def title_year(title: Column, date: Column) -> Column:
    """Year from the title, else from the date, else 0."""
    found = lambda c: F.nullif(F.regexp_extract(c, r"(\d{4})年", 1), F.lit(""))
    return F.coalesce(found(title), found(date), F.nullif(F.regexp_extract(date, r"^(\d{4})", 1), F.lit("")), F.lit("0")).cast("int")


def title_date(c: Column) -> Column:
    """ISO date from a title by the first of four patterns, else null."""
    part = lambda p, i: F.regexp_extract(c, p, i)
    full, month, year, bare = r"(\d{4})年(\d{1,2})月(\d{1,2})日", r"(\d{4})年(\d{1,2})月", r"(\d{4})年度?", r"(?U)\b(20[0-2]\d)\b"
    near = lambda p: part(p, 1).try_cast("int").between(2000, 2030)
    two = lambda p, i: F.lpad(part(p, i), 2, "0")
    return (
        F.when(c.rlike(full), F.concat_ws("-", part(full, 1), two(full, 2), two(full, 3)))
        .when(c.rlike(month) & near(month), F.concat_ws("-", part(month, 1), two(month, 2), F.lit("01")))
        .when(c.rlike(year) & near(year), F.concat(part(year, 1), F.lit("-01-01")))
        .when(c.rlike(bare), F.concat(part(bare, 1), F.lit("-01-01")))
    )


def title_terms(c: Column) -> Column:
    """Distinct terms of a title without stop words."""
    words = F.split(F.regexp_replace(c, r"\d{4}年第?\d+号", ""), r"(?U)[，。、；：（）\s]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*TITLE_STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def classify(text: Column, kind: Column, rules, default: str) -> Column:
    """X11: name of the first rule (name, kinds, keywords) that matches the kind, then a keyword in the text."""
    out = F.when(F.lit(False), F.lit(default))
    for name, kinds, keywords in rules:
        tests = [kind.contains(k) for k in kinds] + [text.contains(k) for k in keywords]
        out = out.when(F.coalesce(reduce(Column.__or__, tests), F.lit(False)), F.lit(name))
    return out.otherwise(F.lit(default))


def keyword_context(text: Column, keyword: str, before: int = 50, after: int = 150) -> Column:
    """The text around the first place of a keyword, null without it."""
    at = F.instr(text, keyword)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + after))


def markdown_headings(text: Column) -> Column:
    """array<struct<line, level, heading>>; headings in code fences count."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), F.length(F.regexp_extract(x, r"^(#{1,6})\s+(.+)", 1)).alias("level"), F.regexp_extract(x, r"^(#{1,6})\s+(.+)", 2).alias("heading")))
    return F.filter(lines, lambda h: h["level"] > 0)


def html_title(html: Column, window: int = 3000) -> Column:
    """X15."""
    return strip(F.regexp_extract(F.left(html, F.lit(window)), r"(?is)<title[^>]*>(.*?)</title>", 1))


def quoted_titles(text: Column, most: int = 5) -> Column:
    """The first distinct 《titles》."""
    return F.array_distinct(F.slice(F.regexp_extract_all(text, F.lit(r"《([^》]+)》"), 1), 1, most))


def maximal_keywords(text: Column, keywords: list[str]) -> Column:
    """Keywords found in a text that are not part of another found one."""
    found = F.array_compact(F.array(*[F.when(text.contains(k), F.lit(k)) for k in keywords]))
    return F.filter(found, lambda x: ~F.exists(found, lambda y: (y != x) & y.contains(x)))


def markdown_links(text: Column) -> Column:
    """array<struct<label, target>> of the links of a Markdown text, images left out."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!!)\[[^\]\n]*\]\([^)\s]+\)"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^\[([^\]]*)\]", 1).alias("label"), F.regexp_extract(x, r"\(([^)]+)\)$", 1).alias("target")))


def topics(headings: Column, deepest: int = 2) -> Column:
    """Different lower-case headings (struct with level and heading) down to a level, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(headings, lambda h: h["level"] <= deepest), lambda h: F.lower(h["heading"]))))
