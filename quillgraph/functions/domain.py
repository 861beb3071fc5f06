"""Rules of the tax and exam domain as column expressions: entities, tax types, articles' laws, exam texts, mind-map sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import strip

# Patterns and names of the entity rules. (authority, hierarchy, pattern)
REGULATIONS = (
    ("state_council", 0, r"国发[〔\[（(]\d{4}[〕\]）)]\d+号"),
    ("mof_sat_joint", 1, r"财税[〔\[（(]\d{4}[〕\]）)]\d+号"),
    ("sat_issuance", 2, r"税总[办]?发[〔\[（(]\d{4}[〕\]）)]\d+号"),
    ("sat_announcement", 3, r"国家税务总局公告\d{4}年第\d+号"),
    ("customs", 3, r"海关总署公告\d{4}年第\d+号"),
    ("pbc", 2, r"中国人民银行令?[〔\[（(]\d{4}[〕\]）)]第?\d+号"),
    ("ndrc", 2, r"发改[委]?[〔\[（(]\d{4}[〕\]）)]\d+号"),
)
EFFECTIVE = (r"自(\d{4})年(\d{1,2})月(\d{1,2})日起施行", r"(\d{4})年(\d{1,2})月(\d{1,2})日起执行")
RATES = (r"税率[为是]?百?分?之?(\d+\.?\d*)%?", r"增值税[税率征收率为]*(\d+)%")
CLAUSES = (r"第[一二三四五六七八九十百千]+条", r"第\d+条")
AMENDMENTS = r"修订|废止|修改|补充|替代|失效"
TAX_TYPES = (
    ("TT_VAT", "增值税"), ("TT_CIT", "企业所得税"), ("TT_PIT", "个人所得税"), ("TT_CONSUMPTION", "消费税"), ("TT_TARIFF", "关税"), ("TT_STAMP", "印花税"),
    ("TT_PROPERTY", "房产税"), ("TT_LAND_VAT", "土地增值税"), ("TT_RESOURCE", "资源税"), ("TT_ENV", "环境保护税"), ("TT_VEHICLE", "车船税"), ("TT_CONTRACT", "契税"),
    ("TT_URBAN", "城市维护建设税|城建税"), ("TT_EDUCATION", "教育费附加"), ("TT_CULTIVATED", "耕地占用税"), ("TT_TOBACCO", "烟叶税"), ("TT_TONNAGE", "船舶吨税"), ("TT_LAND_USE", "城镇土地使用税"),
)
TAXPAYERS = (
    ("general_taxpayer", "一般纳税人"), ("small_scale", "小规模纳税人"), ("small_micro", "小微企业|小型微利企业"),
    ("high_tech", "高新技术企业"), ("resident_enterprise", "居民企业"), ("non_resident", "非居民企业"),
)
INCENTIVES = (("exempt", "免征|免税|减免"), ("reduce", "减按|减半|减征"), ("deduct", "加计扣除|税前扣除"), ("credit", "抵免|税额抵扣"), ("refund", "即征即退|先征后退|先征后返"))
# Words of ids and names that tell a tax type.
TAX_KEYWORDS = (
    ("TT_VAT", ("增值税", "VAT", "vat", "_VAT_", "进项", "销项")),
    ("TT_CIT", ("企业所得税", "CIT", "cit", "_CIT_", "HNTE", "hnte", "小微", "小型微利", "research_deduction")),
    ("TT_PIT", ("个人所得税", "PIT", "pit", "_PIT_", "综合所得", "工资薪金")),
    ("TT_CONSUMPTION", ("消费税", "CONSUMPTION", "consumption", "卷烟", "白酒", "啤酒", "化妆品", "成品油")),
    ("TT_TARIFF", ("关税", "TARIFF", "tariff", "进口", "HS编码")),
    ("TT_URBAN", ("城建税", "城市维护建设税", "URBAN", "urban")),
    ("TT_EDUCATION", ("教育费附加", "education")),
    ("TT_LOCAL_EDU", ("地方教育附加", "local_edu")),
    ("TT_RESOURCE", ("资源税", "RESOURCE", "resource", "原油", "天然气", "煤", "稀土")),
    ("TT_LAND_VAT", ("土地增值税", "LAND_VAT", "land_vat")),
    ("TT_PROPERTY", ("房产税", "PROPERTY", "property")),
    ("TT_LAND_USE", ("土地使用税", "LANDUSE", "landuse")),
    ("TT_VEHICLE", ("车船税", "VEHICLE", "vehicle", "车辆购置税")),
    ("TT_STAMP", ("印花税", "STAMP", "stamp")),
    ("TT_CONTRACT", ("契税", "DEED", "deed", "CONTRACT")),
    ("TT_CULTIVATED", ("耕地占用税", "CULTIVATED", "cultivated")),
    ("TT_TOBACCO", ("烟叶税", "TOBACCO", "tobacco")),
    ("TT_TONNAGE", ("船舶吨税", "TONNAGE", "tonnage")),
    ("TT_ENV", ("环保税", "环境保护税", "ENV", "env")),
)
STACKS_WITH = (
    ("INCE_HNTE_CIT", "INCE_RD_SUPER_DEDUCT"), ("INCE_HNTE_CIT", "INCE_CIT_TECH_TRANSFER"), ("INCE_SMALL_PROFIT_CIT", "INCE_RD_SUPER_DEDUCT"),
    ("INCE_VAT_SMALL_EXEMPT", "INCE_VAT_SMALL_1PCT"), ("INCE_HNTE_CIT", "INCE_CIT_DISABLED_SALARY"), ("INCE_SOFTWARE_VAT", "INCE_CIT_SOFTWARE_EXEMPT"),
)
EXCLUDES = (
    ("INCE_HNTE_CIT", "INCE_CIT_WEST_DEV"), ("INCE_HNTE_CIT", "INCE_CIT_HAINAN"),
    ("INCE_SMALL_PROFIT_CIT", "INCE_HNTE_CIT"), ("INCE_VAT_SMALL_EXEMPT", "INCE_VAT_SMALL_1PCT"),
)
TAX_WORDS = (
    "税", "发票", "财政", "财务", "会计", "审计", "预算", "关税", "海关",
    "企业所得", "个人所得", "增值税", "消费税", "印花税", "房产税", "土地",
    "资源税", "车船", "契税", "城建", "烟叶", "耕地", "纳税", "征收",
    "退税", "抵扣", "免税", "减税", "税率", "税额", "税基", "税务",
    "税收", "缴税", "欠税", "偷税", "逃税", "骗税", "避税",
    "注册会计师", "审计报告", "财务报表", "资产评估",
)
ENFORCEMENT = ("行政处罚", "税务稽查", "偷税", "骗税", "虚开", "欠税", "违法", "失信", "罚款", "追缴", "查处", "处罚决定")
RISKS = ("风险", "稽查", "预警", "异常", "违规", "处罚", "罚款", "易错", "常见问题", "注意事项")
LAW_NAME = r"^(.+?)第[一二三四五六七八九十百千\d]+条"
LAW_REFERENCE = r"《([^》]{3,40}(?:法|条例|办法|规定|通知|决定|意见|准则|制度|规则|细则))》"
POLICY_REFERENCE = r"《.+?》|(?:国税|财税|税总|国发)\s*[\[【（(]\d{4}[\]】）)]\s*\d+\s*号"
# Exam papers. Question headings, kinds by words that must all occur, subjects quoted and by word.
QUESTION_HEADING = r"((?:一|二|三|四|五|六|七|八|九|十)[、．.]\s*(?:单项选择题|多项选择题|综合题|计算分析题|计算题|简答题|案例分析题|计算回答题|判断题|单选题|多选题|名词解释|论述题|分析题))"
QUESTION_KINDS = (
    ("single_choice", ("单", "选择")), ("multiple_choice", ("多", "选择")), ("true_false", ("判断",)), ("comprehensive", ("综合",)),
    ("calculation_analysis", ("计算", "分析")), ("calculation_analysis", ("计算", "回答")), ("calculation", ("计算",)),
    ("short_answer", ("简答",)), ("case_analysis", ("案例",)), ("definition", ("名词",)), ("essay", ("论述",)),
)
QUOTED_SUBJECTS = (
    ("会计", "accounting"), ("审计", "audit"), ("税法", "tax_law"), ("财管", "financial_management"), ("财务成本管理", "financial_management"),
    ("经济法", "economic_law"), ("战略", "strategy"), ("公司战略与风险管理", "strategy"), ("公司战略", "strategy"),
)
SUBJECT_WORDS = (
    ("公司战略与风险管理", "strategy"), ("公司战略", "strategy"), ("财务成本管理", "financial_management"), ("经济法", "economic_law"), ("税法", "tax_law"),
    ("审计", "audit"), ("战略", "strategy"), ("财管", "financial_management"), ("(?<!注册)会计(?!师)", "accounting"),
)
QUESTION_NUMBER = r"(?m)^(?:(?:第?\s*)?\d{1,3}\s*[、.．]\s*|[（(]\s*\d{1,3}\s*[）)]\s*|(?:题目|第)\s*\d{1,3}\s*(?:题|\.))"
ANSWER = r"(?:答案\s*[:：]\s*|【答案】\s*|参考答案\s*[:：]?\s*)([A-Da-d,，、\s]+|[√×对错是否])"
CHOICE = r"[A-D][、.．)\s]"
EXAM_YEARS = (1997, 2025)


def _any(c: Column, words) -> Column:
    return reduce(Column.__or__, [c.contains(w) for w in words])


def _named(c: Column, rules) -> Column:
    """Names of the rules (name, pattern) that a text matches, in the rules' order."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in rules]))


def entities(c: Column) -> Column:
    """Regulations (number, authority, hierarchy), dates, rates, clauses, tax types, taxpayers, incentives, amendments."""
    text = F.coalesce(c, F.lit(""))
    issued = lambda a, h: lambda x: F.struct(x.alias("number"), F.lit(a).alias("authority"), F.lit(h).alias("hierarchy"))
    numbers = [F.transform(F.regexp_extract_all(text, F.lit(p), 0), issued(a, h)) for a, h, p in REGULATIONS]
    day = lambda x: F.try_to_date(F.concat_ws("-", F.regexp_extract_all(x, F.lit(r"\d+"), 0)), "yyyy-M-d")
    dates = [F.transform(F.regexp_extract_all(text, F.lit(p), 0), lambda x: F.date_format(day(x), "yyyy-MM-dd")) for p in EFFECTIVE]
    rates = F.transform(F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in RATES]), lambda x: x.cast("double"))
    clauses = F.concat(*[F.regexp_extract_all(text, F.lit(p), 0) for p in CLAUSES])
    tidy = lambda a: F.array_sort(F.array_distinct(a))
    return F.struct(
        F.concat(*numbers).alias("regulations"), F.array_compact(F.concat(*dates)).alias("dates"), tidy(rates).alias("rates"), tidy(clauses).alias("clauses"),
        _named(text, TAX_TYPES).alias("tax_types"), _named(text, TAXPAYERS).alias("taxpayers"), _named(text, INCENTIVES).alias("incentives"),
        F.regexp_extract_all(text, F.lit(AMENDMENTS), 0).alias("amendments"),
    )


def tax_types_of(key: Column, name: Column) -> Column:
    """All tax types that a word of the id or the name tells."""
    both = F.concat_ws(" ", F.coalesce(key, F.lit("")), F.coalesce(name, F.lit("")))
    return F.array_compact(F.array(*[F.when(_any(both, words), F.lit(t)) for t, words in TAX_KEYWORDS]))


def parent_law(title: Column) -> Column:
    """The law that an article's title names, '' without one."""
    return strip(F.regexp_extract(title, LAW_NAME, 1))


def is_tax_text(title: Column, content: Column) -> Column:
    """Whether an article is of the domain."""
    return _any(F.concat(F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))), TAX_WORDS)


def has_signal(title: Column, content: Column, words=ENFORCEMENT) -> Column:
    """B12."""
    return _any(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))), words)


def law_references(content: Column, most: int = 5) -> Column:
    """Distinct names of laws among the first `most` that a text quotes."""
    return F.array_distinct(F.slice(F.regexp_extract_all(content, F.lit(LAW_REFERENCE), 1), 1, most))


def question_kind(heading: Column) -> Column:
    """The first kind whose words all stand in a question heading, else `unknown`."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, words in QUESTION_KINDS:
        out = out.when(reduce(Column.__and__, [heading.contains(w) for w in words]), F.lit(kind))
    return out.otherwise(F.lit("unknown"))


def question_sections(text: Column) -> Column:
    """array<struct<heading, kind, text>>: what stands between question headings; the whole text without any."""
    text = F.coalesce(text, F.lit(""))
    heads = F.regexp_extract_all(text, F.lit(QUESTION_HEADING), 1)
    bodies = F.slice(F.split(text, QUESTION_HEADING, -1), F.lit(2), F.size(heads))
    each = F.zip_with(heads, bodies, lambda h, b: F.struct(strip(h).alias("heading"), question_kind(h).alias("kind"), strip(b).alias("text")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("heading"), F.lit("unknown").alias("kind"), text.alias("text")))
    return F.when(F.size(heads) > 0, each).otherwise(whole)


def numbered_questions(text: Column) -> Column:
    """array<struct<number, text>>: what stands between question numbers of any form at the start of a line."""
    text = F.coalesce(text, F.lit(""))
    marks = F.regexp_extract_all(text, F.lit(QUESTION_NUMBER), 0)
    bodies = F.split(text, QUESTION_NUMBER, -1)
    own = F.slice(bodies, F.size(bodies) - F.size(marks) + 1, F.size(marks))
    return F.zip_with(marks, own, lambda m, b: F.struct(F.regexp_extract(m, r"(\d{1,3})", 1).cast("int").alias("number"), strip(b).alias("text")))


def exam_subject(name: Column, text: Column) -> Column:
    """Subject quoted in the name, else in the text's start, else by word in the same order, else `unknown`."""
    out = F.when(F.lit(False), F.lit(""))
    for rules, quoted in ((QUOTED_SUBJECTS, True), (SUBJECT_WORDS, False)):
        for c in (name, F.left(text, F.lit(500))):
            for word, subject in rules:
                out = out.when(F.coalesce(c.contains(f"《{word}》") if quoted else c.rlike(word), F.lit(False)), F.lit(subject))
    return out.otherwise(F.lit("unknown"))


def exam_year(name: Column, text: Column) -> Column:
    """The first year in the name if it is an exam year, else the first in the text's start, else null."""
    found = lambda c: F.regexp_extract(c, r"((?:19|20)\d{2})", 1).try_cast("int")
    fit = lambda y: F.when(y.between(*EXAM_YEARS), y)
    return F.coalesce(fit(found(name)), fit(found(F.left(text, F.lit(300)))))


def choice_questions(text: Column) -> Column:
    """array<struct<number, question, answer, has_choices>> of a section's numbered questions of 15 characters or more."""
    parts = F.filter(F.transform(F.split(text, r"\n(?=\s*\d{1,3}\s*[、.．])", -1), strip), lambda p: F.length(p) >= 15)
    some = F.filter(parts, lambda p: p.rlike(CHOICE) | (F.length(p) > 20))

    def read(p: Column) -> Column:
        answer = F.regexp_extract(p, ANSWER, 1)
        asked = F.when(p.rlike(ANSWER), strip(F.regexp_replace(p, rf"(?s){ANSWER}.*", ""))).otherwise(p)
        return F.struct(F.regexp_extract(p, r"^(\d{1,3})\s*[、.．]", 1).try_cast("int").alias("number"), F.left(asked, F.lit(2000)).alias("question"), F.when(p.rlike(ANSWER), strip(answer)).alias("answer"), p.rlike(CHOICE).alias("has_choices"))

    return F.transform(some, read)


def section_kind(heading: Column, content: Column, base: Column) -> Column:
    """RiskIndicator where heading or content has a risk word, else the base kind."""
    return F.when(has_signal(heading, content, RISKS), F.lit("RiskIndicator")).otherwise(base)


def clean_heading(heading: Column) -> Column:
    """Without a leading number like 1.17."""
    return strip(F.regexp_replace(heading, r"^\d+\.\d+\s*", ""))


def policy_references(content: Column, most: int = 20) -> Column:
    """Quoted titles, then document numbers, line by line; distinct in the order of their first place."""
    titles, numbers = POLICY_REFERENCE.split("|", 1)
    each = F.transform(F.split(content, "\n", -1), lambda x: F.concat(F.regexp_extract_all(x, F.lit(titles), 0), F.regexp_extract_all(x, F.lit(numbers), 0)))
    return F.slice(F.array_distinct(F.flatten(each)), 1, most)


def day_or(c: Column, fallback: str | None = None) -> Column:
    """YYYY-MM-DD at the start, or YYYY-MM with day 01, else the fallback (null unless given)."""
    day, month = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1), F.regexp_extract(c, r"^(\d{4}-\d{2})", 1)
    return F.when(day != "", day).when(month != "", F.concat(month, F.lit("-01"))).otherwise(F.lit(fallback))


def safe_value(value: Column, limit: int = 200) -> Column:
    """A map as its first non-empty title, name, question or label, else its id; nothing that shows internal offsets."""
    shown = F.coalesce(*[F.nullif(F.try_element_at(value, F.lit(k)), F.lit("")) for k in ("title", "name", "question", "label")])
    internal = F.map_contains_key(value, "_id") | F.map_contains_key(value, "offset")
    other = F.when(F.try_element_at(value, F.lit("id")).isNotNull(), F.try_element_at(value, F.lit("id"))).when(~internal, F.left(F.to_json(value), F.lit(limit)))
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(F.left(shown, F.lit(limit)), other))


def article_references(body: Column) -> Column:
    """artN, artN_paraP or artN_paraP_itemI of each reference in a clause, joined by `;`."""
    from .text import numeral

    n = r"[一二三四五六七八九十百千零\d]+"
    pattern = rf"(?:依照|按照|参照|依据|根据|适用|违反)(?:本法|本条例|本规定|本办法)?第({n})条(?:第({n})款)?(?:第({n})项)?"
    found = F.regexp_extract_all(body, F.lit(pattern), 0)

    def read(x: Column) -> Column:
        part = lambda name, unit: F.when(numeral(F.regexp_extract(x, rf"第({n}){unit}", 1)) > 0, F.concat(F.lit(name), numeral(F.regexp_extract(x, rf"第({n}){unit}", 1)).cast("string"))).otherwise(F.lit(""))
        return F.concat(F.lit("art"), numeral(F.regexp_extract(x, rf"第({n})条", 1)).cast("string"), part("_para", "款"), part("_item", "项"))

    return F.array_join(F.transform(found, read), ";")


def articles(text: Column) -> Column:
    """array<struct<seq, article, body>> of a law's articles with a number over 0 and a body, in text order."""
    from .text import numeral

    mark = r"(?:^|\n)\s*第([一二三四五六七八九十百千零\d]+)条\s*"
    text = F.coalesce(text, F.lit(""))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(mark), 1), numeral)
    bodies = F.slice(F.split(text, mark, -1), F.lit(2), F.greatest(F.size(numbers), F.lit(1)))
    each = F.zip_with(numbers, F.transform(bodies, strip), lambda n, b: F.struct(n.alias("article"), b.alias("body")))
    kept = F.filter(each, lambda a: (a["article"] > 0) & (F.coalesce(a["body"], F.lit("")) != ""))
    return F.transform(kept, lambda a, i: F.struct(i.alias("seq"), a["article"].alias("article"), a["body"].alias("body")))
