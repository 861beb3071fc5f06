"""Queries: rules of the tax and exam domain, each over texts that reach all its branches, and label maintenance."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import domain as D
from ..operators import ingest as I
from ..sources.views import nodes, table
from .registry import SQL, register

LAWS = (
    "根据国发〔2020〕5号和财税[2019]13号，增值税税率为13%，自2021年3月1日起施行。第三条废止，第12条修订。",
    "国家税务总局公告2018年第23号：小型微利企业减按2.5征收企业所得税，税率20%，加计扣除，第二十条。",
    "海关总署公告2017年第4号与发改委（2016）9号，关税、消费税免征，2022年2月30日起执行，2022年12月9日起执行",
    "中国人民银行令〔2015〕第7号；税总办发〔2014〕31号；一般纳税人增值税征收率为3%，即征即退；城建税、教育费附加",
    "税总发〔2013〕2号 居民企业 非居民企业 高新技术企业 抵免 印花税 契税 补充 失效 第一百条 第100条",
    "no entities here at all",
    "",
)


def _quoted(texts) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in texts)


def _sql(texts, name: str = "t") -> str:
    """A text for each order, with its number behind it."""
    return f"""{name} AS (SELECT o_orderkey AS id, list_extract([{_quoted(texts)}], (o_orderkey % {len(texts)} + 1)::INT) || ' ' || (o_orderkey % 11) AS text FROM orders)"""


def _whole_sql(texts, name: str = "t") -> str:
    """Every document's whole text, with one of the texts as its last line."""
    return f"""{name} AS (SELECT doc_id AS id, text || chr(10) || list_extract([{_quoted(texts)}], (doc_id % {len(texts)} + 1)::INT) AS text FROM documents)"""


def _texts(spark, d, texts, whole=False):
    k = F.col("doc_id" if whole else "o_orderkey")
    picked = F.element_at(F.array(*map(F.lit, texts)), (k % len(texts) + 1).cast("int"))
    if whole:
        return table(spark, d, "documents").select(k.alias("id"), F.concat("text", F.lit("\n"), picked).alias("text"))
    return table(spark, d, "orders").select(k.alias("id"), F.concat(picked, F.lit(" "), (k % 11).cast("string")).alias("text"))


_RE2 = lambda p: p.replace("\\d", "[0-9]").replace("'", "''")
_NUMBERS = ", ".join(f"list_transform(regexp_extract_all(text, '{_RE2(p)}'), lambda x: x || '|{a}|{h}')" for a, h, p in D.REGULATIONS)
_DATES = ", ".join(f"list_transform(regexp_extract_all(text, '{_RE2(p)}'), lambda x: strftime(try_strptime(array_to_string(regexp_extract_all(x, '[0-9]+'), '-'), '%Y-%-m-%-d'), '%Y-%m-%d'))" for p in D.EFFECTIVE)
_RATES = ", ".join(f"regexp_extract_all(text, '{_RE2(p)}', 1)" for p in D.RATES)
_CLAUSES = ", ".join(f"regexp_extract_all(text, '{_RE2(p)}')" for p in D.CLAUSES)
_FLAGS = lambda rules: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in rules) + "], lambda x: x IS NOT NULL)"
_CAT = lambda lists: f"flatten([{lists}])"


@register("x5_entities", f"""WITH {_sql(LAWS)} SELECT id, {_CAT(_NUMBERS)} AS regulations, list_filter({_CAT(_DATES)}, lambda x: x IS NOT NULL) AS dates,
 list_sort(list_distinct(list_transform({_CAT(_RATES)}, lambda x: x::DOUBLE))) AS rates, list_sort(list_distinct({_CAT(_CLAUSES)})) AS clauses,
 {_FLAGS(D.TAX_TYPES)} AS tax_types, {_FLAGS(D.TAXPAYERS)} AS taxpayers, {_FLAGS(D.INCENTIVES)} AS incentives, regexp_extract_all(text, '{D.AMENDMENTS}') AS amendments FROM t""")  # fmt: skip
def x5_entities(spark, d, whole=False):
    e = _texts(spark, d, LAWS, whole).select("id", D.entities(F.col("text")).alias("e"))
    numbers = F.transform("e.regulations", lambda r: F.concat_ws("|", r["number"], r["authority"], r["hierarchy"].cast("string")))
    return e.select("id", numbers.alias("regulations"), "e.dates", "e.rates", "e.clauses", "e.tax_types", "e.taxpayers", "e.incentives", "e.amendments")


NAMES = ("INCE_VAT_SMALL|小规模免税", "R1|企业所得税与个人所得税", "HNTE_15|高新", "X|白酒和卷烟", "deed_3|契税", "LAND_VAT_1|土地增值税", "Q|环保税 env", "none|plain")
_WORDS = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(joint, '{w}')" for w in words) + f" THEN '{t}' END" for t, words in D.TAX_KEYWORDS) + "], lambda x: x IS NOT NULL)"


@register("b5_tax_types", f"WITH {_sql(NAMES)}, n AS (SELECT id, split_part(text, '|', 1) || ' ' || split_part(text, '|', 2) AS joint FROM t) SELECT id, {_WORDS} AS tax_types FROM n")
def b5_tax_types(spark, d):
    part = lambda i: F.split_part("text", F.lit("|"), F.lit(i))
    return _texts(spark, d, NAMES).select("id", D.tax_types_of(part(1), part(2)).alias("tax_types"))


_PAIRS = ", ".join(f"('{r}', '{a}', '{b}')" for r, pairs in (("STACKS_WITH", D.STACKS_WITH), ("EXCLUDES", D.EXCLUDES)) for a, b in pairs)


@register("b5_incentive_pairs", f"WITH p(rel_type, src, dst) AS (VALUES {_PAIRS}), twice AS (SELECT src, dst FROM p GROUP BY 1, 2 HAVING count(*) > 1) SELECT rel_type, src, dst, (src, dst) IN (SELECT (src, dst) FROM twice) AS disputed FROM p")
def b5_incentive_pairs(spark, d):
    """Fixed pairs; those that both lists hold are marked."""
    rows = [(r, a, b) for r, pairs in (("STACKS_WITH", D.STACKS_WITH), ("EXCLUDES", D.EXCLUDES)) for a, b in pairs]
    p = spark.createDataFrame(rows, "rel_type string, src string, dst string")
    return p.withColumn("disputed", F.count("*").over(Window.partitionBy("src", "dst")) > 1)


TITLES = ("企业所得税法第三条|居民企业应当缴纳《中华人民共和国税收征收管理法》所称税款", "合同法第十二条|当事人约定", "预算法实施条例第7条|《会计准则》《会计准则》《法》", "没有条号的名称|发票管理", "税法第条|x")


@register("b4_parent_laws", rf"""WITH {_sql(TITLES)}, n AS (SELECT id, split_part(text, '|', 1) AS title, split_part(text, '|', 2) AS content FROM t),
f AS (SELECT id, trim(regexp_extract(title, '^(.+?)第[一二三四五六七八九十百千0-9]+条', 1)) AS law FROM n WHERE len(list_filter([{_quoted(D.TAX_WORDS)}], lambda w: contains(title || content, w))) > 0)
SELECT law, count(*) AS articles, min(id) AS first_id FROM f WHERE law <> '' GROUP BY 1""")  # fmt: skip
def b4_parent_laws(spark, d):
    part = lambda i: F.split_part("text", F.lit("|"), F.lit(i))
    rows = _texts(spark, d, TITLES).select("id", part(1).alias("title"), part(2).alias("content")).filter(D.is_tax_text(F.col("title"), F.col("content")))
    return rows.select("id", D.parent_law(F.col("title")).alias("law")).filter("law != ''").groupBy("law").agg(F.count("*").alias("articles"), F.min("id").alias("first_id"))


@register("b3_law_references", rf"""WITH {_sql(TITLES)}, r AS (SELECT id, unnest(list_distinct(list_slice(regexp_extract_all(text, '{D.LAW_REFERENCE}', 1), 1, 5))) AS ref FROM t),
laws(lid, title) AS (VALUES (1, '中华人民共和国税收征收管理法'), (2, '中华人民共和国税收征收管理法实施细则'), (3, '企业会计准则'), (4, '会计准则'))
SELECT id, ref, min(lid) AS target FROM r JOIN laws ON contains(title, ref) OR ends_with(title, ref) GROUP BY 1, 2""")  # fmt: skip
def b3_law_references(spark, d, whole=False):
    """The first law whose title holds a quoted name; names are few and distinct before they meet titles."""
    laws = spark.sql("SELECT * FROM VALUES (1, '中华人民共和国税收征收管理法'), (2, '中华人民共和国税收征收管理法实施细则'), (3, '企业会计准则'), (4, '会计准则') AS l(lid, title)")
    refs = _texts(spark, d, TITLES, whole).select("id", F.explode(D.law_references(F.col("text"))).alias("ref"))
    found = refs.select("ref").distinct().join(F.broadcast(laws), F.col("title").contains(F.col("ref"))).groupBy("ref").agg(F.min("lid").alias("target"))
    return refs.join(found, "ref")


CASES = ("税务稽查通知|内容", "plain|虚开发票", "x|y", "失信|罚款")


@register("b12_signals", f"WITH {_sql(CASES)} SELECT id FROM t WHERE len(list_filter([{_quoted(D.ENFORCEMENT)}], lambda w: contains(text, w))) > 0")
def b12_signals(spark, d, whole=False):
    part = lambda i: F.split_part("text", F.lit("|"), F.lit(i))
    return _texts(spark, d, CASES, whole).filter(D.has_signal(part(1), part(2))).select("id")


EXAMS = (
    "2019年《税法》真题\n一、单项选择题\n1、下列各项中，属于增值税的是哪一项 A、甲 B、乙\n答案：A\n2、另一个足够长的问题在这里 A.甲\n二、判断题\n3、对不对呢这里需要超过二十个字符的问题文本才能留下\n【答案】√",
    "注册会计师 1996\n三、计算分析题\n甲公司\n四、计算题\n五、简答题 六、综合题",
    "审计 2005 试卷\n七、名词解释\n八、论述题\n九、多项选择题\n十、案例分析题",
    "会计基础 无题", "《公司战略》", "财管 2040", "x",
)
_KIND = "CASE " + " ".join(f"WHEN {' AND '.join(f'''contains(h, '{w}')''' for w in words)} THEN '{k}'" for k, words in D.QUESTION_KINDS) + " ELSE 'unknown' END"


@register("b15_question_sections", rf"""WITH {_sql(EXAMS)}, s AS (SELECT id, text, regexp_extract_all(text, '{D.QUESTION_HEADING}') AS heads, regexp_split_to_array(text, '{D.QUESTION_HEADING.replace("((?:一", "(?:(?:一")}') AS bodies FROM t),
e AS (SELECT id, i AS idx, heads[i] AS h, trim(bodies[i + 1], E' \t\n\r') AS body FROM (SELECT *, unnest(range(1, len(heads) + 1)) AS i FROM s WHERE len(heads) > 0))
SELECT id, (idx - 1)::INT AS idx, trim(h) AS heading, {_KIND} AS kind, length(body) AS n FROM e UNION ALL SELECT id, 0, NULL, 'unknown', length(text) FROM s WHERE len(heads) = 0""")  # fmt: skip
def b15_question_sections(spark, d, whole=False):
    found = _texts(spark, d, EXAMS, whole).select("id", F.posexplode(D.question_sections(F.col("text"))).alias("idx", "s"))
    return found.select("id", "idx", "s.heading", "s.kind", F.length("s.text").cast("long").alias("n"))


_QUOTED = " ".join(f"WHEN contains(name, '《{w}》') THEN '{s}'" for w, s in D.QUOTED_SUBJECTS) + " " + " ".join(f"WHEN contains(body, '《{w}》') THEN '{s}'" for w, s in D.QUOTED_SUBJECTS)
#: DuckDB's patterns have no look-around: the one word that needs it is tested with the longer ones taken out.
_BARE = "replace(replace({0}, '注册会计', ''), '会计师', '')"
_WORD = " ".join(f"WHEN {f'''contains({c}, '{w}')''' if not w.startswith('(') else f'''contains({_BARE.format(c)}, '会计')'''} THEN '{s}'" for c in ("name", "body") for w, s in D.SUBJECT_WORDS)
_YEAR = lambda c: f"try_cast(regexp_extract({c}, '((?:19|20)[0-9]{{2}})', 1) AS INT)"


@register("b21_exams", rf"""WITH {_sql(EXAMS)}, n AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'paper 2003 税法' ELSE 'paper' END AS name, text, left(text, 500) AS body, left(text, 300) AS head FROM t)
SELECT id, CASE {_QUOTED} {_WORD} ELSE 'unknown' END AS subject, coalesce(CASE WHEN {_YEAR('name')} BETWEEN 1997 AND 2025 THEN {_YEAR('name')} END, CASE WHEN {_YEAR('head')} BETWEEN 1997 AND 2025 THEN {_YEAR('head')} END) AS year FROM n""")  # fmt: skip
def b21_exams(spark, d):
    name = F.when(F.col("id") % 3 == 0, "paper 2003 税法").otherwise("paper")
    return _texts(spark, d, EXAMS).select("id", D.exam_subject(name, F.col("text")).alias("subject"), D.exam_year(name, F.col("text")).alias("year"))


@register("b21_choice_questions", rf"""WITH {_sql(EXAMS)}, p AS (SELECT id, trim(unnest(string_split(regexp_replace(text, '\n(\s*[0-9]{{1,3}}\s*[、.．])', chr(1) || '\1', 'g'), chr(1))), E' \t\n\r') AS part FROM t),
k AS (SELECT * FROM p WHERE length(part) >= 15 AND (regexp_matches(part, '{D.CHOICE}') OR length(part) > 20))
SELECT id, try_cast(regexp_extract(part, '^([0-9]{{1,3}})\s*[、.．]', 1) AS INT) AS number, trim(regexp_replace(part, '(?s){D.ANSWER}.*', ''), E' \t\n\r') AS question, CASE WHEN regexp_matches(part, '{D.ANSWER}') THEN trim(regexp_extract(part, '{D.ANSWER}', 1), E' \t\n\r') END AS answer, regexp_matches(part, '{D.CHOICE}') AS has_choices FROM k""")  # fmt: skip
def b21_choice_questions(spark, d, whole=False):
    return _texts(spark, d, EXAMS, whole).select("id", F.explode(D.choice_questions(F.col("text"))).alias("q")).select("id", "q.*")


SECTIONS = ("1.17 发票管理|按《发票管理办法》和《发票管理办法》执行\n财税〔2019〕1号 财税[2019]2号\n《税法》", "3.2 常见问题|无", "无编号|存在异常", "4 x|国发（2018）3号")


@register("b16_sections", rf"""WITH {_sql(SECTIONS)}, n AS (SELECT id, split_part(text, '|', 1) AS heading, split_part(text, '|', 2) AS content FROM t),
r AS (SELECT id, flatten(list_transform(string_split(content, chr(10)), lambda x: list_concat(regexp_extract_all(x, '《.+?》'), regexp_extract_all(x, '{_RE2(D.POLICY_REFERENCE.split("|", 1)[1])}')))) AS refs FROM n)
SELECT id, CASE WHEN len(list_filter([{_quoted(D.RISKS)}], lambda w: contains(heading || ' ' || content, w))) > 0 THEN 'RiskIndicator' ELSE 'OP_BusinessScenario' END AS kind,
 trim(regexp_replace(heading, '^[0-9]+\.[0-9]+\s*', '')) AS name, list_slice(list_filter(refs, lambda x, i: list_position(refs, x) = i), 1, 20) AS refs FROM n JOIN r USING (id)""")  # fmt: skip
def b16_sections(spark, d):
    part = lambda i: F.split_part("text", F.lit("|"), F.lit(i))
    rows = _texts(spark, d, SECTIONS).select("id", part(1).alias("h"), part(2).alias("c"))
    return rows.select("id", D.section_kind(F.col("h"), F.col("c"), F.lit("OP_BusinessScenario")).alias("kind"), D.clean_heading(F.col("h")).alias("name"), D.policy_references(F.col("c")).alias("refs"))


@register("b17_days", """WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00' WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN 'soon' END AS v FROM orders)
SELECT id, CASE WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN left(v, 10) WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}') THEN left(v, 7) || '-01' ELSE '2026-01-01' END AS day FROM t""")  # fmt: skip
def b17_days(spark, d):
    k = F.col("o_orderkey") % 4
    v = F.when(k == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00"))).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).when(k == 2, "soon")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), D.day_or(v, "2026-01-01").alias("day"))


@register("e13_safe_values", """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment WHEN 2 THEN 'n' || c_custkey END AS shown FROM customer""")
def e13_safe_values(spark, d):
    k = F.col("c_custkey") % 4
    entry = lambda **kv: F.create_map(*[x for key, v in kv.items() for x in (F.lit(key), v)])
    value = F.when(k == 0, entry(title=F.lit(""), name=F.col("c_name"), label=F.lit("l"))).when(k == 1, entry(id=F.lit("i"), title=F.col("c_mktsegment"))).when(k == 2, entry(id=F.concat(F.lit("n"), F.col("c_custkey").cast("string")))).otherwise(entry(_id=F.lit("offset")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), D.safe_value(value).alias("shown"))


STATUTES = (
    "总则\n第一条 为了规范，依照本法第三条第二款第一项执行。\n第二条 违反第十条的规定\n第一条 重复的一条\n第二条\n第零条 无效",
    "  第12条 【定义】参照第二十条第三款和根据第5条第1项\n第十三条 终", "没有条文",
)
#: Values of the numerals in these texts.
_N = "map {'一': 1, '二': 2, '三': 3, '十': 10, '二十': 20, '十三': 13, '零': 0, '12': 12, '5': 5, '1': 1}"
_NUM = "[一二三四五六七八九十百千零0-9]+"


@register("x8_articles", rf"""WITH {_sql(STATUTES)}, s AS (SELECT id, regexp_extract_all(text, '(?:^|\n)\s*第({_NUM})条\s*', 1) AS ns, regexp_split_to_array(text, '(?:^|\n)\s*第{_NUM}条\s*') AS bodies FROM t),
e AS (SELECT id, i, ({_N})[ns[i]] AS article, trim(bodies[i + 1], E' \t\n\r') AS body FROM (SELECT *, unnest(range(1, len(ns) + 1)) AS i FROM s)),
k AS (SELECT *, row_number() OVER (PARTITION BY id, article ORDER BY i) - 1 AS dup FROM e WHERE article > 0 AND body <> ''),
r AS (SELECT *, regexp_extract_all(body, '(?:依照|按照|参照|依据|根据|适用|违反)(?:本法|本条例|本规定|本办法)?第{_NUM}条(?:第{_NUM}款)?(?:第{_NUM}项)?') AS found FROM k)
SELECT id, article::INT AS article, 'CL_' || id || '_art' || article || CASE WHEN dup > 0 THEN '_dup' || dup ELSE '' END AS clause_id, regexp_extract(body, '^[【\[]([^】\]]+)[】\]]', 1) AS title,
 array_to_string(list_transform(found, lambda x: 'art' || ({_N})[regexp_extract(x, '第({_NUM})条', 1)] || CASE WHEN contains(x, '款') THEN '_para' || ({_N})[regexp_extract(x, '第({_NUM})款', 1)] ELSE '' END || CASE WHEN contains(x, '项') THEN '_item' || ({_N})[regexp_extract(x, '第({_NUM})项', 1)] ELSE '' END), ';') AS refs FROM r""")  # fmt: skip
def x8_articles(spark, d, whole=False):
    each = _texts(spark, d, STATUTES, whole).select("id", F.explode(D.articles(F.col("text"))).alias("a")).select("id", "a.*")
    dup = F.row_number().over(Window.partitionBy("id", "article").orderBy("seq")) - 1
    key = F.concat(F.lit("CL_"), F.col("id").cast("string"), F.lit("_art"), F.col("article").cast("string"), F.when(dup > 0, F.concat(F.lit("_dup"), dup.cast("string"))).otherwise(""))
    return each.select("id", "article", key.alias("clause_id"), F.regexp_extract("body", r"^[【\[]([^】\]]+)[】\]]", 1).alias("title"), D.article_references(F.col("body")).alias("refs"))


@register("t14_structured_dump", """WITH q(question) AS (VALUES ('which region and supplier'), ('a nation?'), ('nothing')), hit AS (SELECT question, contains(question, 'region') AS r, contains(question, 'nation') OR contains(question, 'country') AS n, contains(question, 'supplier') AS s FROM q),
rows AS (SELECT question, 1 AS part, 0 AS line, '[Structured Region] r_regionkey | r_name' AS text FROM hit WHERE r UNION ALL SELECT question, 1, row_number() OVER (PARTITION BY question ORDER BY r_regionkey), r_regionkey || ' | ' || r_name FROM hit, region WHERE r QUALIFY row_number() OVER (PARTITION BY question ORDER BY r_regionkey) <= 25
 UNION ALL SELECT question, 2, 0, '[Structured Nation] n_nationkey | n_name' FROM hit WHERE n UNION ALL SELECT question, 2, row_number() OVER (PARTITION BY question ORDER BY n_nationkey), n_nationkey || ' | ' || n_name FROM hit, nation WHERE n QUALIFY row_number() OVER (PARTITION BY question ORDER BY n_nationkey) <= 15
 UNION ALL SELECT question, 3, 0, '[Structured Supplier] s_suppkey | s_name' FROM hit WHERE s UNION ALL SELECT question, 3, row_number() OVER (PARTITION BY question ORDER BY s_suppkey), s_suppkey || ' | ' || s_name FROM hit, supplier WHERE s QUALIFY row_number() OVER (PARTITION BY question ORDER BY s_suppkey) <= 40)
SELECT question, text FROM rows QUALIFY row_number() OVER (PARTITION BY question ORDER BY part, line) <= 40""")  # fmt: skip
def t14_structured_dump(spark, d):
    from ..operators.search import structured_dump

    t = lambda n: table(spark, d, n)
    dumps = [("Region", t("region"), ["r_regionkey", "r_name"], 25, ["region"]), ("Nation", t("nation"), ["n_nationkey", "n_name"], 15, ["nation", "country"]), ("Supplier", t("supplier"), ["s_suppkey", "s_name"], 40, ["supplier"])]
    questions = spark.createDataFrame([("which region and supplier",), ("a nation?",), ("nothing",)], "question string")
    return structured_dump(questions, dumps).select("question", "text")


@register("k8_delete_label", "WITH @NODES SELECT id, label, name, 'CN' AS scope FROM nodes WHERE label NOT IN ('Order', 'Document')")
def k8_delete_label(spark, d):
    """Rows of two labels deleted, and a column added with its default."""
    left = I.delete_label(nodes(spark, d), "Order", "Document")
    return I.add_column(left, "scope", "string", "CN").select("id", "label", "name", "scope")


@register("k8_reset_label", "SELECT 'Region' AS label, 0::BIGINT AS rows")
def k8_reset_label(spark, d):
    """A label emptied and created anew with its declared columns."""
    fresh = I.reset_label(spark, "id string, title string, fullText string, createdAt string")
    return fresh.agg(F.count("*").alias("rows")).select(F.lit("Region").alias("label"), "rows")


# the rules again, over the whole texts of all documents
for _rule, _lines in ((x5_entities, LAWS), (b3_law_references, TITLES), (b15_question_sections, EXAMS), (x8_articles, STATUTES)):
    register(f"{_rule.__name__}_whole", SQL[_rule.__name__].replace(_sql(_lines), _whole_sql(_lines)))(partial(_rule, whole=True))
register("b12_signals_whole", SQL["b12_signals"].replace(_sql(CASES), _whole_sql(CASES)).replace("contains(text, w)", "contains(split_part(text, '|', 1) || chr(10) || split_part(text, '|', 2), w)"))(partial(b12_signals, whole=True))
