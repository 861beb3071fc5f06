"""Display labels, categories and ids as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of rate-mapping codes.
RATE_LABELS = {
    "TRM_TRANSPORT": "交通运输业", "TRM_FINANCE": "金融业", "TRM_TELECOM": "电信业",
    "TRM_SOFTWARE": "软件业", "TRM_AGRI": "农业", "TRM_EXPORT": "出口退税",
    "TRM_REALESTATE": "房地产业", "TRM_CONSTRUCT": "建筑业", "TRM_SERVICE": "现代服务业",
    "TRM_GOODS": "货物销售", "TRM_CATERING": "餐饮业", "TRM_CULTURE": "文化业",
    "TRM_EDUCATION": "教育", "TRM_MEDICAL": "医疗", "TRM_LOGISTICS": "物流业",
}
UNNAMED = "未命名"
CJK = r"[\x{4e00}-\x{9fff}]"


def strip(c: Column) -> Column:
    """White space of any kind off both ends (SQL trim takes spaces only)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def _shown(field: str) -> Column:
    """A field's text cut to 40 characters where it can serve as a label, else null."""
    clean = strip(F.col(field))
    raw = clean.startswith("{'_id':") | clean.startswith("{'offset':") | clean.rlike(r"^[\d.\-%/]+$")
    tiny = (F.length(clean) <= 3) & ~clean.rlike(CJK)
    return F.when((F.length(clean) >= 2) & ~raw & ~tiny, F.left(clean, F.lit(40)))


def display_label(key: str, content: str | None = None, **fields: str) -> Column:
    """The first usable of title, name, question, node_text, topic, item_name, product_category; else a decoded
    rate code; else the content's start; else the end of the id."""
    order = ("title", "name", "question", "node_text", "topic", "item_name", "product_category")
    tries = [_shown(fields[f]) for f in order if f in fields]
    ident = F.coalesce(F.col(key), F.lit(""))
    codes = F.create_map(*[F.lit(x) for pair in RATE_LABELS.items() for x in pair])
    rate = F.substring_index(ident, "_", -1)
    base = F.left(ident, F.length(ident) - F.length(rate) - 1)
    name = F.coalesce(F.try_element_at(codes, base), F.replace(base, F.lit("TRM_"), F.lit("")))
    tries.append(F.when(ident.startswith("TRM_"), F.when(rate.rlike(r"^\d+$"), F.concat(name, F.lit(" "), rate, F.lit("%"))).otherwise(name)))
    if content:
        clean = strip(F.col(content))
        tries.append(F.when(F.length(clean) >= 5, F.concat(F.left(clean, F.lit(35)), F.lit("..."))))
    tries.append(F.when(F.length(ident) > 12, F.concat(F.lit("..."), F.right(ident, F.lit(8)))).when(ident != "", ident).otherwise(F.lit(UNNAMED)))
    return F.coalesce(*tries)


#: E2, in order: category, equal values, prefixes.
DOCUMENT_TYPES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    # Fixed values.
    ("legal", (), ("policy/", "provincial/", "local_", "tax_policy_", "announcement", "notice", "crawl", "shuiwu")),
    ("qa", (), ("qa/", "12366_qa_", "derived_qa")),
    ("knowledge", ("kuaiji", "doctax_knowledge", "chinaacc_accounting", "chinaacc_cpa"), ("pdf_cpa", "chinaacc_")),
    ("template", ("report_template",), ("工具/",)),
    ("legal", ("compliance_obligation",), ("发票",)),
    ("knowledge", (), ("pdf_",)),
)


def document_category(c: Column, rules=DOCUMENT_TYPES) -> Column:
    """Category of a document type by the first rule that holds, else `other`."""
    t = strip(F.lower(c))
    out = F.when(is_blank(c), F.lit("other"))
    for category, equal, prefixes in rules:
        tests = [t.isin(*equal)] * bool(equal) + [t.startswith(p) for p in prefixes]
        out = out.when(reduce(Column.__or__, tests), F.lit(category))
    return out.otherwise(F.lit("other"))


def composite_id(*parts: Column) -> Column:
    """Parts joined by `:`, empty ones left out."""
    return F.concat_ws(":", *[F.when(p != "", p) for p in parts])


def short_hash(c: Column, n: int = 16, method: str = "sha256") -> Column:
    """E7."""
    return F.left(F.sha2(c, 256) if method == "sha256" else F.md5(c.cast("binary")), F.lit(n))


def kind_of(key: Column) -> Column:
    """What stands before the first `:`."""
    return F.split_part(key, F.lit(":"), F.lit(1))


def resolution_confidence(candidates: Column, confidence: Column) -> Column:
    """0.95 where one candidate, else at most 0.6; without any at most 0.4."""
    return F.when(candidates == 1, F.lit(0.95)).when(candidates > 1, F.least(confidence, F.lit(0.6))).otherwise(F.least(confidence, F.lit(0.4)))


def tokens_estimate(c: Column, per: int = 4) -> Column:
    """E19."""
    return F.floor(F.length(c) / per).cast("long")


def safe_name(c: Column, limit: int = 240) -> Column:
    """A file name of at most `limit` UTF-8 bytes without reserved characters."""
    clean = strip(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|#^\[\]]', "_"), r"\s+", " "))
    lengths = F.filter(F.sequence(F.lit(0), F.length(clean)), lambda n: F.octet_length(F.left(clean, n)) <= limit)
    return F.when(F.octet_length(clean) <= limit, clean).otherwise(F.left(clean, F.array_max(lengths)))
