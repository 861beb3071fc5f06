"""The structure of whole texts as rows: Markdown sections, law clauses, journal entry blocks. Built-in expressions only.

Lines are rows of (key, number, what a rule needs of the line), so a text of any length is a group that windows spill, and no text
is repeated for what is found in it. Rows that are equal in the key are told apart by `row`, a number of the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.split import ARTICLE, CLAUSE_CUT, CLAUSE_LEAST, CROSS_REFERENCE
from ..functions.text import numeral
HEADING = r"(?sU)^(#{1,6})\s+(.+)"
LEVELS = 6


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, row, i (from 1), line."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.select("key", "row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "line")).withColumn("i", F.col("i") + 1)


def markdown_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key, row, idx, heading, level, start_line, end_line, words of each heading's section, which ends before the next heading that is
    not deeper, or with the text.

    The next heading of each of the six levels comes from a running minimum from the end of the text; the nearest of those that
    are not deeper ends the section. Words are differences of a running sum over lines."""
    marks = _lines(df, key, text).select(
        "key", "row", "i", F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), _strip(F.regexp_extract("line", HEADING, 2)).alias("heading"),
        F.regexp_count("line", F.lit(r"(?U)\S+")).cast("long").alias("w"),
    )
    doc = Window.partitionBy("key", "row")
    rows = marks.withColumn("upto", F.sum("w").over(doc.orderBy("i"))).withColumn("last", F.max("i").over(doc)).withColumn("all", F.sum("w").over(doc))
    after = doc.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    here = F.struct("i", (F.col("upto") - F.col("w")).alias("before"))
    next_ = [F.min(F.when(F.col("level") == n, here)).over(after).alias(f"n{n}") for n in range(1, LEVELS + 1)]
    heads = rows.select("*", *next_).filter("level > 0")
    end = F.array_min(F.filter(F.array(*[F.when(F.col("level") >= n, F.col(f"n{n}")) for n in range(1, LEVELS + 1)]), lambda x: x.isNotNull()))
    found = heads.withColumn("end", end).withColumn("idx", F.row_number().over(doc.orderBy("i")) - 1)
    return found.select("key", "row", "idx", "heading", "level", F.col("i").alias("start_line"), F.coalesce(F.col("end.i") - 1, F.col("last")).alias("end_line"), (F.coalesce("end.before", "all") - F.col("upto")).alias("words"))


def law_clauses(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key, place, article, title, body, refs of the articles of a law: a mark at the start of a line and all up to the next mark, of
    CLAUSE_LEAST characters or more, its first CLAUSE_CUT."""
    whole = F.coalesce(F.col(text), F.lit(""))
    numbers, bodies = F.regexp_extract_all(whole, F.lit(f"(?U){ARTICLE.pattern}"), F.lit(1)), F.split(whole, f"(?U){ARTICLE.pattern}", -1)
    # a mark at the very start leaves an empty piece before it, as any other text before the first mark does
    pieces = F.when(F.size(numbers) > 0, F.arrays_zip(numbers.alias("n"), F.slice(bodies, F.size(bodies) - F.size(numbers) + 1, F.size(numbers)).alias("b")))
    rows = df.select(F.col(key).alias("key"), F.posexplode(pieces).alias("place", "p")).select("key", "place", numeral(F.col("p.n")).alias("article"), _strip(F.col("p.b")).alias("b"))
    kept = rows.filter((F.col("article") > 0) & (F.length("b") >= CLAUSE_LEAST))
    refs = F.transform(F.regexp_extract_all("b", F.lit(f"(?U){CROSS_REFERENCE.pattern}"), F.lit(1)), lambda r: F.concat(F.lit("art"), numeral(r).cast("string")))
    return kept.select("key", "place", "article", _strip(F.regexp_extract("b", r"^[【\[]([^】\]]+)[】\]]", 1)).alias("title"), F.left("b", F.lit(CLAUSE_CUT)).alias("body"), F.array_join(refs, ";").alias("refs"))


def journal_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key, row, block (from 0), title, lines: entry lines between two blank lines, with the plain line before the first as title."""
    lines = _lines(df, key, text).withColumn("line", _strip(F.col("line"))).withColumn("entry", F.col("line").rlike("^[借贷][：:]").cast("int"))
    doc = Window.partitionBy("key", "row")
    parts = lines.withColumn("part", F.sum(F.when(F.col("line") == "", 1).otherwise(0)).over(doc.orderBy("i"))).filter("line != ''")
    before = F.sum("entry").over(Window.partitionBy("key", "row", "part").orderBy("i"))
    seen = parts.withColumn("before", before)
    blocks = seen.groupBy("key", "row", "part").agg(F.sum("entry").alias("lines"), F.max(F.when(F.col("before") == 0, F.struct("i", "line"))).alias("t")).filter("lines > 0")
    return blocks.select("key", "row", (F.row_number().over(doc.orderBy("part")) - 1).alias("block"), F.coalesce("t.line", F.lit("")).alias("title"), "lines")
