"""Declared and live schemas: DDL parsing, drift, name gates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.split import explode_with

_TABLE = re.compile(r"CREATE\s+(NODE|REL)\s+TABLE(?:\s+GROUP)?(?:\s+IF\s+NOT\s+EXISTS)?\s+(?!IF\b)([A-Za-z_]\w*)\s*\(", re.I)
_FROM_TO = re.compile(r"FROM\s+(\w+)\s+TO\s+(\w+)", re.I)
_WRITES = r"(?i)\b(CREATE|DELETE|DETACH|SET|MERGE|DROP|ALTER|INSERT|UPDATE|TRUNCATE|COPY|REMOVE|REPLACE|LOAD)\b"


def parse_ddl(text: str) -> list[tuple[str, str, int, list[str], list[tuple[str, str]]]]:
    """(kind, name, line, columns, endpoint pairs) of each table that a schema text creates."""
    out = []
    for m in _TABLE.finditer(text):
        depth, i = 1, m.end()
        while i < len(text) and depth:
            depth += (text[i] == "(") - (text[i] == ")")
            i += 1
        body = text[m.end() : i - 1]
        parts, start, level = [], 0, 0
        for j, ch in enumerate(body + ","):
            level += (ch == "(") - (ch == ")")
            if ch == "," and not level:
                parts.append(body[start:j].strip())
                start = j + 1
        columns = [p.split()[0] for p in parts if p and not re.match(r"(?i)(FROM|PRIMARY\s+KEY)\b", p)]
        out.append((m[1].upper(), m[2], text.count("\n", 0, m.start()) + 1, columns, _FROM_TO.findall(body)))
    return out


def ddl_tables(spark: SparkSession, path: str) -> DataFrame:
    """kind, name, line, columns of the tables in schema files (read whole; few and small by nature)."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    rows = [(k, n, line, c) for k, n, line, c, _ in parse_ddl(text)]
    return spark.createDataFrame(rows, "kind string, name string, line int, columns array<string>")


def ddl_file_tables(files: DataFrame) -> DataFrame:
    """Path, kind, name, line, columns of the tables in schema files (path, text), each parsed by the task that reads it."""
    return explode_with(files, parse_ddl_rows, ["text"], "kind string, name string, line int, columns array<string>")


def parse_ddl_rows(text: str | None) -> list[tuple[str, str, int, list[str]]]:
    return [t[:4] for t in parse_ddl(text or "")]


def column_diff(declared: DataFrame, live: DataFrame) -> DataFrame:
    """Name, declared_only, live_only, matched (sorted) for tables that both have."""
    both = declared.select("name", F.col("columns").alias("d")).join(live.select("name", F.col("columns").alias("l")), "name")
    pick = lambda c: F.array_sort(c)
    return both.select("name", pick(F.array_except("d", "l")).alias("declared_only"), pick(F.array_except("l", "d")).alias("live_only"), pick(F.array_intersect("d", "l")).alias("matched"))


def rogue_bucket(name: Column, exact: dict[str, list[str]], prefixes: dict[str, list[str]]) -> Column:
    """Q16: first bucket whose names hold this one, or whose prefixes (ending in `_`; others must be equal) fit."""
    out = F.when(F.lit(False), F.lit("other"))
    for bucket, names in exact.items():
        out = out.when(name.isin(*names), F.lit(bucket))
    for bucket, starts in prefixes.items():
        test = F.lit(False)
        for p in starts:
            test = test | (name.startswith(p) if p.endswith("_") else name == p)
        out = out.when(test, F.lit(bucket))
    return out.otherwise(F.lit("other"))


def read_only(sql: str) -> bool:
    """whether a statement holds no word that writes."""
    return not re.search(_WRITES, re.sub(r"'(?:[^']|'')*'", "''", sql))


def guarded(spark: SparkSession, sql: str, limit: int = 100) -> DataFrame:
    """a read-only statement, with a limit unless it has one."""
    if not read_only(sql) or not re.match(r"(?is)\s*(SELECT|WITH|VALUES|FROM|SHOW|DESCRIBE|EXPLAIN)\b", sql):
        raise PermissionError("only statements that read are allowed")
    out = spark.sql(sql)
    return out if re.search(r"(?i)\bLIMIT\b", sql) else out.limit(limit)


def ddl_gate(statements: DataFrame, allowed: DataFrame) -> DataFrame:
    """Statement, name, verdict: an allowed verb and a declared table name."""
    s = F.col("statement")
    name = F.regexp_extract(s, r"(?i)\bTABLE\s+(?:GROUP\s+)?(?:IF\s+(?:NOT\s+)?EXISTS\s+)?(?!IF\b)([A-Za-z_]\w*)", 1)
    verb = s.rlike(r"(?i)^\s*(CREATE\s+(NODE|REL)\s+TABLE|ALTER\s+TABLE|DROP\s+TABLE)\b")
    known = statements.withColumn("name", name).join(F.broadcast(allowed.select(F.col("name").alias("__n")).distinct()), F.col("name") == F.col("__n"), "left")
    return known.select("statement", "name", F.when(~verb, "forbidden").when(F.col("__n").isNull(), "undeclared").otherwise("ok").alias("verdict"))
