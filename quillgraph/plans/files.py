"""Queries over files: the given tables are written to the scratch folder, or packed into containers, and read back by the sources."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from ..functions import split as SP
from ..operators import evaluate as E
from ..operators import sketches as SK
from ..sources import files as S
from ..sources import office as O
from ..sources.scratch import scratch_path
from ..sources.views import table
from .registry import register


@register("s8_json_lines", "SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 7 <> 0 AND ts >= TIMESTAMP '2024-01-10 00:00:00'")
def s8_json_lines(spark, d):
    """An append log of the events in which every seventh line is broken, from the tenth of January on."""
    path = scratch_path(spark, "log")
    row = F.to_json(F.struct("event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")))
    table(spark, d, "events").select(F.when(F.col("event_id") % 7 == 0, F.substring(row, 2, 30)).otherwise(row)).write.text(path)
    return S.json_lines(spark, path, "event_id long, user_id long, event_type string, value double, ts string", since="2024-01-10 00:00:00").drop("ts")


@register("s7_json_documents", "SELECT c_custkey, c_name, c_nationkey AS nation FROM customer")
def s7_json_documents(spark, d):
    """A file a nation with an array of its customers, or one object where there is one."""
    path = scratch_path(spark, "json")
    both = F.collect_list(F.struct("c_custkey", "c_name"))
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.when(F.count("*") == 1, F.to_json(both[0])).otherwise(F.to_json(both)).alias("value"))
    rows.write.partitionBy("nation").text(path)
    return S.json_documents(spark, path, "c_custkey long, c_name string, nation long")


@register("s9_csv_rows", "SELECT o_orderkey, o_orderstatus || ', \"' || o_orderpriority || '\"' AS note, o_totalprice FROM orders")
def s9_csv_rows(spark, d):
    """Orders as CSV, with commas, quotes and line ends inside a field."""
    path = scratch_path(spark, "csv")
    note = F.concat("o_orderstatus", F.lit(', "'), "o_orderpriority", F.lit('"'))
    table(spark, d, "orders").select("o_orderkey", F.concat(note, F.lit("\nnext")).alias("note"), "o_totalprice").write.option("header", True).option("escape", '"').csv(path)
    rows = S.csv_rows(spark, path, "o_orderkey long, note string, o_totalprice double")
    return rows.withColumn("note", F.regexp_replace("note", "\nnext$", ""))


@register("s12_text_tree", "SELECT source, count(*) AS lines, sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS ends, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents WHERE source <> 'src3' GROUP BY source")
def s12_text_tree(spark, d):
    """Documents as files of a folder a source, line ends as two characters; one source's folder is skipped."""
    path = scratch_path(spark, "tree")
    table(spark, d, "documents").select("source", F.replace("text", F.lit("\n"), F.lit("\\n"))).write.partitionBy("source").text(path)
    tree = S.text_tree(spark, path, ["txt"], skip=["source=src3"])
    named = tree.select(F.regexp_extract("path", "source=([^/]+)", 1).alias("source"), F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line"))
    ends = F.regexp_count("line", F.lit(r"\\n"))
    return named.groupBy("source").agg(F.count("*").alias("lines"), F.sum(ends).cast("long").alias("ends"), F.sum(F.octet_length("line") - ends).cast("long").alias("bytes"))


def _packed(rows, key: str, pack: Callable[[pd.DataFrame], bytes]):
    """path, content: a container of each group's rows; groups are small by their key."""
    make = lambda p: pd.DataFrame({"path": [str(p[key].iloc[0])], "content": [pack(p)]})
    return rows.groupBy(key).applyInPandas(make, "path string, content binary")


def _zip(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


_MAIN, _R = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _workbook(p: pd.DataFrame) -> bytes:
    p = p.sort_values("p_partkey")
    names = sorted(set(p["p_name"]))
    place = {n: i for i, n in enumerate(names)}
    cells = "".join(f'<row r="{i}"><c r="A{i}"><v>{k}</v></c><c r="C{i}" t="s"><v>{place[n]}</v></c><c t="inlineStr"><is><t>{s}.5%</t></is></c></row>' for i, (k, n, s) in enumerate(zip(p["p_partkey"], p["p_name"], p["p_size"]), 2))
    return _zip(**{
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_R}"><sheets><sheet name="Parts" sheetId="1" r:id="rId7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{_MAIN}">{"".join(f"<si><t>{escape(n)}</t></si>" for n in names)}</sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}"><sheetData>{cells}</sheetData></worksheet>',
    })


@register("s10_workbook_rows", """WITH r AS (SELECT p_brand || ':' || p_size AS path, p_partkey, p_name, p_size, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) + 1 AS row FROM part)
SELECT path, 'Parts' AS sheet, row::INT AS row, col, value FROM r, LATERAL (VALUES (1, p_partkey::VARCHAR), (3, p_name), (4, p_size || '.5%')) v(col, value)""")  # fmt: skip
def s10_workbook_rows(spark, d):
    """Cells of a workbook for each brand and size: numbers, shared and inline strings, an empty column, a cell without a reference."""
    parts = table(spark, d, "part").select(F.concat_ws(":", "p_brand", "p_size").alias("file"), "p_partkey", "p_name", "p_size")
    return O.workbook_rows(_packed(parts, "file", _workbook)).drop("error")


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _document(p: pd.DataFrame) -> bytes:
    text = p["text"].iloc[0] or ""
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{"Heading" if x[:1].isupper() else "Body"}"/></w:pPr><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
    return _zip(**{"word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>'})


@register("s11_document_paragraphs", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) SELECT doc_id, count(*) AS paragraphs, sum(i * length(x))::BIGINT AS weighed FROM l GROUP BY doc_id")
def s11_document_paragraphs(spark, d):
    """Paragraphs of the documents, each packed as a word-processor file."""
    found = O.paragraph_rows(_packed(table(spark, d, "documents").select("doc_id", "text"), "doc_id", _document))
    return found.filter("error IS NULL").groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count("*").alias("paragraphs"), F.sum(F.col("n") * F.length("text")).alias("weighed"))


def _pdf(p: pd.DataFrame) -> bytes:
    lines = (p["text"].iloc[0] or "").split("\n")
    shown = " T* ".join(f"<FEFF{x.encode('utf-16-be', 'replace').hex()}> Tj" if i % 2 else "[" + " 20 ".join(f"<FEFF{y.encode('utf-16-be', 'replace').hex()}>" for y in (x[:5], x[5:])) + "] TJ" for i, x in enumerate(lines))
    data = zlib.compress(f"BT /F1 12 Tf {shown} ET".encode())
    return b"%PDF-1.4\n1 0 obj\n<< /Length " + str(len(data)).encode() + b" /Filter /FlateDecode >>\nstream\n" + data + b"\nendstream\nendobj\n%%EOF"


@register("s11_pdf_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) SELECT doc_id, count(*) AS lines, sum(i * length(x))::BIGINT AS weighed FROM l GROUP BY doc_id")
def s11_pdf_lines(spark, d):
    """Lines of the documents, each packed as a PDF with a deflated text stream."""
    found = O.pdf_rows(_packed(table(spark, d, "documents").select("doc_id", "text"), "doc_id", _pdf))
    return found.filter("error IS NULL").groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count("*").alias("lines"), F.sum(F.col("n") * F.length("text")).alias("weighed"))


def _scripts(spark, d):
    """path, t: a script for every hundred parts of a brand, a line a part: functions, classes, constants, some of them exported."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("p"), k.cast("string"))
    line = F.when(k % 3 == 0, F.concat(F.lit("export class "), name, F.lit(" extends Base {}"))).when(k % 3 == 1, F.concat(F.lit("function "), name, F.lit("(x) {}"))).otherwise(F.concat(F.lit("const "), name, F.lit(" = (x) => x")))
    path = F.concat("p_brand", F.lit("/"), F.floor(k / 100).cast("string"), F.lit(".ts"))
    return table(spark, d, "part").groupBy(path.alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("line")))), lambda x: x["line"]), "\n").alias("t"))


_SYMBOLS = """lines AS (SELECT p_brand || '/' || (p_partkey // 100) || '.ts' AS file_path, p_partkey AS k, row_number() OVER (PARTITION BY p_brand, p_partkey // 100 ORDER BY p_partkey) AS line FROM part),
symbols AS (SELECT file_path, CASE k % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'arrow' END AS kind, 'p' || k AS name, line::INT AS line, k % 3 = 0 AS exported FROM lines)"""


def _symbols(spark, d):
    rows = _scripts(spark, d).withColumn("file_path", F.col("path"))
    return SP.explode_with(rows, SP.script_symbols, ["path", "t"], "kind string, id string, name string, line int, exported boolean")


@register("x17_script_symbols", f"WITH {_SYMBOLS} SELECT *, kind || ':' || file_path || ':' || name AS id FROM symbols")
def x17_script_symbols(spark, d):
    """Symbols of scripts with their lines."""
    return _symbols(spark, d)


@register("j32_changed_symbols", f"WITH {_SYMBOLS} SELECT file_path, kind, name, line FROM symbols WHERE file_path LIKE 'Brand#1%' QUALIFY row_number() OVER (PARTITION BY file_path, kind ORDER BY line, name) <= 2")
def j32_changed_symbols(spark, d):
    """The first two symbols of a kind in each changed file."""
    files = _scripts(spark, d).select("path").filter(F.col("path").startswith("Brand#1"))
    symbols = _symbols(spark, d).withColumnsRenamed({"line": "start_line", "id": "node_id"})
    return E.changed_symbols(files, symbols, per_kind=2).select("file_path", "kind", "name", F.col("start_line").alias("line"))


@register("x16_python_symbols", """WITH l AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT 'c' || c || '.py' AS file, 'symbol' AS kind, 'f' || k AS name, (2 * n - 1)::INT AS line FROM l UNION ALL SELECT 'c' || c || '.py', 'call', 'g' || (k % 5), (2 * n)::INT FROM l""")  # fmt: skip
def x16_python_symbols(spark, d):
    """Functions and calls of a module for every customer, a function an order."""
    code = F.concat(F.lit("def f"), F.col("o_orderkey").cast("string"), F.lit("():\n    g"), (F.col("o_orderkey") % 5).cast("string"), F.lit("()"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", code.alias("t")))), lambda x: x["t"])
    mods = table(spark, d, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".py")).alias("file")).agg(F.array_join(lines, "\n").alias("t"))
    found = SP.explode_with(mods.withColumn("path", F.col("file")), SP.python_symbols, ["path", "t"], "kind string, id string, name string, target string, line int, end int, confidence double")
    return found.select("file", "kind", "name", "line")


@register("q23_sketches", """SELECT event_type, count(*) AS rows, count(value) AS held, min(value) AS least, max(value) AS greatest, TRUE AS distinct_within, TRUE AS median_within FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' GROUP BY event_type""")
def q23_sketches(spark, d):
    """Summaries a day and kind, kept in two goes; what they answer from the fifth of January on, and whether it is within the bounds."""
    events, path = table(spark, d, "events"), scratch_path(spark, "sketches")
    day = F.to_date("ts").alias("day")
    SK.keep(events.filter("event_id % 2 = 0"), path, [day], ["event_type"], "user_id", "value")
    SK.keep(events.filter("event_id % 2 = 1"), path, [day], ["event_type"], "user_id", "value", mode="append")
    told = SK.answer(spark, path, ["event_type"], F.col("day") >= "2024-01-05")
    some = events.filter(F.col("ts") >= "2024-01-05")
    users = some.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    below = some.join(F.broadcast(told.select("event_type", F.col("quantiles")[0].alias("median"))), "event_type")  # a row a kind
    ranks = below.groupBy("event_type").agg((F.count_if(F.col("value") < F.col("median")) / F.count("value")).alias("under"), (F.count_if(F.col("value") <= F.col("median")) / F.count("value")).alias("upto"))
    both = told.join(users, "event_type").join(ranks, "event_type")
    near = F.abs(F.col("distinct") - F.col("users")) <= SK.DISTINCT * F.col("users") + 1
    median = (F.col("under") <= 0.5 + SK.RANK) & (F.col("upto") >= 0.5 - SK.RANK)
    return both.select("event_type", "rows", "held", "least", "greatest", near.alias("distinct_within"), median.alias("median_within"))
