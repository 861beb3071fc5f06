"""Workbooks, word-processor files and PDFs as rows, from (path, content) as the binaryFile source gives them.

A file is read by the task that holds it, member by member. A damaged file, or one of another kind, gives one row with `error` and nothing
else; so does a null content."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, content of the files of a tree whose names match a glob."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ET.Element, *tags: str) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) in tags)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n


def workbook_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """sheet, row, column (from 1), value of the cells that hold something; numbers as they are stored, booleans as TRUE and FALSE."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_texts(x, "t") for x in ET.parse(z.open("xl/sharedStrings.xml")).getroot()] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ET.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        for sheet in (x for x in ET.parse(z.open("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"):
            target = targets[sheet.get(_REL)]
            row = 0
            for event, node in ET.iterparse(z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}"), ("start", "end")):
                tag = _local(node.tag)
                if tag == "row" and event == "start":
                    row, col = int(node.get("r") or row + 1), 0
                elif tag == "c" and event == "end":
                    col = _column(node.get("r") or "") or col + 1
                    kind = node.get("t")
                    value = _texts(node, "t") if kind == "inlineStr" else _texts(node, "v")
                    if kind == "s" and value:
                        value = shared[int(value)]
                    elif kind == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    if value:
                        yield sheet.get("name"), row, col, value
                elif tag == "row":
                    node.clear()  # a long sheet is not kept


def document_paragraphs(content: bytes) -> Iterator[tuple[int, str, str]]:
    """number (from 1), style, text of the paragraphs; tabs and line breaks as characters."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        n = 0
        for _, p in ET.iterparse(z.open("word/document.xml")):
            if _local(p.tag) != "p":
                continue
            n += 1
            style = next((v for x in p.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
            kinds = {"tab": "\t", "br": "\n", "cr": "\n"}
            yield n, style, "".join((x.text or "") if (k := _local(x.tag)) == "t" else kinds.get(k, "") for x in p.iter())
            p.clear()


_OPERATORS = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?[\d.]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token.startswith(b"<"):
        raw = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((raw + b"0" * (len(raw) % 2)).decode())
    else:
        octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in b"\r\n" else _ESCAPES.get(m[1], m[1])
        raw = re.sub(rb"\\([0-7]{1,3}|.)", octal, token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")


def pdf_lines(content: bytes) -> Iterator[tuple[int, str]]:
    """number (from 1), text of the lines that the text operators of plain and deflated streams show, in the order of the file.

    Strings are Latin-1 or marked UTF-16; fonts with codes of their own give their codes."""
    if not content.startswith(b"%PDF"):
        raise ValueError("no PDF header")
    n = 0
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\n?endstream", content, re.S):
        head = content[content.rfind(b"obj", 0, m.start()) : m.start()]
        data = zlib.decompressobj().decompress(m[1]) if b"FlateDecode" in head else m[1]
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", data, re.S):
            line, held = [], []
            for token in _OPERATORS.findall(block):
                if token[:1] in b"(<":
                    held.append(_string(token))
                elif token in (b"Td", b"TD", b"T*", b"Tm", b"'", b'"') and line:
                    n += 1
                    yield n, "".join(line)
                    line = []
                if token in (b"Tj", b"TJ", b"'", b'"'):
                    line, held = line + held, []
            if line:
                n += 1
                yield n, "".join(line)


def _rows(content_rows: DataFrame, read: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    names = ["path", *(c.split()[0] for c in schema.split(", ")), "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    found = [(path, *x, None) for x in read(content or b"")]
                except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, IndexError, TypeError, zlib.error) as e:
                    found = [(path, *[None] * (len(names) - 2), type(e).__name__)]
                for at in range(0, len(found), 10_000):
                    yield pd.DataFrame(found[at : at + 10_000], columns=names).astype(object)

    return content_rows.select("path", "content").mapInPandas(run, f"path string, {schema}, error string")


def workbook_rows(content_rows: DataFrame) -> DataFrame:
    """Path, sheet, row, col, value, error."""
    return _rows(content_rows, workbook_cells, "sheet string, row int, col int, value string")


def paragraph_rows(content_rows: DataFrame) -> DataFrame:
    """Path, n, style, text, error."""
    return _rows(content_rows, document_paragraphs, "n int, style string, text string")


def pdf_rows(content_rows: DataFrame) -> DataFrame:
    """Path, n, text, error."""
    return _rows(content_rows, pdf_lines, "n int, text string")
