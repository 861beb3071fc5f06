"""Splitters and parsers that need a real program: clauses, subject grammar, Markdown, source code, diffs.

Each is a plain function of one text and a mapInPandas operator around it; a task holds one batch of texts."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .text import NUMERALS

# The clause grammar.
_NUM = "一二三四五六七八九十百千零"
ARTICLE = re.compile(rf"(?:^|\n)\s*第([{_NUM}\d]+)条\s*")
SECTIONS = (
    (re.compile(r"(?:^|\n)\s*([一二三四五六七八九十]+)[、．.]\s*"), "article"),
    (re.compile(r"(?:^|\n)\s*[（(]([一二三四五六七八九十]+)[)）]\s*"), "paragraph"),
    (re.compile(r"(?:^|\n)\s*(\d+)[.、．]\s*"), "article"),
)
CROSS_REFERENCE = re.compile(rf"(?:依照|按照|参照|依据|根据|适用|违反)(?:本法|本条例|本规定|本办法)?第([{_NUM}\d]+)条")
CLAUSE_LEAST, CLAUSE_CUT = 30, 5000
SHARED_SUFFIXES = ("费用", "成本", "收入", "资产", "负债", "公积金")


_POWERS = (("千", 1000), ("百", 100), ("十", 10))


def numeral(s: str) -> int:
    """Value of a Chinese or decimal numeral, 0 if it is none: what stands before a unit counts that unit, once at least."""
    if s.isdigit():
        return int(s)
    if set(s) - NUMERALS.keys():
        return 0
    for unit, power in _POWERS:
        before, found, after = s.partition(unit)
        if found:
            return (numeral(before) or 1) * power + numeral(after)
    return NUMERALS[s[-1]] if s else 0


def _bodies(text: str, marks: list[re.Match]) -> Iterator[tuple[re.Match, str]]:
    for m, after in zip(marks, [*marks[1:], None]):
        yield m, text[m.end() : after.start() if after else len(text)].strip()


def split_clauses(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """(article, paragraph, title, body, references joined by ;) of a law's clauses; numbered sections where
    there are no articles, if at least three."""
    text = text or ""
    if marks := list(ARTICLE.finditer(text)):
        out = []
        for m, body in _bodies(text, marks):
            n = numeral(m[1])
            if n > 0 and len(body) >= CLAUSE_LEAST:
                title = re.match(r"[【\[]([^】\]]+)[】\]]\s*", body)
                refs = ";".join(f"art{numeral(r[1])}" for r in CROSS_REFERENCE.finditer(body))
                out.append((n, 0, title[1].strip() if title else "", body[:CLAUSE_CUT], refs))
        return out
    for pattern, level in SECTIONS:
        marks = list(pattern.finditer(text))
        if len(marks) >= 3:
            found = [(numeral(m[1]), body) for m, body in _bodies(text, marks)]
            found = [(n, b) for n, b in found if 0 < n <= (200 if pattern is SECTIONS[2][0] else 10**6) and len(b) >= CLAUSE_LEAST]
            return [(n if level == "article" else 0, 0 if level == "article" else n, "", b[:CLAUSE_CUT], "") for n, b in found]
    return []


def split_parts(text: str | None, marks: tuple[str, ...] = (r"[（(][一二三四五六七八九十]+[)）]", r"(?:^|\n)\d+[.、．]")) -> list[tuple[str, str]]:
    """(number, content) of a clause's parts: the first kind of mark that gives two parts of 20 characters or more."""
    if not text or len(text) < 100:
        return []
    for mark in marks:
        pieces, number, start = [], "", 0
        for m in [*re.finditer(mark, text), None]:
            body = text[start : m.start() if m else len(text)].strip()
            if len(body) >= 20:
                pieces.append((number, body))
            if m:
                number, start = m[0].strip(), m.end()
        if len(pieces) >= 2:
            return pieces
    return []


def subjects(raw: str | None) -> list[tuple[str, str]]:
    """(token, combinator) of a cell in which + adds, / offers alternatives and a last suffix may be shared."""
    cell = re.sub(r"\(.*?\)", "", (raw or "").replace("as_", "").strip())
    sums = [p for p in re.split(r"\s*\+\s*", cell)]
    out = []
    for part in filter(None, map(str.strip, sums)):
        options = re.split(r"\s*/\s*", part)
        suffix = next((s for s in SHARED_SUFFIXES if options[-1].endswith(s) and len(options[-1]) > len(s)), "") if len(options) > 1 else ""
        options = [o if not suffix or o.endswith(suffix) else o + suffix for o in options]
        kinds = [k for k, yes in (("additive", len(sums) > 1), ("alternative", len(options) > 1)) if yes]
        out += [(re.sub(r"\s+", "", o), "+".join(kinds) or "atomic") for o in options if o.strip()]
    return out


def sections(text: str | None) -> list[tuple[int, str, int, int, int, int]]:
    """(idx, heading, level, start line, end line, words): a section ends before the next heading that is not
    deeper; headings in code fences count."""
    lines = (text or "").split("\n")
    heads = [(i, len(m[1]), m[2].strip()) for i, x in enumerate(lines, 1) if (m := re.match(r"(#{1,6})\s+(.+)", x))]
    out = []
    for k, (line, level, heading) in enumerate(heads):
        end = next((n - 1 for n, other, _ in heads[k + 1 :] if other <= level), len(lines))
        out.append((k, heading, level, line, end, len(" ".join(lines[line:end]).split())))
    return out


def python_symbols(path: str, text: str | None, calls: int = 500) -> list[tuple[str, str, str, str, int, int, float]]:
    """Rows (row kind, id, name, target, start, end, confidence): symbols, imports, calls, bases of a Python file."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return []
    out, seen = [], set()

    def visit(node: ast.AST, scope: str, inside: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if inside == "class" else "function"
                key = f"{kind}:{path}:{child.name}"
                out.append(("symbol", key, child.name, kind, child.lineno, child.end_lineno or child.lineno, 1.0))
                if kind == "class":
                    out.extend(("base", key, b.id if isinstance(b, ast.Name) else b.attr, "", child.lineno, child.lineno, 0.9) for b in child.bases if isinstance(b, (ast.Name, ast.Attribute)))
                visit(child, key, kind)
                continue
            if isinstance(child, ast.Import):
                out.extend(("import", scope, a.name, a.asname or "", child.lineno, child.lineno, 1.0) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.extend(("import", scope, "." * child.level + (child.module or ""), a.name, child.lineno, child.lineno, 1.0) for a in child.names)
            elif isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
                if name and (scope, name) not in seen and len(seen) < calls:
                    seen.add((scope, name))
                    out.append(("call", scope, name, "", child.lineno, child.lineno, 0.9 if isinstance(f, ast.Name) else 0.6))
            visit(child, scope, inside if isinstance(child, ast.ClassDef) else "")

    visit(tree, f"file:{path}", "")
    return out


_SCRIPT = (
    ("class", re.compile(r"\bclass\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+([A-Za-z_$][\w$.]*))?")),
    ("function", re.compile(r"\bfunction\s*\*?\s+([A-Za-z_$][\w$]*)\s*\(")),
    ("arrow", re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*=>")),
    ("interface", re.compile(r"\binterface\s+([A-Za-z_$][\w$]*)")),
)


def line_starts(text: str) -> list[int]:
    """Offsets at which the lines of a text begin."""
    return [0, *(m.end() for m in re.finditer("\n", text))]


def script_symbols(path: str, text: str | None) -> list[tuple[str, str, str, int, bool]]:
    """(kind, id, name, line, exported) of a JavaScript or TypeScript file."""
    text = text or ""
    out, starts = [], line_starts(text)
    for kind, pattern in _SCRIPT:
        for m in pattern.finditer(text):
            out.append((kind, f"{kind}:{path}:{m[1]}", m[1], bisect_right(starts, m.start()), "export" in text[max(0, m.start() - 20) : m.start()]))
    return sorted(out, key=lambda r: r[3])


def added_lines(diff: str | None) -> list[tuple[str, int, str]]:
    """(file, line, text) of the lines that a unified diff adds."""
    out, name, line = [], "", 0
    for x in (diff or "").split("\n"):
        if x.startswith("+++ "):
            name = re.sub(r"^b/", "", x[4:].split("\t")[0].strip())
        elif m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)", x):
            line = int(m[1])
        elif x.startswith("+"):
            out.append((name, line, x[1:]))
            line += 1
        elif x.startswith(" "):
            line += 1
    return out


def journal_blocks(text: str | None) -> list[tuple[int, str, int]]:
    """(block, title, lines): runs of entry lines (借 or 贷), with the plain line before them as title."""
    out, title, size, last = [], "", 0, ""
    for x in [*(text or "").split("\n"), ""]:
        x = x.strip()
        if re.match(r"[借贷][：:]", x):
            title, size = (last if not size else title), size + 1
        else:
            if size and not x:
                out.append((len(out), title, size))
                size = 0
            last = x
    return out


def explode_with(df: DataFrame, fn: Callable, args: list[str], schema: str) -> DataFrame:
    """df's columns but the texts that fn reads (args), and a row for each tuple that fn(*args) gives; schema: names and types of the tuple."""
    names = [part.split()[0] for part in schema.split(",")]
    others = [f for f in df.schema.fields if f.name not in args]
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in (whole.iloc[at : at + 64] for whole in batches for at in range(0, len(whole), 64)):
            found = p[[f.name for f in others]].assign(__found=[fn(*row) for row in zip(*(p[a] for a in args))]).explode("__found").dropna(subset=["__found"])
            if len(found):
                parts = pd.DataFrame(found["__found"].tolist(), columns=names, index=found.index)
                yield pd.concat([found.drop(columns="__found"), parts], axis=1)

    return df.mapInPandas(run, f"{kept}{schema}")
