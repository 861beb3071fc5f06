"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host and layout.

A page is a stream of tokens: tags (name and class) and texts. A wrapper starts as one page's stream and is
generalised by one sample page after another. Streams are aligned; texts that differ become slots, runs of tags that
repeat become repeated groups (x)+, and what only one side has becomes optional (x)?. The outcome has no alternatives,
so it is one regular expression over tokens.

What a wrapper tells of a page: its constant texts, which stand on every sample page at the same place, belong to the
template; what falls into slots, repeated and optional groups is the page's own. The content element is an `article` or
`main` where the template has one, else the deepest element that holds HOLDS of the own text's characters, weighed over all sample
pages, and every first-rank heading among it. A page's main text is its own text in that element. Pages need not
match: a text at a place that the wrapper does not know counts as the page's own, and a page without the content element is
read from its own article, main or body.

Page furniture (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) inside or beside
the content is known by tag, role, hidden attributes, or a class or id all of whose words name furniture or
layout (`cookie-notice`, not `share-prices`). An element that is named so but holds the content element or half of the
page's text is none. Template texts inside the content go only if the page's own text there is most of it, so pages that
repeat each other keep their articles. If all this leaves nothing of a page that has text outside tag furniture, names and constants are disregarded.

Character references are decoded text by text, white space inside a block becomes one space, blocks are joined by a blank line.

Scale: SAMPLE pages of a host and layout (those with the least hashes, pages under LONG characters first) leave their task;
they are chosen by partial aggregation over all pages. They decide wrappers only: every page is read whole, by its own
tokens. Wrappers are broadcast only if they are counted and small, else joined by host and layout, with the hot host's
pages split by skew handling. Extraction is row-local and linear in the page.

Defined cases: null html is an empty page (text ''); unclosed or stray tags and cut-off pages are read as far as
they go; null or odd urls share a host ''; repeated pages count once for a wrapper; an empty table gives no rows;
other columns do not matter.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, whole_texts

#: Pages of a host and layout that a wrapper is inferred from; longer pages are taken only where there are too few others.
SAMPLE, LONG = 8, 1 << 16
#: Sample pages that must share a text before it counts as the template's.
AGREE = 4
#: Share of the own text that a content element without a telling tag must hold, and that own text must have beside constants.
HOLDS, MOST = 0.9, 0.6
#: Bytes of wrappers that may be broadcast.
BROADCAST = 8 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(noscript|template|textarea|title|svg|iframe)\b[^>]*+>(?:(?!<\2\b).)*?</\2\s*+>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?][^>]*+>"
    r"|([^<]++|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo mrow ms msub msup msubsup mtext mfrac msqrt mroot munder mover munderover mspace mstyle semantics annotation".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset("nav header footer aside form head menu dialog fieldset select button object canvas noscript template textarea title iframe".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of names that say furniture, and words that say no more than where or what kind of box.
_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense adbox adslot banner promo promoted promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav aside rail footer header masthead topbar toolbar comment comments disqus replies respond cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget pagination pager skip copyright".split())
_LAYOUT = frozenset("area bar block box btn button buttons column container form global group holder icons inline inner item items left right top bottom link links list main message outer page panel part post posts primary region row secondary section site slot text the thread title unit widget wrap wrapper zone".split())
#: End tags that pages may leave out; without them, pages that do and pages that don't have one stream.
_OPTIONAL = frozenset("/p /li /td /th /tr /dt /dd /option /tbody /thead /body /html".split())
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
TEXT = "#"
#: What says that an element is furniture: nothing, a class or id, or its tag, role or being hidden.
NO, NAMED, SURE = 0, 1, 2


def _named(name: str) -> bool:
    words = [w.lower() for w in _SPLIT.split(name) if w and not w.isdigit()]
    return any(w in _WORDS for w in words) and all(w in _WORDS or w in _LAYOUT for w in words)


@lru_cache(maxsize=1 << 14)
def _attributes(raw: str) -> tuple[str, int]:
    """(class and id as part of a tag's name, whether they tell page furniture)."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if found.get("itemprop", "").lower() == "articlebody":
        return ".articlebody", NO
    sure = found.get("role", "").lower() in _ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    names = [*found.get("class", "").split(), *found.get("id", "").split()]
    kept = [re.sub(r"\d+", "0", c) for c in found.get("class", "").split()[:3]] or ([re.sub(r"\d+", "0", found["id"])] if found.get("id") else [])
    return "".join(f".{c}" for c in kept), SURE if sure else NAMED if any(map(_named, names)) else NO


def tokens(page: str | None) -> Iterator[tuple[str, str, int]]:
    """(name, text or tag key, furniture) of each text (name TEXT), start tag and end tag ("/" before its name)."""
    for m in _TOKEN.finditer(page or ""):
        if m[6] is not None:
            yield TEXT, m[6], NO
        elif m[4] is not None:
            name = m[4].lower()
            if m[3]:
                yield "/" + name, "/" + name, NO
            else:
                key, bad = _attributes(m[5]) if m[5] else ("", NO)
                yield name, name + key, SURE if name in _FURNITURE else bad


def _below(path: int, key: str) -> int:
    """The path of an element as one number, from its parent's."""
    return xxhash.xxh3_64_intdigest(key, seed=path) >> 1


class Element:
    __slots__ = ("name", "key", "furniture", "parent", "depth", "chars", "path", "region", "barred")

    def __init__(self, name: str, key: str, furniture: int, parent: Element | None):
        self.name, self.key, self.furniture, self.parent, self.chars = name, key, furniture, parent, 0
        self.depth, above = (parent.depth + 1, parent.path) if parent else (0, 0)
        self.path = above if not parent or name in _INLINE or f"/{name}" in _OPTIONAL else _below(above, key)


def walk(page: str | None) -> Iterator[tuple[str, str, Element]]:
    """(name, text or tag key, innermost element around it) of all tokens. Inline elements are elements only if they are furniture."""
    root = at = Element("", "", NO, None)
    open_: Counter = Counter()
    for name, value, furniture in tokens(page):
        if name == TEXT or name in _VOID:
            yield name, value, at
            continue
        plain = name.lstrip("/")
        if plain in _INLINE and not (furniture if name[0] != "/" else open_[plain]) and not (name[0] != "/" and open_[plain]):
            yield name, value, at
            continue
        if name[0] != "/":
            ends = ("p",) if plain == "p" else ("p", name) if f"/{name}" in _OPTIONAL else ("p",) if plain not in _INLINE else ()
            while at is not root and (at.name in ends or plain not in _INLINE and at.name in _INLINE):
                open_[at.name] -= 1
                at = at.parent
            if name == "header" and furniture == SURE and open_["article"]:
                furniture = NO  # an article's own heading
            at = Element(name, value, NO if name in ("html", "body", "article", "main") and furniture != SURE else furniture, at)
            open_[name] += 1
        elif open_[plain]:
            while True:
                gone, at = at, at.parent
                open_[gone.name] -= 1
                if gone.name == plain:
                    break
        yield name, value, at


Node = tuple  # ("tag", key) | ("text", constant or None) | ("opt", [nodes]) | ("rep", [nodes])


def _clean(text: str) -> str:
    return " ".join(html_lib.unescape(text).split())


def _stream(page: str) -> list[Node]:
    out: list[Node] = []
    for name, value, _ in walk(page):
        if name == TEXT:
            if text := _clean(value):
                out.append(("text", text))
        elif name.lstrip("/") not in _INLINE and name not in _OPTIONAL:
            out.append(("tag", value))
    return out


def _shape(n: Node) -> str:
    return n[1] if n[0] == "tag" else TEXT if n[0] == "text" else f"({'|'.join(map(_shape, n[1]))}){'?' if n[0] == 'opt' else '+'}"


def fold(nodes: list[Node], longest: int = 12) -> list[Node]:
    """Adjacent equal runs become one repeated group; texts in it that differ become slots."""
    out: list[Node] = []
    for n in nodes:
        out.append(n)
        again = True
        while again:
            again = False
            shapes = [_shape(x) for x in out[-2 * longest - 1 :]]
            for size in range(1, min(longest, len(shapes) // 2) + 1):
                if size == 1 and out[-1][0] in ("text", "tag"):
                    if out[-2][0] != "rep" or [_shape(x) for x in out[-2][1]] != [_shape(out[-1])]:
                        continue
                tail = out[-size:]
                if len(out) > size and out[-size - 1][0] == "rep" and [_shape(x) for x in out[-size - 1][1]] == [_shape(x) for x in tail]:
                    out[-size - 1 :] = [("rep", [_merged(a, b) for a, b in zip(out[-size - 1][1], tail)])]
                    again = True
                    break
                if size > 1 and shapes[-size:] == shapes[-2 * size : -size]:
                    out[-2 * size :] = [("rep", [_merged(a, b) for a, b in zip(out[-2 * size : -size], tail)])]
                    again = True
                    break
    return out


def _merged(a: Node, b: Node) -> Node:
    if a[0] == "text":
        return a if a == b else ("text", None)
    if a[0] == "tag":
        return a
    return a[0], [_merged(x, y) for x, y in zip(a[1], b[1])]


def _bare(n: Node) -> tuple[Node, ...]:
    return tuple(n[1]) if n[0] in ("opt", "rep") else (n,)


def _bodies(nodes: list[Node], found: dict[tuple[str, ...], list[Node]]) -> dict[tuple[str, ...], list[Node]]:
    """Shapes of all repeated groups and what repeats in them."""
    for n in nodes:
        if n[0] in ("opt", "rep"):
            if n[0] == "rep":
                found.setdefault(tuple(map(_shape, n[1])), n[1])
            _bodies(n[1], found)
    return found


def _wrap(nodes: list[Node], bodies: dict[tuple[str, ...], list[Node]]) -> list[Node]:
    """One turn of a group that repeats on the other side is that group too."""
    shapes, out, i = [_shape(n) for n in nodes], [], 0
    sizes = sorted({len(b) for b in bodies}, reverse=True)
    while i < len(nodes):
        size = next((k for k in sizes if tuple(shapes[i : i + k]) in bodies), 0)
        if size:
            body = bodies[tuple(shapes[i : i + size])]
            out.append(("rep", [_merged(x, y) for x, y in zip(nodes[i : i + size], body)]))
        else:
            out.append(nodes[i])
        i += max(1, size)
    return out


def _joined(nodes: list[Node]) -> list[Node]:
    """Neighbours that repeat or leave out the same thing are one group."""
    out: list[Node] = []
    for n in nodes:
        if out and out[-1][0] in ("opt", "rep") and n[0] in ("opt", "rep"):
            a, b = out[-1], n
            x, y = (a[1][0] if a[0] == "opt" and a[1][0][0] == "rep" else a), (b[1][0] if b[0] == "opt" and b[1][0][0] == "rep" else b)
            if list(map(_shape, x[1])) == list(map(_shape, y[1])):
                rep = ("rep", [_merged(p, q) for p, q in zip(x[1], y[1])])
                out[-1] = rep if "rep" in (a[0], b[0]) else ("opt", [rep])
                continue
        out.append(n)
    return out


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """The least general wrapper of both found by one alignment of their shapes."""
    a, b = _wrap(a, _bodies(b, {})), _wrap(b, _bodies(a, {}))
    x, y = [_shape(n).rstrip("?+") for n in a], [_shape(n).rstrip("?+") for n in b]
    # a repeated group on one side stands for one turn of it on the other
    lengths = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, below = lengths[i], lengths[i + 1]
        for j in range(len(y) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
    out: list[Node] = []
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            if a[i][0] == b[j][0]:
                out.append(_merged(a[i], b[j]))
            else:
                kind = "rep" if "rep" in (a[i][0], b[j][0]) else "opt"
                both = [_merged(p, q) for p, q in zip(_bare(a[i]), _bare(b[j]))]
                out.append((kind, both) if "opt" not in (a[i][0], b[j][0]) or kind == "opt" else ("opt", [("rep", both)]))
            i, j = i + 1, j + 1
        elif j >= len(y) or i < len(x) and lengths[i + 1][j] >= lengths[i][j + 1]:
            out.append(a[i] if a[i][0] == "opt" else ("opt", [a[i]]))
            i += 1
        else:
            out.append(b[j] if b[j][0] == "opt" else ("opt", [b[j]]))
            j += 1
    return _joined(out)


def infer(pages: list[str]) -> list[Node]:
    """The wrapper of a host's sample pages."""
    wrapper: list[Node] | None = None
    for page in sorted(set(pages), key=lambda p: (len(p), p)):
        mine = fold(_stream(page))
        wrapper = mine if wrapper is None else fold(align(wrapper, mine))
    return wrapper or []


def expression(wrapper: list[Node]) -> tuple[str, list[str]]:
    """(regular expression over one character a token, keys of the tokens): TEXT is `t`, tags are private characters."""
    keys: dict[str, str] = {}

    def of(n: Node) -> str:
        if n[0] == "text":
            return "t?"
        if n[0] == "tag":
            return keys.setdefault(n[1], chr(0xE000 + len(keys)))
        return f"(?:{''.join(map(of, n[1]))}){'?' if n[0] == 'opt' else '+'}"

    return "".join(map(of, wrapper)), list(keys)


def template_texts(wrapper: list[Node], pages: list[str]) -> set[tuple[int, str]]:
    """(path, text) of what all pages have in common: the wrapper's constants that are in no optional group, and texts that
    every page has at one place although a repeated group of the wrapper has taken them up."""
    found: set[tuple[int, str]] = set()
    path: list[tuple[str, int]] = [("", 0)]

    def visit(nodes: list[Node], optional: bool) -> None:
        for n in nodes:
            if n[0] == "tag":
                name = n[1].split(".")[0]
                if name[0] != "/":
                    if name not in _VOID and f"/{name}" not in _OPTIONAL:
                        path.append((name, _below(path[-1][1], n[1])))
                elif name[1:] in [q for q, _ in path]:
                    while path.pop()[0] != name[1:]:
                        pass
            elif n[0] == "text":
                if n[1] is not None and not optional:
                    found.add((path[-1][1], n[1]))
            else:
                visit(n[1], optional or n[0] == "opt")

    visit(wrapper, False)
    texts = [{(at.path, t) for name, value, at in walk(p) if name == TEXT and (t := _clean(value))} for p in pages]
    return set.intersection(*texts) | found & set.union(*texts) if texts else found


def _landmark(key: str) -> bool:
    return key.split(".")[0] in ("article", "main") or ".articlebody" in key


def content_element(pages: list[str], constants: set[tuple[int, str]]) -> str:
    """Key of the element that holds the pages' own text, '' if the body does."""
    held: Counter = Counter()
    headed: Counter = Counter()
    total = headings = 0
    for page in pages:
        for name, value, at in walk(page):
            text = _clean(value) if name == TEXT else ""
            if not text or (at.path, text) in constants:
                continue
            line = []
            while at.parent is not None and not at.furniture:
                line.append(at)
                at = at.parent
            if at.parent is None:
                heading = any(e.name == "h1" for e in line)
                total, headings = total + len(text), headings + heading
                for place in {(e.depth, e.path, e.key) for e in line if e.name in ("article", "main", "div", "section", "td") or ".articlebody" in e.key}:
                    held[place] += len(text)
                    headed[place] += heading
    for name in ("article", "main"):
        if marked := [(-n, p) for p, n in held.items() if p[2].split(".")[0] == name]:
            return min(marked)[1][2]
    whole = [p for p, n in held.items() if n >= HOLDS * total and headed[p] == headings]
    return max(whole)[2] if whole else ""


def extract(page: str | None, content: str = "", constants: frozenset[tuple[int, str]] = frozenset()) -> str:
    """The page's main text; content: its wrapper's content element; constants: its template's texts."""
    rows = list(walk(page))
    elements: dict[int, Element] = {}
    for name, value, at in rows:
        elements[id(at)] = at
        at.chars += len(value.strip()) if name == TEXT else 0
    ordered = _from_the_top(elements.values())
    for e in reversed(ordered):
        if e.parent is not None:
            e.parent.chars += e.chars
    total = ordered[0].chars if ordered else 0

    def text(is_content, names: bool, dropped) -> str:
        for e in ordered:
            up = e.parent
            e.region = up is not None and up.region or is_content(e) and not (up is not None and up.barred)
            begins = e.region and not (up is not None and up.region)
            bad = not begins and (e.furniture == SURE or names and e.furniture == NAMED and e.chars * 2 < total)
            # outside the content only what is surely furniture bars it; a name does not
            e.barred = up is not None and up.barred or bad and (e.region or e.furniture == SURE)
        blocks: list[str] = []
        parts: list[str] = []
        own = other = 0

        def close() -> None:
            if parts and (block := " ".join("".join(parts).split())):
                blocks.append(block)
            parts.clear()

        for name, value, at in rows:
            if name == TEXT:
                if at.region and not at.barred:
                    if dropped and (at.path, _clean(value)) in dropped:
                        other += len(value)
                    else:
                        own += len(value)
                        parts.append(html_lib.unescape(value))
            elif name == "br":
                parts.append(" ")
            elif name.lstrip("/") not in _INLINE:
                close()
        close()
        return "" if other and own < MOST * (own + other) else "\n\n".join(blocks)

    keys = {e.key for e in ordered}
    tests = [lambda e: e.key == content] if content in keys else []
    if not _landmark(content) or content not in keys:
        found = [t for t in ("article", "main") if any(k.split(".")[0] == t or t == "article" and ".articlebody" in k for k in keys)]
        tests = [lambda e, t=t: e.name == t or t == "article" and ".articlebody" in e.key for t in found] + tests
    tests.append(lambda e: e.parent is None)
    for names, dropped in ((True, constants), (True, frozenset()), (False, frozenset())):
        for is_content in tests:
            if out := text(is_content, names, dropped):
                return out
    return ""


def _from_the_top(elements) -> list[Element]:
    """Elements with every parent before its children."""
    out: list[Element] = []
    seen: set[int] = set()
    for e in elements:
        line = []
        while e is not None and id(e) not in seen:
            seen.add(id(e))
            line.append(e)
            e = e.parent
        out += reversed(line)
    return out


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def layout(html: Column) -> Column:
    """The classes of a page's body, article and main elements: pages of one template have them in common."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(body|article|main)\b[^>]*>"), F.lit(0))
    named = F.transform(tags, lambda t: F.concat(F.lower(F.regexp_extract(t, r"^<(\w+)", 1)), F.lit("."), F.regexp_replace(F.regexp_extract(t, r"(?i)\sclass\s*=\s*[\"']?([^\s\"'>]*)", 1), r"\d+", "0")))
    return F.array_join(F.array_sort(F.array_distinct(named)), " ")


def wrapper_of(sample: list[str]) -> dict:
    """content: key of the content element; constants: (path, text) of the template; regex and its tokens' keys."""
    pages = list(dict.fromkeys(sample))
    wrapper = infer(pages)
    constants = template_texts(wrapper, pages) if len(pages) >= AGREE else set()
    regex, keys = expression(wrapper)
    return {"content": content_element(pages, constants), "constants": sorted(constants), "regex": regex, "keys": keys}


@F.pandas_udf(T.StringType())
def _wrapper_of(pages: pd.Series) -> pd.Series:
    return pages.map(lambda sample: json.dumps(wrapper_of(list(sample))))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html", sample: int = SAMPLE) -> DataFrame:
    """host, layout, wrapper (JSON) for every host and layout."""
    rows = pages.filter(F.length(html) > 0).select(host(F.col(url)).alias("host"), layout(F.col(html)).alias("layout"), F.col(html).alias("html"), F.xxhash64(html).alias("h"))
    order = F.struct(F.greatest(F.length("html"), F.lit(LONG)).alias("n"), "h")
    picked = rows.groupBy("host", "layout", F.pmod("h", F.lit(sample)).alias("s")).agg(F.min_by("html", order).alias("html"))
    return picked.groupBy("host", "layout").agg(F.collect_list("html").alias("pages")).select("host", "layout", _wrapper_of("pages").alias("wrapper"))


@lru_cache(maxsize=1 << 10)
def _read(wrapper: str) -> tuple[str, frozenset[tuple[int, str]]]:
    w = json.loads(wrapper)
    return w["content"], frozenset(map(tuple, w["constants"]))


@F.pandas_udf(T.StringType())
def _main_text(pages: pd.Series, wrapper: pd.Series) -> pd.Series:
    return pd.Series([extract(p, *(_read(w) if w else ())) for p, w in zip(pages, wrapper)], dtype=object)


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars for every row of pages."""
    whole_texts(pages.sparkSession)
    found = durable(wrappers(pages, url, html)).toDF("__host", "__layout", "__wrapper")
    size = found.agg(F.sum(F.length("__host") + F.length("__layout") + F.octet_length("__wrapper") + 64)).first()[0] or 0
    rows = pages.select(F.col(key), F.col(url), F.col(html).alias("__html"), host(F.col(url)).alias("__h"), layout(F.coalesce(F.col(html), F.lit(""))).alias("__l"))
    joined = rows.join(F.broadcast(found) if size <= BROADCAST else found, (F.col("__h") == F.col("__host")) & (F.col("__l") == F.col("__layout")), "left")
    return joined.select(key, url, _main_text("__html", "__wrapper").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
