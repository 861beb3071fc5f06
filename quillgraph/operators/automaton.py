"""Many keywords against many texts: an Aho-Corasick automaton in flat arrays, stepped over all texts of a batch at once.

The trie of the keywords' UTF-8 bytes is built level by level from the sorted keywords, so are the failure links: no node is
an object. Edges stand in one open-addressed table (state and byte to state). Texts are cut into pieces that overlap by
the longest keyword, and all pieces of a batch step together: a step is a few look-ups on arrays, whatever the
number of keywords, and a piece follows failure links only where its byte has no edge.

A dictionary is cut by hash into parts of PART_BYTES bytes at most on average; each part is one automaton, broadcast (arrays of sixty times its
bytes at most), and one pass over the texts. Nothing is shuffled to find the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of keywords in one automaton; its arrays, which are broadcast, have 60 MB at most for that.
PART_BYTES = 1 << 20
#: Bytes of a piece of text, if no keyword is longer than a quarter of that.
PIECE = 2048

#: An automaton of so many states at most has a row of 256 next states for each, 16 MB: a step is one look-up.
DENSE = 1 << 14

_ODD = np.uint64(0x9E3779B97F4A7C15)


class Automaton(NamedTuple):
    edges: np.ndarray  # open-addressed: state * 256 + byte, or -1
    children: np.ndarray  # state that an edge leads to
    root: np.ndarray  # by byte: state after it from the root
    fail: np.ndarray  # by state: the longest proper suffix that is a state
    ends: np.ndarray  # by state: number of the keyword that ends there, or -1
    out: np.ndarray  # by state: itself or the nearest one along failure links at which a keyword ends, or 0
    longest: int
    dense: np.ndarray  # by state and byte: the next state, for few states (else no rows)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in self if isinstance(x, np.ndarray))


def _child(edges: np.ndarray, children: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the edges lead, -1 where there is none."""
    mask = len(edges) - 1
    at = (wanted.astype(np.uint64) * _ODD >> np.uint64(32)).astype(np.int64) & mask
    found = edges[at]
    out = np.where(found == wanted, children[at], -1).astype(np.int64)
    open_ = np.flatnonzero((found != wanted) & (found >= 0))
    while len(open_):
        at[open_] = (at[open_] + 1) & mask
        found = edges[at[open_]]
        hit = found == wanted[open_]
        out[open_[hit]] = children[at[open_[hit]]]
        open_ = open_[~hit & (found >= 0)]
    return out


def _step(a: Automaton, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """States (none of them the root) after one more byte each."""
    out = np.empty_like(state)
    open_ = np.arange(len(state))
    while len(open_):
        to = _child(a.edges, a.children, (state << 8) + byte)
        out[open_] = to
        lost = np.flatnonzero(to < 0)
        back, byte, open_ = a.fail[state[lost]].astype(np.int64), byte[lost], open_[lost]
        top = back == 0
        out[open_[top]] = a.root[byte[top]]
        state, byte, open_ = back[~top], byte[~top], open_[~top]
    return out


def build(keywords: Sequence[bytes]) -> Automaton:
    """The automaton of different, non-empty keywords; their numbers are their places in the sequence."""
    order = sorted(range(len(keywords)), key=keywords.__getitem__)
    words = [keywords[i] for i in order]
    lengths = np.array([len(w) for w in words], np.int64)
    flat, starts = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.append(0, np.cumsum(lengths))[:-1]
    longest, states = int(lengths.max(initial=0)), 1
    at = np.zeros(len(words), np.int64)  # state of each word after the bytes so far
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # parent, byte, child
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(longest):
        some = np.flatnonzero(lengths > d)  # words are sorted, so those of one state stand together
        edge = (at[some] << 8) + flat[starts[some] + d]
        new = np.append(True, edge[1:] != edge[:-1])
        number = states + np.cumsum(new) - 1
        levels.append((at[some][new], edge[new] & 255, number[new]))
        at[some], states = number, int(number[-1]) + 1
        done = some[lengths[some] == d + 1]
        ends.append((at[done], done))

    size = 1 << max(4, (2 * states).bit_length())
    edges, children = np.full(size, -1, np.int64), np.zeros(size, np.int32)
    for parent, byte, child in levels:
        key = (parent << 8) + byte
        slot = (key.astype(np.uint64) * _ODD >> np.uint64(32)).astype(np.int64) & (size - 1)
        left = np.arange(len(key))
        while len(left):  # of those that want a free slot one gets it, the others go on
            free = left[edges[slot[left]] < 0]
            edges[slot[free]] = key[free]
            got = free[edges[slot[free]] == key[free]]
            children[slot[got]] = child[got]
            left = np.setdiff1d(left, got, assume_unique=True)
            slot[left] = (slot[left] + 1) & (size - 1)
    root = np.zeros(256, np.int64)
    fail, out, word = np.zeros(states, np.int32), np.zeros(states, np.int32), np.full(states, -1, np.int32)
    for state, done in ends:
        word[state] = np.array(order)[done]
    if levels:
        root[levels[0][1]] = levels[0][2]
    dense = np.zeros((states if states <= DENSE else 0, 256), np.int32)
    if len(dense):
        dense[0] = root
    a = Automaton(edges, children, root, fail, word, out, longest, dense)
    for d, (parent, byte, child) in enumerate(levels):
        if d:
            back = fail[parent].astype(np.int64)
            top = back == 0
            fail[child[top]] = root[byte[top]]
            fail[child[~top]] = _step(a, back[~top], byte[~top])
        out[child] = np.where(word[child] >= 0, child, out[fail[child]])
        if len(dense):  # as from where the failure link leads, but for a state's own edges
            dense[child] = dense[fail[child]]
            if d + 1 < longest:
                dense[levels[d + 1][0], levels[d + 1][1]] = levels[d + 1][2]
    return a


def _pieces(offsets: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and length of the pieces, longest first; a piece begins with the end of the one before."""
    size = max(PIECE, 4 * longest)
    lengths = np.diff(offsets)
    n = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.maximum(k * size - (longest - 1), 0)
    end = np.minimum((k + 1) * size, lengths[text])
    order = np.argsort(begin - end, kind="stable")
    return text[order], (offsets[:-1][text] + begin)[order], (end - begin)[order]


def found(a: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and keyword numbers of all pairs of a text (data between offsets) and a keyword in it, each once."""
    text, start, length = _pieces(offsets, a.longest)
    state = np.zeros(len(text), np.int64)
    hits: list[np.ndarray] = []
    held, states = 0, len(a.fail)

    def merged() -> np.ndarray:
        return np.unique(np.concatenate(hits)) if hits else np.empty(0, np.int64)

    for i in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -i, "left"))  # pieces with a byte at i
        byte = data[start[:live] + i]
        if len(a.dense):
            now = a.dense[state[:live], byte]
        else:
            now = a.root[byte]
            deep = np.flatnonzero(state[:live])
            if len(deep):
                now[deep] = _step(a, state[deep], byte[deep].astype(np.int64))
        state[:live] = now
        end = a.out[now]
        hit = np.flatnonzero(end)
        if len(hit):
            hits.append(text[hit] * states + end[hit])
            held += len(hit)
            if held > 1 << 21:
                hits = [merged()]
                held = len(hits[0])
    pairs = merged()
    texts, ends, every = pairs // states, pairs % states, []
    while len(ends):  # shorter keywords that end at the same place
        every.append(texts * len(a.ends) + a.ends[ends])
        more = a.out[a.fail[ends]].astype(np.int64)
        texts, ends = texts[more > 0], more[more > 0]
        pairs = np.unique(texts * states + ends)
        texts, ends = pairs // states, pairs % states
    both = np.unique(np.concatenate(every)) if every else np.empty(0, np.int64)
    return both // len(a.ends), both % len(a.ends)


def _matched(part):
    """Rows (key, t) against a broadcast (automaton, keywords, numbers): key, keyword, seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, words, numbers = part.value
        words, numbers = pa.array(words, pa.string()), pa.array(numbers, pa.int64())
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column("t").cast(pa.large_binary())
            _, where, raw = texts.buffers()
            offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            text, word = found(a, np.frombuffer(raw, np.uint8) if raw else np.empty(0, np.uint8), offsets)
            for i in range(0, len(text), 1 << 16):
                some = pa.array(word[i : i + (1 << 16)])
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(text[i : i + (1 << 16)])), words.take(some), numbers.take(some)], names=["key", "keyword", "seq"])

    return run


def contained(texts: DataFrame, key: Column, text: Column, keywords: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """key, keyword, seq: each keyword (keyword, seq; the least seq if it comes twice) that a row's text contains.

    Null and empty keywords are in no text, null and empty texts have none. A row gives each keyword once; rows with
    one key give their own pairs. Keywords without seq have null there."""
    spark = texts.sparkSession
    rows = texts.select(key.alias("key"), text.alias("t")).filter(F.length("t") > 0)
    words = keywords.filter(F.length("keyword") > 0).groupBy("keyword").agg(F.min("seq").cast("long").alias("seq"))
    size = words.agg(F.sum(F.octet_length("keyword"))).first()[0] or 0
    parts = -(-size // part_bytes)
    out = None
    for k in range(parts):
        some = words.filter(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == k).collect()  # about part_bytes bytes, whatever the dictionary's size
        if not some:
            continue
        automaton = build([r["keyword"].encode() for r in some])
        part = spark.sparkContext.broadcast((automaton, [r["keyword"] for r in some], [r["seq"] for r in some]))
        kind = rows.schema["key"].dataType.simpleString()
        met = rows.mapInArrow(_matched(part), f"key {kind}, keyword string, seq long")
        out = met if out is None else out.union(met)
    return out if out is not None else rows.limit(0).select("key", F.lit(None).cast("string").alias("keyword"), F.lit(None).cast("long").alias("seq"))
