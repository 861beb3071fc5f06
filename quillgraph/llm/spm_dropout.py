"""SentencePiece encoding with seeded merge-dropout, and its lossless decoding.

A merge-type (BPE) model is applied by an agenda: the adjacent pair with the best score is merged first, the leftmost on
ties. With dropout p each candidate merge that leaves the agenda is skipped when its draw falls under p; draws are
hash bytes keyed by (seed, key, text, copy, chunk's place, candidate), p in 256ths, so each use of a word is drawn anew, reruns agree, and p = 0 is the
model's own encoding, which is also the result of all draws that skip nothing. What the draws skip decides a chunk's
segmentation, so a worker process keeps it for each (chunk, draws that were made) once it is known; draws, look-ups and the
joining of ids are array operations over all chunks of a batch.

No piece holds a space after another character, and characters that are in no longer piece never merge, so a text is
cut there into chunks that are encoded independently. Characters without a piece are written as byte pieces, also a
literal U+2581, which the usual decoder would turn into a space.

Scale: row-local, no shuffle, one model (a few hundred kB) sent to each task, memory bounded by CACHE and PLAIN entries and by one
batch of texts.

Defined cases: null and empty texts have no pieces (null ids decode to null); texts of any length are encoded whole;
equal rows have equal ids unless a column numbers their copies; other columns are carried; a column of the output's name
is replaced. Every row's ids are decoded and compared with its text; a difference is an error.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Draws of a chunk that are made at once; the others as they are needed.
DRAWS = 16
#: Segmentations with skips that a worker keeps, and chunks with their encodings without dropout.
CACHE, PLAIN = 200_000, 120_000
#: Chunks of up to so many characters keep their agenda in a list, and their segmentations; characters of longer ones that are kept.
SHORT, HELD = 48, 1 << 22
_ALL, _NONE, _FREE = (1 << 64) - 1, 1 << 60, 1 << 30
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Rows of a batch that leaves Python.
CHUNK = 128
DROPOUT, SEED = 0.1, 5


class Pieces:
    """What is needed of a model file: ids and scores of its ordinary pieces, and the 256 byte pieces."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        with open(path, "rb") as f:
            self.model = f.read()
        m = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        self.ids: dict[str, tuple[int, float]] = {}
        self.byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [b""] * m.get_piece_size()
        for i in range(m.get_piece_size()):
            if m.is_byte(i):
                self.raw[i] = bytes([int(m.id_to_piece(i)[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                piece = m.id_to_piece(i).replace("▁", " ")
                self.ids[piece] = i, m.get_score(i)
                self.raw[i] = piece.encode()
        self.raw_starts = np.cumsum([0, *map(len, self.raw)])
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        order = {x: n for n, x in enumerate(sorted({-score for _, score in self.ids.values()}))}
        self.costs = {p: order[-score] for p, (_, score) in self.ids.items() if len(p) > 1}
        self.numbers = {p: i for p, (i, _) in self.ids.items()}
        longer = [p for p in self.ids if len(p) > 1]
        if any(" " in p.lstrip(" ") for p in longer):
            raise ValueError("the model has pieces across spaces")
        alone = "".join(c for c in "\n\t\r|*#%&$!.,;:?" if not any(c in p for p in longer))
        if "\n" not in alone:
            raise ValueError("the model merges line ends")
        stop = re.escape(alone)
        self.chunks = re.compile(rf"[{stop}]| +[^ {stop}]*|[^ {stop}]+", re.S).findall


class Store:
    """Encodings by number, end to end in one growing array."""

    def __init__(self):
        self.ids, self.starts, self.n = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def extend(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Adds encodings that stand end to end in ids; the number of the first."""
        at, n, more = int(self.starts[self.n]), self.n, len(sizes)
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids) + len(ids), np.int32)])
        if n + more + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(len(self.starts) + more, np.int64)])
        self.ids[at : at + len(ids)] = ids
        self.starts[n + 1 : n + more + 1] = at + np.cumsum(sizes)
        self.n = n + more
        return n

    def add(self, ids: list[int]) -> int:
        return self.extend(np.array(ids, np.int32), np.array([len(ids)]))

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these encodings end to end, and how many each one has."""
        return _gathered(self.ids, self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers])


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


class Merges:
    """The candidate pairs of a model, and the agenda over many chunks at once.

    A symbol is the id of its piece, or `unknown` and the code point of a character without one. (left, right) -> (cost,
    merged) is an open-addressing table, so that a look-up is an array operation."""

    BITS = 18

    def __init__(self, pieces: Pieces):
        self.pieces, self.unknown = pieces, len(pieces.raw)
        self.symbols = np.arange(0x110000, dtype=np.int32) + np.int32(self.unknown)
        for piece, n in pieces.numbers.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = n
        number = lambda p: int(self.symbols[ord(p)]) if len(p) == 1 else pieces.numbers.get(p, -1)
        found = [(x, y, cost, pieces.numbers[p]) for p, cost in pieces.costs.items() for i in range(1, len(p)) if (x := number(p[:i])) >= 0 and (y := number(p[i:])) >= 0]
        size = 1 << max(self.BITS, (2 * len(found)).bit_length())
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.keys, self.cost, self.merged = np.full(size, -1, np.int64), np.full(size, _FREE, np.int32), np.zeros(size, np.int32)
        rows = np.array(found, np.int64).reshape(-1, 4)
        keys = rows[:, 0] << 21 | rows[:, 1]
        for slot, key, cost, merged in zip(self._slot(keys).tolist(), keys.tolist(), rows[:, 2].tolist(), rows[:, 3].tolist()):
            while self.keys[slot] >= 0:
                slot = slot + 1 & self.mask
            self.keys[slot], self.cost[slot], self.merged[slot] = key, cost, merged

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _GOLDEN >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(costs, merged symbols) of pairs; _FREE where they are none."""
        keys = left << 21 | right
        slots = self._slot(keys)
        at = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] >= 0))
        while len(at):
            slots[at] = slots[at] + 1 & self.mask
            at = at[(self.keys[slots[at]] != keys[at]) & (self.keys[slots[at]] >= 0)]
        return self.cost[slots], self.merged[slots]  # an empty slot costs _FREE

    def segment(self, chunks: list[str], skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, sizes, draws made) with these skips, a bit for each of the first DRAWS draws. Chunks that would make
        more have 1 + DRAWS draws and no ids that count."""
        rows, lengths = len(chunks), np.array(list(map(len, chunks)), np.int64)
        width = int(lengths.max()) + 1
        flat = np.zeros((rows, width), np.int64)
        held = np.arange(width) < lengths[:, None]
        flat[held] = self.symbols[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")]
        costs, into = self.find(flat[:, :-1].ravel(), flat[:, 1:].ravel())
        agenda, to = np.full((rows, width), _FREE, np.int32), np.zeros((rows, width), np.int32)
        agenda[:, :-1] = np.where(held[:, 1:], costs.reshape(rows, -1), _FREE)
        to[:, :-1] = into.reshape(rows, -1)
        after = np.tile(np.arange(1, width + 1), (rows, 1)).ravel()  # places of the next and the last symbol of each
        before = np.tile(np.arange(-1, width - 1), (rows, 1)).ravel()
        symbol, cost, into, alive = flat.ravel(), agenda.ravel(), to.ravel(), held.ravel()
        made, active = np.zeros(rows, np.int64), np.arange(rows)
        while len(active):
            best = agenda[active].argmin(axis=1)  # the leftmost on ties
            at = active * width + best
            going = cost[at] != _FREE
            active, at, best = active[going], at[going], best[going]
            made[active] += 1
            within = made[active] <= DRAWS
            active, at, best = active[within], at[within], best[within]
            skipped = skips[active] >> made[active] - 1 & 1 == 1
            cost[at[skipped]] = _FREE
            row, i, at = active[~skipped] * width, best[~skipped], at[~skipped]
            gone = after[at]
            nxt = after[row + gone]
            symbol[at], after[at] = into[at], nxt
            alive[row + gone], cost[row + gone] = False, _FREE
            right = nxt < width  # the last column holds nothing, so a neighbour is there only if it is alive
            before[row[right] + nxt[right]] = i[right]
            some = right & alive[row + np.minimum(nxt, width - 1)]
            cost[at] = _FREE
            cost[at[some]], into[at[some]] = self.find(symbol[at[some]], symbol[row[some] + nxt[some]])
            left = before[at] >= 0
            there = row[left] + before[at[left]]
            cost[there], into[there] = self.find(symbol[there], symbol[at[left]])
        sizes, ids = alive.reshape(rows, width).sum(axis=1), symbol[alive]
        if (ids >= self.unknown).any():
            each = np.split(ids, np.cumsum(sizes)[:-1])
            out = [[n for x in e.tolist() for n in ([x] if x < self.unknown else [self.pieces.byte_ids[b] for b in chr(x - self.unknown).encode()])] for e in each]
            ids, sizes = np.array(list(chain.from_iterable(out)), np.int64), np.array(list(map(len, out)))
        return ids.astype(np.int32), sizes, made


class Encoder:
    """Applies the agenda to the chunks of many texts at once.

    A chunk has a number, and so has each of its segmentations. What a segmentation depends on is the draws of the
    candidates that left its agenda, so it is found by (chunk, first so many draws); where these are too few for some other
    outcome of them, the entry tells how many to look at instead."""

    def __init__(self, pieces: Pieces, dropout: float = DROPOUT, seed: int = SEED):
        self.pieces, self.limit, self.seed = pieces, round(dropout * 256), seed
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=pieces.model)
        self.line_end = pieces.byte_ids[10]
        self.merging = Merges(pieces)
        self.first_piece = max(pieces.byte_ids) + 1 if pieces.byte_ids == sorted(pieces.byte_ids) else 1 << 30
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.names: list[str] = []
        self.plain, self.merges = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.known: dict[int, int] = {}
        self.store, self.held = Store(), 0

    def _skips(self, bases: np.ndarray, places: np.ndarray) -> np.ndarray:
        """For each use of a chunk which of its first DRAWS candidates are skipped, a bit each."""
        x = bases[:, None] + (places[:, None] * np.uint64(2) + np.array([1, 2], np.uint64)) * _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        draws = (x ^ (x >> np.uint64(31))).astype("<u8").view(np.uint8)
        return np.packbits((draws < self.limit).ravel(), bitorder="little").view("<u2").astype(np.int64)

    def _learn(self, chunks: list[str]) -> None:
        """Numbers for new chunks, with their encodings without dropout: by the library for short chunks of ordinary
        pieces, as lines of one text, since line ends never merge."""

        def learn(some: list[str], ids: np.ndarray, sizes: np.ndarray, merges) -> None:
            n, end = len(self.names), len(self.names) + len(some)
            while end > len(self.plain):
                self.plain, self.merges = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.plain, self.merges))
            self.numbers.update(zip(some, range(n, end)))
            self.names += some
            self.plain[n:end] = self.store.extend(ids, sizes) + np.arange(len(some))
            self.merges[n:end] = merges

        easy = [c for c in chunks if len(c) <= SHORT and "▁" not in c and c != "\n"]
        for at in range(0, len(easy), 4096):
            some = easy[at : at + 4096]
            ids = np.array(self.library.encode("\n" + "\n".join(some)), np.int32)
            ends = np.append(np.flatnonzero(ids == self.line_end), len(ids))
            odd = np.unique(np.searchsorted(ends[1:], np.flatnonzero((ids < self.first_piece) & (ids != self.line_end)), "right"))
            good = np.ones(len(some), bool)
            good[odd] = False
            sizes = np.diff(ends) - 1
            chunk = np.searchsorted(ends, np.arange(len(ids)), "right") - 1
            own = (chunk >= 0) & good[chunk] & (ids != self.line_end)
            kept = [c for c, g in zip(some, good.tolist()) if g]
            learn(kept, ids[own], sizes[good], np.array(list(map(len, kept)), np.int64) - sizes[good])
        for c in chunks:
            if c not in self.numbers:
                parts, _ = (self._long if len(c) > SHORT else self._short)(c)
                ids = self._ids(parts)
                learn([c], np.array(ids, np.int32), np.array([len(ids)]), len(c) - len(parts))
                self.held += len(c) if len(c) > SHORT else 0

    def _ids(self, parts: list[str]) -> list[int]:
        out = list(map(self.pieces.numbers.get, parts))
        if None in out:
            out = [n for piece, x in zip(parts, out) for n in ([x] if x is not None else [self.pieces.byte_ids[b] for b in piece.encode()])]
        return out

    def _short(self, chunk: str, skips: int = 0, late=None) -> tuple[list[str], int]:
        """(pieces, draws made) by an agenda as a list that is searched for its best entry each time. skips: the first draws'
        outcome, a bit each; late: gives the draw of a candidate beyond them."""
        get, k = self.pieces.costs.get, 0
        parts = list(chunk)
        agenda = list(map(get, map(add, parts, parts[1:]), repeat(_NONE)))
        while agenda:
            best = min(agenda)
            if best == _NONE:
                break
            i = agenda.index(best)  # the leftmost on ties
            k += 1
            if skips >> k - 1 & 1 if k <= DRAWS else late is not None and late(k - 1):
                agenda[i] = _NONE
                continue
            made = parts[i] + parts.pop(i + 1)
            parts[i] = made
            del agenda[i]
            if i:
                agenda[i - 1] = get(parts[i - 1] + made, _NONE)
            if i < len(agenda):
                agenda[i] = get(made + parts[i + 1], _NONE)
        return parts, k

    def _long(self, chunk: str, skips: int = 0, late=None) -> tuple[list[str], int]:
        """The same with a heap over linked symbols, for chunks of any length."""
        costs, n, k = self.pieces.costs, len(chunk), 0
        before, after, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n and (cost := costs.get(chunk[left : end[right]], _NONE)) != _NONE:
                heapq.heappush(agenda, (cost, left, end[right]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, left, stop = heapq.heappop(agenda)
            right = after[left]
            if end[left] == 0 or right >= n or end[right] != stop:
                continue  # one of the two has been merged since
            k += 1
            if skips >> k - 1 & 1 if k <= DRAWS else late is not None and late(k - 1):
                continue
            end[left], end[right] = stop, 0
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                offer(left)
            if before[left] >= 0:
                offer(before[left])
        parts, i = [], 0
        while i < n:
            parts.append(chunk[i : end[i]])
            i = end[i]
        return parts, k

    def _late(self, base: int, place: int):
        """Draws after the first DRAWS of one use, sixteen at a time."""
        held: dict[int, bytes] = {}

        def skipped(k: int) -> bool:
            if k // 16 not in held:
                held[k // 16] = xxhash.xxh3_128_digest((k // 16).to_bytes(8, "little") + place.to_bytes(8, "little"), seed=base)
            return held[k // 16][k % 16] < self.limit

        return skipped

    def _fresh(self, numbers: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(draws made, number of the encoding) of chunks with skips, chunks of like lengths together."""
        made, out = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        names = [self.names[n] for n in numbers.tolist()]
        lengths = np.array(list(map(len, names)))
        for low, high in ((0, 6), (6, 10), (10, 16), (16, SHORT)):
            these = np.flatnonzero((lengths > low) & (lengths <= high))
            if len(these):
                ids, sizes, made[these] = self.merging.segment([names[i] for i in these.tolist()], skips[these])
                out[these] = self.store.extend(ids, sizes) + np.arange(len(these))
        return made, out

    def _segmented(self, numbers: np.ndarray, skips: np.ndarray, bases: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The encoding's number for each use of a short chunk that has skips, or -1 where draws after the first DRAWS count."""
        known = self.known
        out = np.full(len(numbers), -1, np.int64)
        level, todo = np.clip(self.merges[numbers], 1, DRAWS), np.arange(len(numbers))
        while len(todo):
            n = level[todo]
            keys, first, which = np.unique(numbers[todo] << 21 | n << 16 | skips[todo] & (1 << n) - 1, return_index=True, return_inverse=True)
            found = list(map(known.get, keys.tolist()))
            if None in found:
                missing = np.array([j for j, f in enumerate(found) if f is None])
                use, depth = todo[first[missing]], n[first[missing]]
                made, numbered = self._fresh(numbers[use], skips[use])
                value = np.where(made <= depth, numbered, -made)
                known.update(zip(keys[missing].tolist(), value.tolist()))
                more = np.flatnonzero((made > depth) & (made <= DRAWS))
                known.update(zip((numbers[use[more]] << 21 | made[more] << 16 | skips[use[more]] & (1 << made[more]) - 1).tolist(), numbered[more].tolist()))
                for j, v in zip(missing.tolist(), value.tolist()):
                    found[j] = v
            got = np.array(found, np.int64)[which]
            out[todo] = np.maximum(got, -1)
            level[todo] = -got
            todo = todo[(got < 0) & (got >= -DRAWS)]
        return out

    def encode_batch(self, texts: list[str | None], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each text has). keys: of the texts' rows and copies."""
        if len(self.names) > PLAIN or len(self.known) > CACHE or self.held > HELD:
            self._forget()
        split, get = self.pieces.chunks, self.numbers.get
        cut = [split(" " + t) if t else [] for t in texts]
        chunks = list(chain.from_iterable(cut))
        found = list(map(get, chunks))
        if None in found:
            missing = [i for i, n in enumerate(found) if n is None]
            fresh = [chunks[i] for i in missing]
            self._learn(list(dict.fromkeys(fresh)))
            for i, n in zip(missing, map(get, fresh)):
                found[i] = n
        numbers, counts = np.array(found, np.int64), np.array([len(c) for c in cut], np.int64)
        used, before = self.plain[numbers], self.store.n
        if self.limit and len(numbers):
            own = np.array([xxhash.xxh3_64_intdigest((k & _ALL).to_bytes(8, "little"), seed=self.seed & _ALL) for k in keys], np.uint64)
            bases, places = np.repeat(own, counts), (np.arange(len(numbers)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
            skips, merges = self._skips(bases, places), self.merges[numbers]
            some = np.flatnonzero((skips & (1 << np.minimum(merges, DRAWS)) - 1 != 0) | (merges > DRAWS))
            long = np.array([len(self.names[n]) > SHORT for n in numbers[some].tolist()], bool)
            short = some[~long]
            used[short] = self._segmented(numbers[short], skips[short], bases[short], places[short])
            before = self.store.n
            for u in [*some[long].tolist(), *short[used[short] < 0].tolist()]:
                chunk = self.names[numbers[u]]
                parts, _ = (self._long if len(chunk) > SHORT else self._short)(chunk, int(skips[u]), self._late(int(bases[u]), int(places[u])))
                used[u] = self.store.add(self._ids(parts))
        ids, sizes = self.store.joined(used)
        self.store.n = before  # segmentations of one use are not kept
        total = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        return ids, total[ends] - total[ends - counts]

    def encode_all(self, texts: list[str | None], keys: list[int]) -> list[bytes]:
        """The ids of each text, packed as int32."""
        ids, sizes = self.encode_batch(texts, keys)
        return [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])]

    def encode(self, text: str | None, key: int = 0) -> bytes:
        """The ids of a text, packed as int32. key: of the text's row and copy."""
        return self.encode_all([text], [key])[0]


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(pieces: Pieces, dropout: float, seed: int) -> Encoder:
    """One encoder a worker process: what it knows serves the worker's next tasks too."""
    key = xxhash.xxh3_128_digest(pieces.model), dropout, seed
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(pieces, dropout, seed)
    return _ENCODERS[key]


def decode(pieces: Pieces, ids) -> str:
    return b"".join(map(pieces.raw.__getitem__, ids))[1:].decode("utf-8")


def _checked(pieces: Pieces, texts: list[str | None], ids: np.ndarray, sizes: np.ndarray) -> None:
    """Decodes the ids of all texts and compares."""
    back, lengths = _gathered(pieces.raw_bytes, pieces.raw_starts[ids], pieces.raw_starts[ids + 1] - pieces.raw_starts[ids])
    wanted = [b" " + t.encode() if t else b"" for t in texts]
    if back.tobytes() != b"".join(wanted):
        raise ValueError("ids do not decode to their texts")
    total, ends = np.concatenate([[0], np.cumsum(lengths)]), np.cumsum(sizes)
    if (total[ends] - total[ends - sizes]).tolist() != list(map(len, wanted)):
        raise ValueError("ids of one text decode to a part of another")


def encode_column(df: DataFrame, text: str = "text", key: str = "doc_id", out: str = "ids", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, copy: str | None = None) -> DataFrame:
    """df with the ids of its texts, array<int>. copy: a column that numbers rows with one key and text, so that they differ."""
    whole_texts(df.sparkSession)
    pieces = Pieces(model)
    rows = df.drop(out).withColumn("__key", F.xxhash64(F.col(key), F.col(text), F.col(copy) if copy else F.lit(1), F.lit(seed)))
    schema = T.StructType([*(f for f in rows.schema if f.name != "__key"), T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(pieces, dropout, seed)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                texts = b.column(text).to_pylist()
                ids, sizes = encoder.encode_batch(texts, b.column("__key").to_pylist())
                _checked(pieces, texts, ids, sizes)
                offsets = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
                kept = b.drop_columns(["__key"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.ListArray.from_arrays(offsets, pa.array(ids))], names=[*kept.schema.names, out])
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def decode_column(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """df with the texts of its ids."""
    pieces = Pieces(model)
    schema = T.StructType([*(f for f in df.drop(out).schema), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                texts = [None if x is None else decode(pieces, x) for x in b.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return df.drop(out).mapInArrow(run, schema)


def segmented(df: DataFrame, text: str = "text", key: str = "doc_id", out: str = "ids", **how) -> DataFrame:
    """df with ids and n_ids."""
    return encode_column(df, text, key, out, **how).withColumn(f"n_{out}", F.size(out).cast("long"))
