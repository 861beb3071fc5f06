"""Language-model scores: an interpolated modified Kneser-Ney model of word pairs, counted in Spark, mapped into memory by workers.

Tokens are the words of a text with A-Z in lower case, then one end. Before the first token stands a begin mark.

p(w | v) = max(c(v w) - D(c(v w)), 0) / c(v .) + g(v) q(w), with g(v) = (D1 N1(v .) + D2 N2(v .) + D3 N3+(v .)) / c(v .)
q(w) = max(u(w) - E(u(w)), 0) / u(.) + g0 / (V + 1), u(w) = number of words that w follows

D and E are the three discounts of modified Kneser-Ney from the numbers of pairs (words) that occur once to four times; k / 2
where those do not define one between 0 and k. Unknown words share the last term; after a word that is never followed p = q.

The model is four kinds of sorted arrays in the shared checkpoint folder: hashes of words with counts (a word's rank is its number),
pairs of numbers as one 64-bit key with counts, and by number the sums and weights of contexts. They are cut into as many files as
a shuffle has partitions. A worker maps the files into memory and finds what a batch of texts needs by binary search,
in order, so pages are read as they are needed and shared by the workers of a machine; nothing is broadcast. Tasks write files under
another name and rename them, so a task that runs again leaves the same files.

Scale: words and pairs are counted inside a task first (bounded tables), then shuffled as numbers by hash of the pair, so a frequent word's
pairs spread over all files; what contexts and words need is summed in the task that writes the pairs and shuffled once,
some rows a word. The driver sees numbers of entries a file and the counts of counts. No pair is pruned. A model of longer n-grams
would need the pairs' keys as numbers again; the README has its measured size.

Limits: keys are exact up to 2^32 - 1 different words, beyond that 64-bit hashes of pairs; words are 64-bit hashes. The
checkpoint folder must be on a file system that executors mount (file:), as files are mapped.

Defined cases: null text is empty text, one end; a null id counts as '' for the split, which holds it out; no training
rows give equal probabilities; rows are scored one by one, so repeated rows get equal scores and very long texts are scored whole;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, checkpoint_dir, stored, tidy

#: Tokens that are handled as arrays at once, and entries of a task's counting table before it is handed on.
PIECE, TALLY = 150_000, 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def token_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, tokens (hashes, the end last; no word is a line feed)."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    return docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.concat(F.transform(words, lambda x: F.xxhash64(x)), F.array(F.xxhash64(F.lit("\n")))).alias("tokens"))


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows in pieces of about `size` tokens; a row is never cut."""
    for b in batches:
        at, ends = 0, np.cumsum(b.column("tokens").value_lengths().to_numpy(zero_copy_only=False))
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
            yield b.slice(at, to - at)
            at = to


def _flat(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a piece, and where its rows start."""
    lists = piece.column("tokens")
    return lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))[:-1]


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_keys(v: np.ndarray, w: np.ndarray, words: int) -> np.ndarray:
    """One signed 64-bit key for each pair of numbers up to `words`."""
    v, w = v.astype(np.uint64), w.astype(np.uint64)
    return ((v << np.uint64(32)) | w if words < 1 << 32 else _scrambled(_scrambled(v) + w)).view(np.int64)


def _place(hashes: np.ndarray, files: int) -> np.ndarray:
    """File of each (well spread, signed) hash; files are ranges of hashes."""
    high = (hashes >> 32) + (1 << 31)
    return high * files >> 32


def _pair_place(keys: np.ndarray, files: int) -> np.ndarray:
    return _place(_scrambled(keys.view(np.uint64)).view(np.int64), files)


def _give_back() -> None:
    """At the end of a task: what Arrow and malloc hold but do not use goes back to the system, as idle workers stay."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


class _Tally:
    """Counts by key, with columns that go with a key; handed on when the table has `most` entries after merging."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, key: np.ndarray, n: np.ndarray, *more: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        self.parts.append((key, n, *more))
        self.held += len(key)
        return self.flush(False) if self.held > 2 * self.most else []

    def flush(self, all_: bool = True) -> list[tuple[np.ndarray, ...]]:
        if not self.parts:
            return []
        key, n, *more = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        out = (key[starts], np.add.reduceat(n[order], starts) if len(key) else n, *(x[order[starts]] for x in more))
        self.parts, self.held = [], 0
        if all_ or len(out[0]) > self.most:
            return [out]
        self.parts, self.held = [out], len(out[0])
        return []


def _sent(names: list[str], place: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their files, so that what goes to one is alike."""
    order = np.argsort(place, kind="stable")
    for at in range(0, len(order), 1 << 17):
        some = order[at : at + (1 << 17)]
        yield pa.RecordBatch.from_arrays([pa.array(place[some].astype(np.int32)), *(pa.array(c[some].astype(np.int64)) for c in columns)], names=["file", *names])


def _words(files: int, piece: int, tally_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(tally_)
        for rows in _pieces(batches, piece):
            for key, n in tally.add(*np.unique(_flat(rows)[0], return_counts=True)):
                yield from _sent(["word", "n"], _place(key, files), key, n)
        for key, n in tally.flush():
            yield from _sent(["word", "n"], _place(key, files), key, n)
        _give_back()

    return run


class _Files:
    """Appends columns to raw array files of one folder; a file gets its name when it is whole."""

    def __init__(self, folder: str, kind: str, types: dict[str, str]) -> None:
        self.folder, self.kind, self.types, self.at, self.open, self.tag = folder, kind, types, None, {}, uuid.uuid4().hex

    def write(self, at: int, columns: dict[str, np.ndarray]) -> None:
        if at != self.at:
            self.close()
            self.at = at
            os.makedirs(self.folder, exist_ok=True)
            self.open = {c: open(f"{_file(self.folder, self.kind, at, c)}.{self.tag}", "wb") for c in self.types}
        for c, t in self.types.items():
            self.open[c].write(np.ascontiguousarray(columns[c], t).tobytes())

    def close(self) -> None:
        for c, f in self.open.items():
            f.flush()
            os.fsync(f.fileno())
            f.close()
            os.replace(f.name, _file(self.folder, self.kind, self.at, c))
        self.open = {}


def _file(folder: str, kind: str, at: int, column: str) -> str:
    return f"{folder}/{kind}-{at:06d}.{column}"


def _runs(b: pa.RecordBatch) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The batch's columns, file by file."""
    columns = {c: b.column(c).to_numpy() for c in b.schema.names}
    at = columns["file"]
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else []
    for i, j in zip(starts, [*starts[1:], len(at)]):
        yield int(at[i]), {c: x[i:j] for c, x in columns.items()}


def _write_words(folder: str):
    """file, entries, tokens of each file of words that the task writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = _Files(folder, "words", {"hash": "<i8", "n": "<u8"}), {}
        for b in batches:
            for at, x in _runs(b):
                out.write(at, {"hash": x["word"], "n": x["n"]})
                entries, tokens = done.get(at, (0, 0))
                done[at] = entries + len(x["word"]), tokens + int(x["n"].sum())
        out.close()
        _give_back()
        yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.int32()), *(pa.array([v[i] for v in done.values()], pa.int64()) for i in (0, 1))], names=["file", "entries", "tokens"])

    return run


class Model(NamedTuple):
    """What a worker needs to map the model; the arrays are in the folder."""

    folder: str
    files: int
    firsts: tuple[int, ...]  # number of the first word of each file of words, then the number of words
    tokens: int
    block: int = 1  # words of a file of contexts
    pair_type: str = "<u4"
    pair_discounts: tuple[float, ...] = (0.5, 1.0, 1.5)
    word_discounts: tuple[float, ...] = (0.5, 1.0, 1.5)
    kinds: int = 0  # different pairs
    spread: float = 1.0  # g0

    @property
    def words(self) -> int:
        return self.firsts[-1]

    @property
    def begin(self) -> int:
        return self.firsts[-1]


class Mapped:
    """Look-ups in the mapped arrays of a model; a task maps each file once, when it first needs it."""

    def __init__(self, model: Model) -> None:
        self.model, self.open = model, {}
        self.firsts = np.array(model.firsts)

    def array(self, kind: str, at: int, column: str, dtype: str) -> np.ndarray:
        if (kind, at, column) not in self.open:
            path = _file(self.model.folder, kind, at, column)
            self.open[kind, at, column] = np.memmap(path, dtype, "r") if os.path.exists(path) and os.path.getsize(path) else np.empty(0, dtype)
        return self.open[kind, at, column]

    def _found(self, kind: str, key: str, places: np.ndarray, wanted: np.ndarray, value: str, dtype: str) -> tuple[np.ndarray, np.ndarray]:
        """Index in its file (-1: none) and value (0) of each wanted key; places ascend."""
        index, values = np.full(len(wanted), -1), np.zeros(len(wanted), np.int64)
        starts = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else []
        for i, j in zip(starts, [*starts[1:], len(places)]):
            keys = self.array(kind, int(places[i]), key, "<i8")
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted[i:j]), len(keys) - 1)
                hit = keys[at] == wanted[i:j]
                index[i:j] = np.where(hit, at, -1)
                values[i:j] = np.where(hit, self.array(kind, int(places[i]), value, dtype)[at], 0)
        return index, values

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of ascending hashes."""
        places = _place(hashes, self.model.files)
        index, n = self._found("words", "hash", places, hashes, "n", "<u8")
        return np.where(index < 0, -1, index + self.firsts[places]), n

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys."""
        places = _pair_place(keys, self.model.files)
        order = np.lexsort((keys, places))
        out = np.empty(len(keys), np.int64)
        out[order] = self._found("pairs", "key", places[order], keys[order], "n", self.model.pair_type)[1]
        return out

    def of(self, numbers: np.ndarray, column: str, dtype: str) -> np.ndarray:
        """A column of contexts for ascending numbers."""
        places = numbers // self.model.block
        out = np.zeros(len(numbers), dtype)
        starts = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else []
        for i, j in zip(starts, [*starts[1:], len(places)]):
            out[i:j] = self.array("contexts", int(places[i]), column, dtype)[numbers[i:j] - places[i] * self.model.block]
        return out


def _numbers(maps: Mapped, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the tokens, of what stands before each, and counts of the tokens."""
    hashes, back = np.unique(tokens, return_inverse=True)
    number, n = maps.words(hashes)
    w = number[back]
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[starts] = maps.model.begin
    return v, w, n[back]


def _pairs(model: Model, piece: int, tally_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, tally = Mapped(model), _Tally(tally_)
        exact = model.words < 1 << 32  # a key is its two numbers

        def sent(key: np.ndarray, n: np.ndarray, *pair: np.ndarray) -> Iterator[pa.RecordBatch]:
            v, w = pair or (key >> 32 & 0xFFFFFFFF, key & 0xFFFFFFFF)
            return _sent(["v", "w", "n"], _pair_place(key, model.files), v, w, n)

        for rows in _pieces(batches, piece):
            v, w, _ = _numbers(maps, *_flat(rows))
            keys = pair_keys(v, w, model.words)
            if exact:
                made = tally.add(*np.unique(keys, return_counts=True))
            else:
                key, first, n = np.unique(keys, return_index=True, return_counts=True)
                made = tally.add(key, n, v[first], w[first])
            for x in made:
                yield from sent(*x)
        for x in tally.flush():
            yield from sent(*x)
        _give_back()

    return run


def _keyed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, w = (b.column(c).to_numpy() for c in "vw")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pair_keys(v, w, words))], names=[*b.schema.names, "key"])

    return run


_PARTS = ["number", "total", "n1", "n2", "n3", "follows"]


def _write_pairs(model: Model, tally_: int):
    """Writes pairs; returns what contexts and words get from them, by number, and under numbers -1 to -4 how many occur
    once to four times."""
    kind = np.dtype(model.pair_type)

    def rows(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=_PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, after, common = _Files(model.folder, "pairs", {"key": "<i8", "n": model.pair_type}), _Tally(tally_), np.zeros(5, np.int64)

        def ends(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            for w, n in found:
                none = np.zeros(len(w))
                yield rows(w, none, none, none, none, n)

        for b in batches:
            if not b.num_rows:
                continue
            for at, x in _runs(b):
                assert x["n"].max() <= np.iinfo(kind).max
                out.write(at, x)
            v, w, n = (b.column(c).to_numpy() for c in ("v", "w", "n"))
            common += np.bincount(np.minimum(n, 5), minlength=6)[1:6]
            order = np.argsort(v, kind="stable")
            v, n = v[order], n[order]
            starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            some = lambda x: np.add.reduceat(x.astype(np.int64), starts)
            yield rows(v[starts], some(n), some(n == 1), some(n == 2), some(n >= 3), np.zeros(len(starts)))
            yield from ends(after.add(*np.unique(w, return_counts=True)))
        yield from ends(after.flush())
        out.close()
        _give_back()
        zero = np.zeros(4)
        yield rows(-np.arange(1, 5), common[:4], zero, zero, zero, zero)

    return run


def _write_contexts(model: Model):
    """Writes sums and weights of contexts; returns how many words follow one, two, three, four words, and of those all pairs."""
    d = model.pair_discounts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, common, pairs = _Files(model.folder, "contexts", {"total": "<u8", "back": "<f8", "follows": "<u8"}), np.zeros(5, np.int64), 0
        for b in batches:
            for at, x in _runs(b):
                weight = d[0] * x["n1"] + d[1] * x["n2"] + d[2] * x["n3"]
                out.write(at, {"total": x["total"], "back": np.divide(weight, x["total"], out=np.ones(len(weight)), where=x["total"] > 0), "follows": x["follows"]})
                common += np.bincount(np.minimum(x["follows"], 5), minlength=6)[1:6]
                pairs += int(x["follows"].sum())
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (*common[:4], pairs)], names=["n1", "n2", "n3", "n4", "pairs"])

    return run


def discounts(n: list[int]) -> tuple[float, ...]:
    """Modified Kneser-Ney discounts from how many occur once to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    made = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0 for k in (1, 2, 3)]
    return tuple(float(x) if 0 < x <= k else k / 2 for k, x in enumerate(made, 1))


def _folder(spark: SparkSession) -> str:
    checkpoint_dir(spark)
    url = urlparse(spark.sparkContext.getCheckpointDir())
    if url.scheme not in ("", "file"):
        raise RuntimeError("workers map the model into memory: spark.checkpoint.dir must be a mounted folder (file:)")
    return f"{url.path}/model-{uuid.uuid4().hex}"


def _in_files(rows: DataFrame, files: int, by: list[str], sums: list[str]) -> DataFrame:
    """Rows of one file in one task; sums over what several tasks have counted."""
    return rows.repartition(files, "file").groupBy("file", *by).agg(*[F.sum(c).alias(c) for c in sums])


def train(rows: DataFrame, piece: int = PIECE, tally: int = TALLY) -> Model:
    """The model of token_rows."""
    spark = rows.sparkSession
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder, lists = _folder(spark), rows.select("tokens")
    words = _in_files(lists.mapInArrow(_words(files, piece, tally), "file int, word long, n long"), files, ["word"], ["n"])
    done = {r["file"]: r for r in words.sortWithinPartitions("file", "word").mapInArrow(_write_words(folder), "file int, entries long, tokens long").collect()}
    sizes = [done[i]["entries"] if i in done else 0 for i in range(files)]
    tokens = sum(r["tokens"] for r in done.values())
    count = sum(sizes)
    model = Model(folder, files, tuple(int(x) for x in np.append(0, np.cumsum(sizes))), tokens, block=count // files + 1, pair_type="<u4" if tokens < 1 << 32 else "<u8")
    if not count:
        return model
    tidy(spark)
    pairs = _in_files(lists.mapInArrow(_pairs(model, piece, tally), "file int, v long, w long, n long"), files, ["v", "w"], ["n"])
    if count < 1 << 32:
        pairs = pairs.withColumn("key", F.shiftleft("v", 32).bitwiseOR(F.col("w")))  # as pair_keys
    else:
        pairs = pairs.mapInArrow(_keyed(count), "file int, v long, w long, n long, key long")
    parts = pairs.sortWithinPartitions("file", "key").mapInArrow(_write_pairs(model, tally), ", ".join(f"{c} long" for c in _PARTS))
    sums = stored(parts.groupBy("number").agg(*[F.sum(c).alias(c) for c in _PARTS[1:]]))
    tidy(spark)
    common = {r["number"]: r["total"] for r in sums.df.filter("number < 0").collect()}
    model = model._replace(pair_discounts=discounts([common.get(-k, 0) for k in (1, 2, 3, 4)]))
    contexts = sums.df.filter("number >= 0").withColumn("file", F.expr(f"cast(number div {model.block} as int)")).repartition(files, "file").sortWithinPartitions("file", "number")
    seen = contexts.mapInArrow(_write_contexts(model), "n1 long, n2 long, n3 long, n4 long, pairs long").agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "pairs")]).first()
    sums.drop()
    tidy(spark)
    e = discounts(list(seen[:4]))
    three = count - seen["n1"] - seen["n2"]
    spread = (e[0] * seen["n1"] + e[1] * seen["n2"] + e[2] * three) / seen["pairs"]
    return model._replace(word_discounts=e, kinds=seen["pairs"], spread=spread)


def probabilities(maps: Mapped, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """p(w | v) for numbers, -1 for unknown words."""
    m = maps.model
    if not m.words:
        return np.ones(len(w))
    numbers, back = np.unique(np.concatenate([v, w]), return_inverse=True)
    known = numbers >= 0
    total, share, follows = (np.zeros(len(numbers), t) for t in ("<u8", "<f8", "<u8"))
    for out, column in ((total, "total"), (share, "back"), (follows, "follows")):
        out[known] = maps.of(numbers[known], column, out.dtype.str)
    less = np.array([0.0, *m.word_discounts])[np.minimum(follows, 3).astype(np.int64)]
    q = (follows - less) / m.kinds + m.spread / (m.words + 1)
    at_v, at_w = back[: len(v)], back[len(v) :]
    key = pair_keys(np.maximum(v, 0), np.maximum(w, 0), m.words)
    keys, of = np.unique(key, return_inverse=True)
    n = np.where((v >= 0) & (w >= 0), maps.pairs(keys)[of], 0)
    left = n - np.array([0.0, *m.pair_discounts])[np.minimum(n, 3)]
    sums = total[at_v].astype(float)
    seen = sums > 0
    return np.where(seen, left / np.where(seen, sums, 1) + share[at_v] * q[at_w], q[at_w])


def _scored(model: Model, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = Mapped(model)
        for piece in _pieces(batches, size):
            tokens, starts = _flat(piece)
            v, w, n = _numbers(maps, tokens, starts)
            base = np.log10((n + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
            own = np.log10(probabilities(maps, v, w))
            rows = piece.num_rows
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("held_out"), pa.array(np.diff(np.append(starts, len(tokens)))), pa.array(np.add.reduceat((n > 0).astype(np.int64), starts)),
                 pa.array(np.full(rows, model.tokens, np.int64)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(own, starts))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
        _give_back()

    return run


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", piece: int = PIECE, tally: int = TALLY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learnt from rows that are not held out.

    Scores are log10 probabilities of whole texts. The model's folder stays as long as the result is used."""
    rows = token_rows(docs, key, text)
    model = train(rows.filter("NOT held_out"), piece, tally)
    return rows.mapInArrow(_scored(model, piece), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
