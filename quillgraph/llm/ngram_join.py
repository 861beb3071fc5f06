"""Exact Jaccard self-join on word n-grams by universe partition and the pigeonhole principle.

A text's set holds the hashes of its distinct n-word shingles. Two sets with Jaccard similarity of at least NUM / DEN
(9 / 10 unless the caller says otherwise) differ in H elements at most, H known from their sizes. The hash universe is cut into m segments, m = H + 1 + slack,
so at least 1 + slack segments of two such sets are equal. Sizes fall into bands, each with its own m and its own
cut; a set is indexed in its band and also in the band below when its size can meet one there.

Signatures (one hash each): every segment of three elements or more (two below 0.88). Smaller segments say little and would gather
many unrelated sets in one bucket, so they have none; that is what the slack is for. A set with more small segments
than the slack also gets the one-deletion neighbourhoods of its segments, which find segments that differ in one
element; a set for which even those do not reach H gets all its segments. The slack of a band is the one with
the least expected number of signatures.

Similar sets share not one signature but many: all segments but H, less the small ones. Sets whose signatures that others
have too are fewer than that leave their buckets first.

Buckets are not expanded into pairs. Members of a bucket meet one of them, the pivot: near ones are in its component.
The members of a pivot (its star) are then seen as differences from the star's centre; the member nearest to the centre
meets all others. Two members of which at least one is still outside that one's component can only be similar if
their differences overlap, so they meet again by a prefix of these differences (elements that the centre lacks come
first, since those are rare). Buckets of this second kind whose members are in one component are finished; in the
others 32, 256, ... members meet the members of other components, until every pair is either tested or inside one
component. Sets carry the parities of their elements' counts by hash: each element that only one of two sets has turns one bit, so
two sets whose bits differ in more than H places are not similar, and no pair is made of them. Tests count the exact intersection.

Scale: equal texts are one class before anything else (partial aggregation). What is shuffled are signatures (about one
for six shingles, 16 bytes) and sets of candidates only. Aggregations precede joins, so a hot bucket is split by
skew handling; pairs that are emitted grow with bucket size, not with its square, as components merge.

Defined cases: null text counts as empty; a text without words is linked with nothing and is its own component; a text
with fewer words than n has one shingle, the whole; null doc_ids never are a component's id unless all are null; equal
rows share a component; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import erfc, exp, sqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import among, batches_of, durable, stored, tidy
from .components import components, joined

#: Jaccard threshold as a fraction.
NUM, DEN = 9, 10
PIVOTS = 32
#: Nearest members of a pivot that its star's centre is taken from; it affects speed alone.
CENTRE = 32
SALTS = 16
#: Rounds in which sets that share too few signatures leave their buckets.
THINNED = 2
#: Rows of a batch that goes to Python, and that leaves it.
BATCH, CHUNK = 500, 128
#: Signatures of a bucket that one task sorts.
BUCKET = 1 << 17
#: Longs of parities of a set, and of one of WIDE_FROM elements or more.
NARROW, WIDE, WIDE_FROM = 8, 32, 1 << 10


def shape(num: int, den: int) -> tuple[float, int]:
    """(growth of the bands, elements that a segment needs for a signature of its own) by the least number of signatures.

    Two sets at the threshold have (num + den) / (den - num) / 2 elements for each that differs. Where that is many, wide bands
    keep most sets in one band and segments are still large; where it is few, a band must be hardly wider than its reach.
    Measured for a shingle: 0.14 signatures at 9 / 10; at 4 / 5 0.5, and 2.0 with the shape of 9 / 10."""
    return (1.4, 3) if num + den >= 16 * (den - num) else (1.01 * den / num, 2)


class Band(NamedTuple):
    number: int
    upper: int  # sizes of the smaller set go up to this
    reach: int  # and of the larger one up to this
    h: int
    m: int
    slack: int


def _poisson(mean: float, upto: int) -> list[float]:
    p = [exp(-mean)]
    for k in range(1, upto):
        p.append(p[-1] * mean / k)
    return p


def _slack(h: int, low: int, high: int, strong: int) -> int:
    """The slack with the least expected number of signatures of sets of the sizes low to high, evenly spread.

    Small segments are about binomial in number; many of them about normal."""

    def beyond(m: int, weak: float, slack: int) -> float:
        mean = m * weak
        if mean < 20:
            return max(0.0, 1 - sum(_poisson(mean, slack + 1)))
        return erfc((slack + 0.5 - mean) / sqrt(2 * mean * (1 - weak) + 1e-9)) / 2

    def cost(slack: int) -> float:
        m, total = h + 1 + slack, 0.0
        for i in range(5):
            size = low + (high - low) * i / 4
            weak = min(1.0, sum(_poisson(size / m, strong)))
            total += m * (1 - weak) + beyond(m, weak, slack) * (size + m)
        return total

    return min(range(0, 9 + 2 * h, max(1, h // 64)), key=cost)


@lru_cache(maxsize=None)
def band(number: int, num: int = NUM, den: int = DEN) -> Band:
    growth, strong = shape(num, den)
    low, upper = 1, -(-num // (den - num)) - 1  # below this no two different sets are similar enough
    for _ in range(number):
        low, upper = upper + 1, max(upper + 1, int(upper * growth))
    reach = upper * den // num
    h = (upper + reach) * (den - num) // (den + num)
    return Band(number, upper, reach, h, 1, 0) if h == 0 else Band(number, upper, reach, h, h + 1 + (s := _slack(h, low, reach, strong)), s)


@lru_cache(maxsize=1 << 16)
def bands_of(size: int, num: int = NUM, den: int = DEN) -> tuple[Band, ...]:
    """The band of a size, and those below where it can be the larger set: one, for bands are as wide as their reach."""
    k = 0
    while band(k, num, den).upper < size:
        k += 1
    here = band(k, num, den)
    if k > 1 and band(k - 2, num, den).reach >= size:
        raise ValueError("a set can be similar to sets two bands below")
    return (here,) if not k or (below := band(k - 1, num, den)).reach < size else (here, below)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = 3) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; A-Z in lower case, words without ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = _mix(out) + h[i : len(h) - n + 1 + i]
    return np.unique(_mix(out))


def band_signatures(elements: np.ndarray, num: int = NUM, den: int = DEN) -> list[tuple[np.ndarray, int]]:
    """For each band of a set its signatures, and how many of them any similar set of that band must share.

    Of m segments at most H differ, so m - H are equal, and all of these have a signature but those that are small."""
    size, out, least = len(elements), [], shape(num, den)[1]
    for place, b in enumerate(bands_of(size, num, den) if size else ()):
        salt = np.uint64((2 * b.number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        hashed = _mix(elements + salt)
        if b.m == 1:
            out.append((_mix(np.array([hashed.sum()], np.uint64) + salt), 1))
            continue
        at = ((hashed >> np.uint64(32)) % np.uint64(b.m)).astype(np.int64)
        value = _mix(hashed)
        counts = np.bincount(at, minlength=b.m)
        sums = np.zeros(b.m, np.uint64)
        np.add.at(sums, at, value)
        mark = (np.arange(b.m, dtype=np.uint64) << np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + salt
        strong = counts >= least
        weak = b.m - int(strong.sum())
        room = 2 * int((counts > least).sum()) + int((counts == least).sum())
        near = weak > b.slack
        whole = near and room <= b.h
        found = _mix(_mix(sums + mark)[strong | whole])
        partner = b.upper if place else size * den // num
        shared = 1 if near else max(1, b.m - (size + partner) * (den - num) // (den + num) - weak)
        if near:
            tagged = sums + ~mark
            can = counts[at] > least
            found = np.concatenate([found, _mix(_mix(tagged)[strong]), _mix(_mix(tagged[at[can]] - value[can]))])
        out.append((np.unique(found), shared))
    return out


def signatures(elements: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    return np.unique(np.concatenate([s for s, _ in band_signatures(elements, num, den)])) if len(elements) else np.empty(0, np.uint64)


def _chunks(p: pd.DataFrame, make) -> Iterator[pd.DataFrame]:
    for i in range(0, len(p), CHUNK):
        yield make(p.iloc[i : i + CHUNK])


def _signed(n: int, num: int, den: int):
    """Adds a row's set size and signatures; its own columns pass through Arrow as they are, nulls and large ids included."""
    lists = lambda values: pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)]).astype(np.int32), np.concatenate([*values, np.empty(0, np.uint64)]).view(np.int64))
    nothing = (np.empty(0, np.uint64), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                sets = [shingles(t, n) for t in b.column("text").to_pylist()]
                found = [[*band_signatures(x, num, den), nothing, nothing] for x in sets]
                made = [pa.array([len(x) for x in sets], pa.int64())]
                for i in (0, 1):
                    made += [lists([f[i][0] for f in found]), pa.array([f[i][1] for f in found], pa.int32())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), *made], names=["doc_id", "key", "n", "sigs0", "share0", "sigs1", "share1"])
        pa.default_memory_pool().release_unused()

    return run


def _near_numbers(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose numbers c ascend by small steps, so that a number and its piece's first differ by less than
    2^31: a task reads several files, and numbers jump from one file to the next, in either direction."""
    step = np.diff(batch.column("c").to_numpy())
    edges = [0, *(np.flatnonzero((step <= 0) | (step >= 1 << 20)) + 1).tolist(), batch.num_rows]
    for i, j in zip(edges, edges[1:]):
        for at in range(i, j, 1 << 10):
            yield batch.slice(at, min(j - at, 1 << 10))


def _dealt(buckets: int):
    """Signatures and whose they are, packed as 8 and 4 bytes, in a row for each bucket of signatures and batch.

    Of a signature that many sets of the batch have, two stay; the others are known to be shared, go beside the buckets
    (numbers from `buckets` on) and are not counted again, so a bucket is small however many sets share a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, b in enumerate(x for whole in batches for x in _near_numbers(whole)):
            c = b.column("c").to_numpy()
            lists = [b.column(f"sigs{i}") for i in (0, 1)]
            sigs = np.concatenate([x.flatten().to_numpy() for x in lists]).view(np.uint64)
            owner = np.concatenate([2 * np.repeat(c - c[0], x.value_lengths().to_numpy()) + i for i, x in enumerate(lists)]).astype(np.uint32)
            order = np.argsort(sigs, kind="stable")
            sigs, owner = sigs[order], owner[order]
            third = np.zeros(len(sigs), bool)
            third[2:] = sigs[2:] == sigs[:-2]
            at = (sigs >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            out = []
            for some, number in ((~third, lambda x: x), (third, lambda x: buckets + (x + turn) % buckets)):
                s, o, edges = sigs[some], owner[some], at[some].astype(np.int64)
                starts = np.flatnonzero(np.append(True, edges[1:] != edges[:-1])) if len(s) else []
                out += [(int(number(edges[i])), s[i:j].tobytes(), o[i:j].tobytes()) for i, j in zip(starts, [*starts[1:], len(s)])]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([int(c[0])] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["bucket", "first", "sigs", "owners"])
        pa.default_memory_pool().release_unused()

    return run


def _shared(buckets: int):
    """sig, c, lower of a bucket's signatures that more than one set has."""

    def run(t: pa.Table) -> pa.Table:
        parts = list(zip(t.column("first").to_pylist(), t.column("sigs").to_pylist(), t.column("owners").to_pylist()))
        sigs = np.frombuffer(b"".join(x for _, x, _ in parts), np.uint64)
        owner = np.concatenate([2 * first + np.frombuffer(o, np.uint32).astype(np.int64) for first, _, o in parts])
        if t.column("bucket")[0].as_py() < buckets:
            order = np.argsort(sigs, kind="stable")
            sigs, owner = sigs[order], owner[order]
            same = np.append(sigs[1:] == sigs[:-1], False)
            several = same | np.append(False, same[:-1])
            sigs, owner = sigs[several], owner[several]
        return pa.table({"sig": sigs.view(np.int64), "c": owner >> 1, "lower": (owner & 1).astype(bool)})

    return run


def parities(elements: np.ndarray) -> np.ndarray:
    """Bits, 64 a long: whether the number of elements that hash to a bit's place is odd."""
    bits = 64 * (WIDE if len(elements) >= WIDE_FROM else NARROW)
    counts = np.bincount((_mix(elements) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _sets(n: int):
    def made(p: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t, n) for t in p["text"]]
        return pd.DataFrame({"c": p["c"], "elements": [x.view(np.int64) for x in sets], "bits": [parities(x) for x in sets]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield from _chunks(p, made)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are similar enough."""
    size = F.size
    x = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    most = F.greatest(size("x"), size("y")) * num <= F.least(size("x"), size("y")) * den
    both = size(F.array_intersect("x", "y"))
    return x.filter(most).filter(both * (den + num) >= (size("x") + size("y")) * num).select("a", "b")


def _detail(star: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, nb, extra, less for pivots a and members b of their buckets, and each pivot as its own member.

    extra and less: elements that only b, and only a has."""
    rows = star.union(star.select("a", F.col("a").alias("b")).distinct())
    x = rows.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    only = lambda p, q: F.array_sort(F.array_except(p, q))
    return x.select("a", "b", F.size("y").alias("nb"), only("y", "x").alias("extra"), only("x", "y").alias("less"))


def _first(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each group, chosen in SALTS places and then among those: no task sees a whole large group."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    some = salted.withColumn("__k", F.row_number().over(Window.partitionBy(by, "__salt").orderBy(*order))).filter(F.col("__k") <= k)
    return some.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("__k") <= k).drop("__salt", "__k")


def _centred(detail: DataFrame) -> DataFrame:
    """extra and less relative to a star's centre instead of its pivot: elements in which most of its nearest members
    differ from the pivot are turned over. Any set does as centre; this one makes differences few and rare."""
    members = detail.filter("a != b").withColumn("d", F.size("extra") + F.size("less"))
    some = _first(members, "a", ["d", "b"], CENTRE)
    each = some.select("a", F.explode("extra").alias("t"), F.lit(True).alias("more")).unionByName(some.select("a", F.explode("less").alias("t"), F.lit(False).alias("more")))
    counts = each.groupBy("a", "t", "more").agg(F.count("*").alias("n")).join(some.groupBy("a").agg(F.count("*").alias("of")), "a").filter("2 * n > of")
    turned = counts.groupBy("a").agg(F.collect_set(F.when(F.col("more"), F.col("t"))).alias("more"), F.collect_set(F.when(~F.col("more"), F.col("t"))).alias("fewer"))
    x = detail.join(turned, "a", "left")
    empty = F.array().cast("array<bigint>")
    more, fewer = F.coalesce("more", empty), F.coalesce("fewer", empty)
    extra = F.array_sort(F.concat(F.array_except("extra", more), F.array_except(fewer, F.col("less"))))
    less = F.array_sort(F.concat(F.array_except("less", fewer), F.array_except(more, F.col("extra"))))
    return x.select("a", "b", "nb", extra.alias("extra"), less.alias("less")).withColumn("d", F.size("extra") + F.size("less"))


def _prefixes(x: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, nb, d, y, prefix, to_core. x: a, b, nb, extra, less, d, and the star's exemplar y, its size ne and difference e.

    Members x, y of one star differ in |Dx| + |Dy| - 2 |Dx and Dy| elements, D their differences from the centre. A member
    outside the exemplar's component differs from the exemplar in more than H, so |Dx| has a lower bound, and so has the
    overlap of Dx and Dy of similar x and y of which one is outside. They then share an element among the first of
    each: `prefix` is what a member needs to meet outer members, `to_core` what an outer one needs to meet those of the
    core. 0 stands for the rare case in which they need not share any."""
    share_of = lambda n: n * (den - num) / (den + num)
    h = F.floor(share_of(F.col("nb") + F.floor(F.col("nb") * den / num)))
    q = F.floor(share_of(F.col("ne") + F.ceil(F.col("nb") * num / den))) + 1 - F.col("e")
    x = x.withColumn("h", h.cast("int")).withColumn("q", F.greatest(q, F.col("d") - F.col("h")).cast("int"))
    share = F.ceil((F.col("d") + F.col("q") - F.col("h")) / 2).cast("int")
    every = F.concat("extra", "less")
    any_ = F.concat(every, F.array(F.lit(0).cast("bigint")))
    first = lambda n: F.slice(every, F.lit(1), F.greatest(F.lit(0), F.least(n, F.col("d"))))
    prefix = F.when(share >= 1, first(F.col("d") - share + 1)).otherwise(any_)
    to_core = F.when(F.col("d") > F.col("h"), first(F.col("h") + 1)).otherwise(any_)
    return x.select("a", "b", "nb", "d", "y", prefix.alias("prefix"), to_core.alias("to_core"))


def _placed(rest: DataFrame, column: str, side: str) -> DataFrame:
    """a, t and, with `side` in their names, member c, size n, difference d and the element's place i, an element a row."""
    each = rest.select("a", F.col("b").alias(f"c{side}"), F.col("nb").alias(f"n{side}"), F.col("d").alias(f"d{side}"), F.posexplode(column).alias(f"i{side}", "t"))
    return each


def _may(p: str, q: str, num: int, den: int) -> Column:
    """Whether two members that share this element can be similar: by their own sizes and differences the overlap must
    have so many elements, and this one may be its first only if as many can follow on both sides."""
    least = F.ceil((F.col(f"d{p}") + F.col(f"d{q}") - F.floor((F.col(f"n{p}") + F.col(f"n{q}")) * (den - num) / (den + num))) / 2)
    return (least <= 0) | ((F.col(f"i{p}") <= F.col(f"d{p}") - least) & (F.col(f"i{q}") <= F.col(f"d{q}") - least))


def _alike(p: str, q: str, num: int, den: int) -> Column:
    """Whether two sets can be similar by their parities; those of different widths are not compared."""
    x, y = F.col(f"bits{p}"), F.col(f"bits{q}")
    apart = F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda some, k: some + k)
    return (F.size(x) != F.size(y)) | (apart <= F.floor((F.col(f"n{p}") + F.col(f"n{q}")) * (den - num) / (den + num)))


def _rooted(rows: DataFrame, roots: DataFrame, c: str, out: str) -> DataFrame:
    return rows.join(roots.toDF(c, "__r"), c, "left").withColumn(out, F.coalesce("__r", c)).drop("__r")


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, key (digest of the text), n_shingles, component_id for every row of docs, and head: one text of its component.

    Sets of n-word shingles with Jaccard similarity of num / den or more are linked."""
    if not num < den <= 2 * num:
        raise ValueError("the threshold must be from one half to under one")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("key"), F.col(text).alias("text"))
    spark = docs.sparkSession
    signed = rows.mapInArrow(_signed(n, num, den), "doc_id long, key binary, n long, sigs0 array<long>, share0 int, sigs1 array<long>, share1 int")
    grouped = signed.groupBy("key").agg(F.min("doc_id").alias("label"), *[F.first(c).alias(c) for c in ("n", "sigs0", "share0", "sigs1", "share1")])
    with batches_of(spark, BATCH):
        indexed = stored(grouped.withColumn("c", F.monotonically_increasing_id()))
    classes = stored(indexed.df.select("c", "label", "key", "n", "share0", "share1")).df
    tidy(spark)

    total = indexed.df.agg(F.sum(F.size("sigs0") + F.size("sigs1"))).first()[0] or 0
    buckets = total // BUCKET + 1
    with batches_of(spark, BATCH):
        packed = indexed.df.select("c", "sigs0", "sigs1").mapInArrow(_dealt(buckets), "bucket long, first long, sigs binary, owners binary")
        members = stored(packed.groupBy("bucket").applyInArrow(_shared(buckets), "sig long, c long, lower boolean"))
    indexed.drop()
    tidy(spark)
    shares = classes.select("c", F.explode(F.array(F.struct(F.lit(False).alias("lower"), F.col("share0").alias("share")), F.struct(F.lit(True).alias("lower"), F.col("share1").alias("share")))).alias("s")).select("c", "s.lower", "s.share")
    several = lambda d: d.groupBy("sig").agg(F.min("c").alias("p"), F.max("c").alias("q")).filter("p < q").select("sig")
    for _ in range(THINNED):  # a set that shares too few signatures with all others together has no similar one
        enough = members.df.groupBy("c", "lower").agg(F.count("*").alias("n")).join(shares, ["c", "lower"]).filter("n >= share").select("c", "lower")
        kept, last = stored(members.df.join(enough, ["c", "lower"], "left_semi")), members
        members = stored(kept.df.join(several(kept.df), "sig"))
        last.drop(), kept.drop()
    tidy(spark)
    wanted = durable(members.df.select("c").distinct().join(classes.select("c", "label", "key"), "c"))
    texts = among(rows, "key", wanted).join(wanted.toDF("c", "__label", "__key"), (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__label"))).select("c", "text")
    with batches_of(spark, BATCH):
        held = stored(texts.mapInPandas(_sets(n), "c long, elements array<long>, bits array<long>").dropDuplicates(["c"]))
    sets = held.df.select("c", "elements")
    with_bits = lambda rows, c, out: rows.join(held.df.select(F.col("c").alias(c), F.col("bits").alias(out)), c)
    tidy(spark)

    # pivot of a bucket: the member that meets most others over all its buckets, so that buckets of one group agree on it
    met = members.df.select("sig", "c").distinct()
    weights = met.join(met.groupBy("sig").agg(F.count("*").alias("n")), "sig").groupBy("c").agg(F.sum("n").alias("w"))
    pivots_ = met.join(weights, "c").groupBy("sig").agg(F.max(F.struct("w", (-F.col("c")).alias("c"))).alias("top")).select("sig", (-F.col("top.c")).alias("a"))
    buckets = stored(met.join(pivots_, "sig").filter("c != a").select("sig", "a", F.col("c").alias("b")))
    members.drop()
    star = durable(buckets.df.select("a", "b").distinct())
    done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots = durable(components(_verified(star, sets, num, den)))
    tidy(spark)

    # buckets in which members beside the pivot are not yet in one component: a star's other members have met all they can
    at = _rooted(buckets.df, roots, "b", "r")
    star = durable(at.join(at.groupBy("sig").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).filter("lo < hi").select("sig"), "sig").select("a", "b").distinct())
    buckets.drop()
    # the member nearest to each centre, the exemplar, against all others that it is not yet linked with
    detail = stored(_detail(star, sets))
    centred = stored(_centred(detail.df))
    detail.drop()
    exemplars = centred.df.groupBy("a").agg(F.min(F.struct("d", "b", "nb")).alias("m")).select("a", F.col("m.b").alias("y"), F.col("m.d").alias("e"), F.col("m.nb").alias("ne"))
    prefixes = stored(_prefixes(centred.df.join(exemplars, "a"), num, den))
    centred.drop()
    tidy(spark)
    apart = lambda p: _rooted(_rooted(p, roots, "x", "rx"), roots, "y", "ry").filter("rx != ry").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    tested = durable(apart(prefixes.df.select(F.col("b").alias("x"), "y")).join(done, ["a", "b"], "left_anti"))
    roots = durable(joined(roots, _verified(tested, sets, num, den)))
    tidy(spark)

    # outer members against the core, and against each other
    rest = stored(_rooted(_rooted(prefixes.df, roots, "b", "rb"), roots, "y", "ry").withColumn("core", F.col("rb") == F.col("ry")).drop("rb", "ry"))
    prefixes.drop()
    outer, core = _placed(rest.df.filter("NOT core"), "to_core", "x"), _placed(rest.df.filter("core"), "prefix", "y").withColumnsRenamed({"a": "a2", "t": "t2"})
    outer = with_bits(outer.join(core.select(F.col("a2").alias("a"), F.col("t2").alias("t")).distinct(), ["a", "t"], "left_semi"), "cx", "bitsx")
    met = outer.join(with_bits(core, "cy", "bitsy"), (F.col("a") == F.col("a2")) & (F.col("t") == F.col("t2")) & _may("x", "y", num, den) & _alike("x", "y", num, den))
    pairs = met.select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct()
    more = durable(apart(pairs).join(done, ["a", "b"], "left_anti").join(tested, ["a", "b"], "left_anti"))
    tested = tested.union(more)
    roots = durable(joined(roots, _verified(more, sets, num, den)))
    tidy(spark)

    open_ = _placed(rest.df.filter("NOT core"), "prefix", "x").withColumn("sig", F.xxhash64("a", "t")).drop("a", "t").withColumnRenamed("cx", "c")
    pivots = PIVOTS
    while True:
        at = _rooted(open_, roots, "c", "r")
        several = at.groupBy("sig").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).filter("lo < hi").select("sig")
        open_ = durable(at.join(several, "sig"))
        if not open_.limit(1).count():
            break
        chosen = durable(_first(open_, "sig", ["c"], pivots).select("sig", F.col("c").alias("a"), F.col("r").alias("ra"), F.col("nx").alias("ny"), F.col("dx").alias("dy"), F.col("ix").alias("iy")))
        others = with_bits(chosen.withColumnRenamed("sig", "s"), "a", "bitsy")
        met = with_bits(open_, "c", "bitsx").join(others, (F.col("sig") == F.col("s")) & (F.col("r") != F.col("ra")) & _may("x", "y", num, den) & _alike("x", "y", num, den))
        pairs = met.select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()
        fresh = durable(pairs.join(tested, ["a", "b"], "left_anti").join(done, ["a", "b"], "left_anti"))
        tested = tested.union(fresh)
        roots = durable(joined(roots, _verified(fresh, sets, num, den)))
        tidy(spark)
        open_ = open_.drop("r").join(chosen.select("sig", F.col("a").alias("c")), ["sig", "c"], "left_anti")
        pivots *= 8

    at = durable(_rooted(classes.select("c", "key", "label", "n"), roots, "c", "r"))
    firsts = at.groupBy("r").agg(F.min("label").alias("least"))
    named = at.join(firsts, "r").select(F.col("key").alias("__key"), "n", "least", (F.col("c") == F.col("r")).alias("head"))
    found = rows.select("doc_id", "key").join(named, F.col("key") == F.col("__key"))
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return found.select("doc_id", "key", F.col("n").alias("n_shingles"), own.alias("component_id"), "head")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs with one document of each component: the one with its least id, any one if it has no ids; texts without words all stay."""
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("doc_id").isNotNull() | F.col("head"))
    keep = linked(docs, key, text, n, num, den).filter(first | (F.col("n_shingles") == 0))
    keep = keep.groupBy(F.col("doc_id").alias("__d"), F.col("key").alias("__k")).agg((F.max("n_shingles") == 0).alias("__all"))
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    kept = docs.withColumn("__key", digest).join(keep, (F.col("__key") == F.col("__k")) & F.col(key).cast("long").eqNullSafe(F.col("__d")))
    w = Window.partitionBy("__key", "__d").orderBy(F.lit(1))
    return kept.withColumn("__i", F.when(F.col("__all"), 1).otherwise(F.row_number().over(w))).filter("__i = 1").select(*docs.columns)
