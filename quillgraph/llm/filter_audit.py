"""Audit of how filters interact: what each removes in every order, what it removes alone, its Shapley share.

Five filters look at whole texts. Four are conditions on the text itself (A: few words, B: few different words, C: many capitals,
D: symbols) and become bits of a mask in the scan. The fifth (E: a copy of a row with a smaller id) comes from a sort: rows are
dealt by ranges of (fingerprint of the text, id) and sorted inside a range by fingerprint, whole text and id, so that each row is compared
with the one before it. A run of equal texts may begin in an earlier range, and only the heads of a range's first runs can be
wrong about that; they are kept open, and the first ids of the runs at both ends of every range (a few rows a range) settle them.

Masks are then counted by part, mask and label: 32 masks at most a part, additive over any split of the rows. All orders,
steps and shares are sums over these counters.

Scale: texts are shuffled once, by ranges that split a text with many copies (ids, and a random salt for rows equal in both); ids and
masks are shuffled once more to meet the labels; counters are aggregated before they are shuffled.

Defined cases: null text is empty text; a null source is the part ''; rows with a null id are never copies and make none; rows
equal in id and text are no copies of each other; several labels of an id count by their greatest; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored, tidy

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")


def text_mask(text: Column) -> Column:
    """Bits of the failed conditions A to D."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    few = F.size(words) < 50
    same = 100 * F.size(F.array_distinct(words)) < 65 * F.size(words)
    loud = 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.char_length(text)
    signs = text.rlike("[#$%&*|]")
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate((few, same, loud, signs))]
    return (bits[0] + bits[1] + bits[2] + bits[3]).cast("int")


_ROWS = "kind int, doc_id long, part string, mask int, range int, run int, fp long, text string, first long"
_SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("range", pa.int32()), ("run", pa.int32()), ("fp", pa.int64()), ("text", pa.string()), ("first", pa.int64())])
_NEVER = np.iinfo(np.int64).max


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted range (doc_id, part, mask, fp, text, range) with their copy bit.

    kind 0: a document; run is set if it heads a run of the range's first fingerprint, so that an earlier range may make it a copy.
    kind 1 and 2: text and first id of each run of the range's first and last fingerprint (the same runs if there is but one)."""
    span = opening = None  # the range and its first fingerprint
    fp = text = None  # of the last row
    first, run = _NEVER, -1  # least id and number of the run so far
    heads: list[tuple] = []  # runs of the first fingerprint: number, fingerprint, text, first id
    tails: list[tuple] = []  # of the last one
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        prints, ids, texts = b.column("fp").to_numpy(), b.column("doc_id"), b.column("text")
        if span is None:
            span, opening = b.column("range")[0].as_py(), int(prints[0])
        starts_run = np.ones(n, bool)
        starts_run[1:] = (prints[1:] != prints[:-1]) | ~pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts_run[0] = not (fp == prints[0] and text == texts[0].as_py())
        starts = np.flatnonzero(starts_run)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        plain = pc.fill_null(ids, 0).to_numpy()
        at = np.cumsum(starts_run)  # ids ascend in a run, nulls last: its first id is its least
        least = np.concatenate([[first], np.where(known[starts], plain[starts], _NEVER)])[at]
        copy = known & (plain > least)
        number = run + at
        is_open = known & ~copy & (prints == opening)
        for s in starts.tolist():
            if prints[s] == opening or prints[s] == prints[-1]:
                note = (int(number[s]), int(prints[s]), texts[s].as_py(), ids[s].as_py())
                heads += [note] if prints[s] == opening else []
                tails = [x for x in tails if x[1] == note[1]] + [note] if prints[s] == prints[-1] else tails
        fp, text, first, run = int(prints[-1]), texts[n - 1].as_py(), int(least[-1]), int(number[-1])
        mask = pc.add(b.column("mask"), pa.array(np.where(copy, COPY, 0).astype(np.int32)))
        nothing = [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), ids, b.column("part"), mask, b.column("range"), pa.array(number.astype(np.int32), mask=~is_open), *nothing], schema=_SCHEMA)
    notes = [(k, *x) for k, xs in ((1, heads), (2, tails)) for x in xs]
    if notes:
        yield pa.RecordBatch.from_pylist([{"kind": k, "range": span, "run": i, "fp": f, "text": t, "first": x} for k, i, f, t, x in notes], schema=_SCHEMA)


def failure_masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """doc_id, part, mask (bits of FILTERS that the row fails) for every row of docs."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.xxhash64(whole).alias("fp"), whole.alias("text"), F.rand(11).alias("salt"))
    dealt = rows.repartitionByRange("fp", "doc_id", "salt").sortWithinPartitions("fp", "text", F.col("doc_id").asc_nulls_last())
    # masks come after the sort: what stands before it runs twice, once to find the ranges
    found = stored(dealt.select("doc_id", "part", text_mask(F.col("text")).alias("mask"), "fp", "text", F.spark_partition_id().alias("range")).mapInArrow(_compared, _ROWS)).df
    tidy(docs.sparkSession)
    # runs at the ends of ranges, a few a range: the least id of each text over all of them
    ends = found.filter("kind > 0 AND first IS NOT NULL").select("kind", "range", "run", "fp", "text", "first")
    least = ends.groupBy("fp", "text").agg(F.min("first").alias("least"))
    late = ends.filter("kind = 1").join(least, ["fp", "text"]).filter("least < first").select("range", "run", F.lit(COPY).alias("copy"))
    settled = found.filter("kind = 0").join(F.broadcast(late), ["range", "run"], "left")  # one row a range, but for texts of one fingerprint
    return settled.select("doc_id", "part", (F.col("mask") + F.coalesce("copy", F.lit(0))).alias("mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic: additive counts, 32 masks at most a part."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).cast("int").alias("good"), F.max(F.col("toxic") == 1).cast("int").alias("toxic"))
    return masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def _weights() -> list[tuple]:
    """mask, before (filters applied earlier, as bits), letter, and what a document with that mask counts for there."""
    out = []
    for i, letter in enumerate(FILTERS):
        bit, others = 1 << i, [1 << j for j in range(len(FILTERS)) if j != i]
        for before in (sum(c) for k in range(len(FILTERS)) for c in combinations(others, k)):
            for mask in range(1 << len(FILTERS)):
                fails, gone = bool(mask & bit), bool(mask & before)
                share = factorial(len(FILTERS)) // mask.bit_count() if fails else 0
                out.append((mask, before, letter, int(not gone and not fails), int(fails and not gone), int(fails and gone), int(mask == bit), share))
    return out


def _orders() -> list[tuple]:
    """filter_order, step, before, letter of all orders."""
    bits = {x: 1 << i for i, x in enumerate(FILTERS)}
    return [("".join(o), k + 1, sum(bits[x] for x in o[:k]), o[k]) for o in permutations(FILTERS) for k in range(len(o))]


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step and the counts of each step, for every part and every order of the filters.

    kept, removed: after and at this step; redundant: fail its filter but were removed before; unique_fails: fail its filter only;
    good_lost, toxic_lost: of those removed here; shapley: its filter's removed over all orders."""
    spark = docs.sparkSession
    weights = spark.createDataFrame(_weights(), "mask int, before int, letter string, kept int, removed int, redundant int, alone int, share int")
    orders = spark.createDataFrame(_orders(), "filter_order string, step int, before int, letter string")
    counted = counters(failure_masks(docs, key, text, part), labels).join(F.broadcast(weights), "mask")  # 2560 and 600 rows, whatever the tables' sizes
    total = lambda n, w, name: F.sum(F.col(n) * F.col(w)).alias(name)
    steps = counted.groupBy("part", "before", "letter").agg(
        total("docs", "kept", "kept"), total("docs", "removed", "removed"), total("docs", "redundant", "redundant"), total("docs", "alone", "unique_fails"),
        total("good", "removed", "good_lost"), total("toxic", "removed", "toxic_lost"), total("docs", "share", "shapley"),
    )
    return steps.join(F.broadcast(orders), ["before", "letter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
