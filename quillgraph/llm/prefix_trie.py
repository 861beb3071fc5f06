"""Prefix trie of conversations: which share their first turns, and what storing shared turns once would save.

A node is a distinct sequence of first d turns; it belongs to its member with the smallest id, its owner. Ownership never ends on
the way down: who owns a prefix owns all its longer ones. So each conversation owns a chain, from its first owned depth to its
end, and the chains form the tree: a chain hangs at the node above its top, which another conversation owns.

Prefixes are told apart by their depth and four running sums of hashes of (place, turn), 128 bits. Minima over equal prefixes
give each node's owner. Every conversation finds its first owned depth by binary search, all at once: a round joins one probed prefix of each
undecided conversation with the minima. Sums below a node are taken over chains first, bottom up by doubling: in round k a
chain adds what it holds to the chain 2^k above it, so a tree of chains h high takes log2 h rounds; sums along a chain then
give its nodes.

Scale: texts are hashed in the scan and go no further. Turns are numbered by a range sort, running sums are taken in blocks
of 256 places and then over blocks, so a conversation with a third of all turns spreads over tasks. A node with many
ends is hashed from blocks of at most 4096 ids, in order, by a task that holds one block.

Defined cases: turns go by number, null first, equal numbers by the SHA-256 of role and text; null role and text are empty; rows
with a null conversation id take no part; repeated rows are turns of their own; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, stored, tidy

#: Conversations come in families of this many ids; one takes at most HEADS - 1 first turns from the first of its family.
FAMILY, HEADS = 5, 9
#: Places whose running sums one window takes.
BLOCK = 256
#: Ids that share their bits above these stand in one block of a node's ends.
ID_BITS = 12

SUMS = ["s0", "s1", "s2", "s3"]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds i, the place among the rows of a conversation in this sorted range, from 1."""
    last, held = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column("c").to_numpy()
        starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        i = np.arange(1, len(c) + 1) - np.repeat(starts, np.diff([*starts, len(c)]))
        if c[0] == last:
            i[: starts[1] if len(starts) > 1 else len(c)] += held
        last, held = c[-1], int(i[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(i, pa.int64())], names=[*b.schema.names, "i"])


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, i (place in the conversation from 1), t (digest of role and text), bytes of the text."""
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, what), 256)), 1, 16)
    rows = turns.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), digest.alias("t"), F.octet_length(what).cast("long").alias("bytes"), F.rand(5).alias("salt"))
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("t")]
    dealt = rows.repartitionByRange(*order, "salt").sortWithinPartitions(*order).select("c", "t", "bytes", F.spark_partition_id().alias("range"))
    found = stored(dealt.mapInArrow(_numbered, "c long, t binary, bytes long, range int, i long")).df
    parts = found.groupBy("c", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("range")) - F.col("n")
    # a range's first conversation alone can have begun before it: one row a range at most
    offsets = parts.withColumn("before", before).filter("before > 0").drop("n")
    return found.join(F.broadcast(offsets), ["c", "range"], "left").select("c", (F.col("i") + F.coalesce("before", F.lit(0))).alias("i"), "t", "bytes")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, d, t, bytes, length) of the rebuilt conversations' turns, and (c, length) of all conversations, without turns too."""
    h = F.crc32(F.col("c").cast("string").cast("binary")) % HEADS
    convs = rows.groupBy("c").agg(F.max("i").alias("n")).withColumn("b", F.col("c") - F.col("c") % FAMILY).withColumn("h", h)
    convs = durable(convs)
    convs = convs.join(convs.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b", "left").withColumn("k", F.least("h", F.coalesce("nb", F.lit(0))))
    convs = durable(convs.select("c", "b", "h", "k", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")))
    heads = rows.filter(F.col("i") < HEADS).withColumnRenamed("c", "b").join(convs, "b").filter("i <= h").select("c", F.col("i").alias("d"), "t", "bytes", "length")
    own = rows.withColumn("h", h).filter("i > h").drop("h").join(convs, "c").select("c", (F.col("i") - F.col("h") + F.col("k")).alias("d"), "t", "bytes", "length")
    return heads.union(own), convs.select("c", "length")


def running(rows: DataFrame, group: str, at: str, values: Sequence[str], longest: int, block: int = BLOCK) -> DataFrame:
    """values summed over the rows of a group up to place `at` (0 to longest, each once), in blocks, then over blocks."""
    b, before = f"__block_{at}", [f"__before_{v}" for v in values]
    cut = rows.withColumn(b, F.expr(f"{at} div {block}"))
    w = Window.partitionBy(group, b).orderBy(at)
    local = cut.withColumns({v: F.sum(v).over(w) for v in values})
    if longest < block:
        return local.drop(b)
    totals = cut.groupBy(group, b).agg(*[F.sum(v).alias(v) for v in values])
    upto = running(totals.withColumns({f"__own_{v}": F.col(v) for v in values}), group, b, values, longest // block, block)
    offsets = upto.select(group, b, *[(F.col(v) - F.col(f"__own_{v}")).alias(x) for v, x in zip(values, before)])
    return local.join(offsets, [group, b]).withColumns({v: F.col(v) + F.col(x) for v, x in zip(values, before)}).drop(b, *before)


def prefixes(turns: DataFrame, longest: int, block: int = BLOCK) -> DataFrame:
    """c, d, bytes (of the last turn), length, and the sums that tell the prefix of d turns apart."""
    hashes = [F.xxhash64(F.lit(k), "d", "t") for k in (1, 2)]
    halves = [x for v in hashes for x in (F.shiftrightunsigned(v, 32), v.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return running(turns.select("c", "d", "bytes", "length", *[x.alias(s) for x, s in zip(halves, SUMS)]), "c", "d", SUMS, longest, block)


def first_owned(heads: DataFrame, minima: DataFrame, lengths: DataFrame, longest: int) -> DataFrame:
    """c, length, f (first depth from 1 that c owns, length + 1 if none), a (owner of the prefix above, null for the root)."""
    state = durable(lengths.select("c", "length", F.lit(0).cast("long").alias("lo"), (F.col("length") + 1).alias("f"), F.lit(None).cast("long").alias("a")))
    probe = heads.select("c", F.col("d").alias("mid"), *SUMS)
    owners = minima.select(F.col("d").alias("mid"), *SUMS, "owner")
    for _ in range(longest.bit_length()):  # f - lo is longest + 1 at first, and halves
        open_ = state.filter("f - lo > 1").withColumn("mid", F.expr("(lo + f) div 2"))
        seen = open_.join(probe, ["c", "mid"]).join(owners, ["mid", *SUMS])
        mine = F.col("owner") == F.col("c")
        moved = seen.select("c", "length", F.when(mine, F.col("lo")).otherwise(F.col("mid")).alias("lo"), F.when(mine, F.col("mid")).otherwise(F.col("f")).alias("f"), F.when(mine, F.col("a")).otherwise(F.col("owner")).alias("a"))
        state = durable(moved.union(state.filter("f - lo <= 1")))
    return state.drop("lo")


def below(chains: DataFrame, values: Sequence[str]) -> DataFrame:
    """c, a and values of chains (c, a: the chain that it hangs on, null for the root), each summed over all chains below it and itself."""
    rest = state = durable(chains.select("c", "a", F.col("a").alias("up"), *values))
    while (rest := state.filter("up IS NOT NULL")).limit(1).count():
        added = rest.groupBy(F.col("up").alias("c")).agg(*[F.sum(v).alias(f"__{v}") for v in values])
        higher = rest.join(state.select(F.col("c").alias("up"), F.col("up").alias("__up")), "up").withColumn("up", F.col("__up")).drop("__up")
        moved = higher.select(*state.columns).union(state.filter("up IS NULL"))
        state = durable(moved.join(added, "c", "left").select("c", "a", "up", *[(F.col(v) + F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values]))
    return state.drop("up")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """owner, d and the SHA-256 of the ids of the blocks (owner, d, block, ids) that come in order, joined by commas."""
    key, state = None, hashlib.sha256()

    def out(keys: list, digests: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)] + [pa.array(digests, pa.string())], names=["owner", "d", "ends_sha256"])

    for b in batches:
        keys, digests = [], []
        for owner, d, ids in zip(b.column("owner").to_pylist(), b.column("d").to_pylist(), b.column("ids").to_pylist()):
            if (owner, d) != key:
                if key is not None:
                    keys.append(key), digests.append(state.hexdigest())
                key, state = (owner, d), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield out(keys, digests)
    if key is not None:
        yield out([key], [state.hexdigest()])


def ends_digests(ends: DataFrame) -> DataFrame:
    """owner, d, ends_sha256 of the ids c that end at each node (owner, d, c: every id once)."""
    blocks = ends.groupBy("owner", "d", F.shiftright("c", ID_BITS).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))
    return blocks.repartition("owner", "d").sortWithinPartitions("owner", "d", "block").select("owner", "d", "ids").mapInArrow(_hashed, "owner long, d long, ends_sha256 string")


def _long(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("long")


def trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    rows, lengths = rebuilt(numbered(turns, conv, turn, role, text))
    least, count, longest = lengths.agg(F.min("c"), F.count("*"), F.max("length")).first()
    heads = stored(prefixes(rows, longest or 0, block)).df
    tidy(spark)
    # every node once: the owner, and the length of its conversation
    nodes = heads.groupBy("d", *SUMS).agg(F.min(F.struct("c", "length")).alias("m"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"))
    minima = stored(nodes.select("d", *SUMS, F.col("m.c").alias("owner"), F.col("m.length").alias("length"), "n_convs", (F.col("bytes") * (F.col("n_convs") - 1)).alias("saved"))).df
    found = first_owned(heads, minima, lengths, longest or 0)
    chains = found.filter("f <= length").select("c", "f", "a")

    kids = chains.filter("a IS NOT NULL").groupBy(F.col("a").alias("owner"), (F.col("f") - 1).alias("d")).agg(F.count("*").alias("kids"))
    with_kids = minima.join(kids, ["owner", "d"], "left").withColumn("n_children", _long("kids") + (F.col("d") < F.col("length")).cast("long"))
    alone = stored(with_kids.select("owner", "d", "length", "n_convs", "n_children", "saved", (F.col("n_children") == 0).cast("long").alias("leaves"))).df
    own = alone.groupBy(F.col("owner").alias("c")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    summed = below(chains.join(own, "c"), ["leaves", "saved"])
    hung = summed.filter("a IS NOT NULL").join(chains.select("c", "f"), "c").groupBy(F.col("a").alias("owner"), (F.col("f") - 1).alias("d")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    tops = chains.select(F.col("c").alias("owner"), F.col("f").alias("d"), F.coalesce("a", F.lit(least)).alias("parent"))
    joined = alone.join(hung, ["owner", "d"], "left").join(tops, ["owner", "d"], "left")
    along = joined.select("owner", "d", F.coalesce("parent", "owner").alias("parent"), "n_convs", "n_children", (F.col("leaves") + _long("l")).alias("n_leaves"), (F.col("saved") + _long("s")).alias("saved_tokens"), (F.col("length") - F.col("d")).alias("up"))
    inner = running(along, "owner", "up", ["n_leaves", "saved_tokens"], longest or 0, block).drop("up")

    kids, leaves, saved = chains.filter("f = 1").count(), *own.agg(_long(F.sum("leaves")), _long(F.sum("saved"))).first()
    top = [(least, 0, None, count, kids, max(leaves, 1), saved)] if count else []
    root = spark.createDataFrame(top, "owner long, d long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    # a conversation ends at its chain's end, at its first owner's node if it owns nothing, or at the root without turns
    ends = found.select(F.when(F.col("length") == 0, F.lit(least)).when(F.col("f") <= F.col("length"), F.col("c")).otherwise(F.col("a")).alias("owner"), F.col("length").cast("long").alias("d"), "c")
    every = inner.unionByName(root).join(ends_digests(ends), ["owner", "d"], "left")
    return every.select(
        F.col("owner").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
