"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines that hold words. The gram at a line is the shortest run of lines from there with
GRAM words; among the grams that start within WINDOW words of a line, the one with the least hash is a fingerprint (all of
them on ties). Two runs of equal lines with GRAM + WINDOW - 1 words or more therefore share a fingerprint,
wherever they stand. Positions of a fingerprint are joined, and a match is extended from it both ways: to the left by the lines back to each
line whose window it is the least gram of, to the right by lines up to MIN_WORDS words. Such a stretch, told apart by
its fingerprint, the fingerprint's place in it and two hashes of its lines, that is not the first one of its kind in the corpus (least
doc_id, then text, then line) is deleted. A run of MIN_WORDS words or more that stands at any earlier place consists
of such stretches, and each has its fingerprint inside, so every one is deleted whole, whichever other places share its
fingerprints. Blank lines inside a deleted run go with it. Every deleted line has an equal one at an earlier place.

A line's length counts as WINDOW words at most when windows are laid out, so that a long line has a window
of its own.

Scale: hashes of lines are shuffled (about 30 bytes a line), then fingerprints, then the line hashes and the stretches
(two a line at most, beside pairs of long lines) of documents that share one; whole texts are shuffled once, in the last join. Places are not paired: a
passage or a group of copies costs in proportion to its size. First places are aggregated before
shuffling and joined back, so a hot line is split by skew handling. All steps are built-in expressions.

Defined cases: null text stays null, empty text stays empty; a document whose lines all repeat keeps an empty
text; rows equal in key and text are one document and are treated alike; null keys come first; an empty table gives
no rows; other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable

GRAM, WINDOW, MIN_WORDS = 25, 26, 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def documents_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """d, t (hash of the text), and of its lines that hold words: i (numbers), h (hashes), w (word counts)."""
    each = F.transform(_lines(F.col(text)), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    rows = docs.filter(F.col(text) != "").select(F.col(key).alias("d"), F.xxhash64(text).alias("t"), F.filter(each, lambda x: x["w"] > 0).alias("l"))
    rows = rows.select("d", "t", F.col("l.i").alias("i"), F.col("l.h").alias("h"), F.col("l.w").alias("w"))
    return rows.groupBy("d", "t").agg(*[F.first(c).alias(c) for c in ("i", "h", "w")])


def fingerprints(rows: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """d, t, j (place among the lines with words), g (hash of the gram there) of the windows' least grams."""
    lines = rows.select("d", "t", F.posexplode(F.arrays_zip("h", "w")).alias("j", "l")).select("d", "t", "j", F.col("l.h").alias("h"), F.col("l.w").cast("long").alias("w"))
    doc = Window.partitionBy("d", "t")
    held = F.least(F.col("w"), F.lit(window))
    lines = lines.withColumn("at", F.sum(held).over(doc.orderBy("j")) - held)
    by = doc.orderBy("at")
    ahead = by.rangeBetween(0, gram - 1)
    lines = lines.withColumn("words", F.sum("w").over(ahead)).withColumn("hs", F.collect_list("h").over(ahead))
    grams = lines.select("d", "t", "j", "at", F.when(F.col("words") >= gram, F.xxhash64("hs")).alias("g"))
    grams = grams.withColumn("least", F.min("g").over(by.rangeBetween(0, window - 1)))
    # a gram is the least of some window if and only if it is the greatest of its windows' least ones
    return grams.withColumn("top", F.max("least").over(by.rangeBetween(1 - window, 0))).filter("g = top").select("d", "t", "j", "g")


def stretches(rows: DataFrame, prints: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """d, t, j, a, b and what tells them apart (KIND) of fingerprints extended both ways to min_words words.

    j: first place among the lines with words; a, b: line numbers. Stretches begin at a line whose window the fingerprint is the least of: from
    each line and up to each line the shortest one of min_words words, and two neighbours that have as many each. Any
    run of min_words words is made up of stretches inside it, which hold all its lines and all pairs of neighbours."""
    lines = rows.select("d", "t", F.posexplode(F.arrays_zip("i", "h", "w")).alias("j", "l")).select("d", "t", "j", "l.i", "l.h", F.col("l.w").cast("long").alias("w"))
    places = prints.select(F.col("d").alias("pd"), F.col("t").alias("pt"), F.col("j").alias("pj"), "g")
    lines = lines.join(places, F.col("d").eqNullSafe(F.col("pd")) & (F.col("t") == F.col("pt")) & (F.col("j") == F.col("pj")), "left")
    doc = Window.partitionBy("d", "t")
    held = F.least(F.col("w"), F.lit(window))
    lines = lines.withColumn("end", F.sum("w").over(doc.orderBy("j"))).withColumn("from", F.col("end") - F.col("w")).withColumn("at", F.sum(held).over(doc.orderBy("j")) - held)
    mine = F.min(F.when(F.col("g").isNotNull(), F.struct("g", F.col("j").alias("p")))).over(doc.orderBy("at").rangeBetween(0, window - 1))
    lines = lines.withColumn("print", mine)
    sides = [doc.orderBy("from").rangeBetween(0, min_words - 1), doc.orderBy("end").rangeBetween(1 - min_words, 0), doc.orderBy("j").rowsBetween(0, 1)]

    def stretch(w) -> Column:
        hashes = F.collect_list("h").over(w)
        return F.struct(
            F.min(F.struct("j", "print")).over(w).alias("first"), F.max("j").over(w).alias("k"), F.min("i").over(w).alias("a"), F.max("i").over(w).alias("b"),
            F.xxhash64(hashes).alias("x"), F.xxhash64(F.lit(1), hashes).alias("y"), F.sum("w").over(w).alias("words"), F.min("w").over(w).alias("least"),
        )

    lines = lines.select("d", "t", *[stretch(w).alias(f"s{n}") for n, w in enumerate(sides)])
    pair = F.when((F.col("s2.first.j") < F.col("s2.k")) & (F.col("s2.least") >= min_words), F.col("s2"))
    some = F.array_distinct(F.filter(F.array("s0", "s1", pair), lambda s: s.isNotNull() & (s["words"] >= min_words)))
    found = lines.select("d", "t", F.explode(some).alias("s"))
    return found.select("d", "t", F.col("s.first.j").alias("j"), "s.a", "s.b", F.col("s.first.print.g").alias("g"), (F.col("s.first.print.p") - F.col("s.first.j")).alias("left"), "s.x", "s.y")


#: Fingerprint, its place in the stretch, two hashes of the lines.
KIND = ["g", "left", "x", "y"]


def repeated_runs(rows: DataFrame, gram: int = GRAM, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """d, t, runs: array<struct<a, b>> of line numbers that repeat earlier ones, for documents that have any."""
    if gram + window - 1 > min_words:
        raise ValueError("runs of min_words words need not have a fingerprint")
    prints = durable(fingerprints(rows, gram, window))
    place = F.struct("d", "t", "j")
    several = lambda x, by: x.groupBy(*by).agg(F.min(place).alias("f"), F.max(place).alias("z")).filter("f != z").drop("z")
    sharing = durable(prints.join(several(prints, ["g"]).select("g"), "g", "left_semi"))
    whose = sharing.select(F.col("d").alias("xd"), F.col("t").alias("xt")).distinct()
    held = durable(stretches(rows.join(whose, F.col("d").eqNullSafe(F.col("xd")) & (F.col("t") == F.col("xt")), "left_semi"), sharing, window, min_words).filter("g IS NOT NULL"))
    later = held.join(several(held, KIND), KIND).filter(F.struct("d", "t", "j") != F.col("f"))
    return later.groupBy("d", "t").agg(F.collect_set(F.struct("a", "b")).alias("runs"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW, min_words: int = MIN_WORDS, removed: str | None = None) -> DataFrame:
    """docs with later repeated runs of lines deleted from text; with `removed`, also the number of lines deleted."""
    rows = durable(documents_lines(docs, key, text))
    runs = durable(repeated_runs(rows, gram, window, min_words)).toDF("__d", "__t", "__runs")
    joined = docs.join(runs, F.col(key).eqNullSafe(F.col("__d")) & (F.xxhash64(text) == F.col("__t")), "left")
    kept = F.filter(_lines(F.col(text)), lambda _, i: ~F.exists("__runs", lambda r: (i >= r["a"]) & (i <= r["b"])))
    joined = joined.withColumn("__kept", F.when(F.col("__runs").isNotNull(), kept))
    gone = F.when(F.col("__runs").isNotNull(), F.size(_lines(F.col(text))) - F.size("__kept")).otherwise(0)
    out = {c: F.col(c) for c in docs.columns} | {text: F.when(F.col("__runs").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col(text))}
    return joined.select(*[c.alias(n) for n, c in out.items()], *([gone.alias(removed)] if removed else []))
