"""Joins by time: the last value at a moment, and pairs of intervals that overlap.

Both spread one key's rows over time. As-of: rows of a key are dealt by bins of time, the last value inside a bin comes from a window over
(key, bin), and what a bin inherits from the bins before it from a window over one row a key and bin.

Overlaps: an interval lies at the level whose bins are the first ones at least as wide as it is, widths doubling from level to level, so it touches
two bins there at most. Of two intervals that overlap the one at the lower level looks up the other at the higher one's
level, in the bin in which the later one starts: an interval is repeated twice a level at most, however long it is, and a pair is
found once. The joins are equi-joins on (key, level, bin), so a key of many rows spreads over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins that the span of time is dealt into, if no width is given.
BINS = 1024
#: Levels above the narrowest bins: no interval of 64-bit microseconds needs more.
LEVELS = 62


def _micros(c: Column, kind: str) -> Column:
    return F.unix_micros(c.cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else c.cast("long")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str, width: int | None = None) -> DataFrame:
    """Left rows with last_<value>: the value of the last right row of the same key at or before their time.

    Right rows without a key, time or value take no part; of those with one time the greatest value counts. Left rows
    without a key or time get null. width: of a bin, in microseconds for times, else in units of `at`."""
    name, kind = f"last_{value}", left.schema[at].dataType.typeName()
    last = right.filter(F.col(by).isNotNull() & F.col(at).isNotNull()).groupBy(by, at).agg(F.max(value).alias("__value")).filter("__value IS NOT NULL")
    moment = _micros(F.col(at), kind)
    if width is None:
        low, high = left.select(at).union(last.select(at)).agg(F.min(moment), F.max(moment)).first()
        width = max(1, -(-((high or 0) - (low or 0)) // BINS))
    cut = lambda df: df.withColumn("__bin", F.expr("__moment div " + str(width)))
    none, side = F.lit(None).cast(right.schema[value].dataType), F.lit
    l = cut(left.withColumn("__moment", moment)).withColumn("__value", none).withColumn("__side", side(1))
    r = cut(last.withColumn("__moment", moment))
    rows = l.unionByName(r.withColumn("__side", side(0)), allowMissingColumns=True)
    inside = Window.partitionBy(by, "__bin").orderBy("__moment", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__own", F.last("__value", ignorenulls=True).over(inside)).filter("__side = 1")
    # one row a key and bin: what the bins before it leave
    bins = r.groupBy(by, "__bin").agg(F.max_by("__value", "__moment").alias("__v")).unionByName(l.select(by, "__bin").distinct().withColumn("__v", none))
    each = bins.groupBy(by, "__bin").agg(F.max("__v").alias("__v"))
    before = Window.partitionBy(by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.withColumn("__before", F.last("__v", ignorenulls=True).over(before)).filter("__before IS NOT NULL").select(by, "__bin", "__before")
    joined = found.join(carried, [by, "__bin"], "left")
    return joined.select(*left.columns, F.when(F.col("__moment").isNotNull() & F.col(by).isNotNull(), F.coalesce("__own", "__before")).alias(name))


def _levelled(df: DataFrame, key: Column, by: Column, start: Column, end: Column, width: int, p: str) -> DataFrame:
    """key, by, start, end and level of intervals that hold a moment."""
    rows = df.select(key.alias(f"{p}_key"), by.alias(f"{p}_by"), start.alias(f"{p}_start"), end.alias(f"{p}_end")).filter(f"{p}_by IS NOT NULL AND {p}_start < {p}_end")
    length = rows.withColumn("__length", F.col(f"{p}_end") - F.col(f"{p}_start") - 1)
    level = F.expr(f"aggregate(sequence(0, {LEVELS}), {LEVELS}, (least, n) -> if(n < least AND shiftright(__length, n) < {width}, n, least))")
    return length.withColumn(f"{p}_level", level).drop("__length")


def _bins(rows: DataFrame, levels: Column, width: int, p: str) -> DataFrame:
    """rows once for each bin that they touch at each of the levels: two a level at most."""
    at = rows.withColumn("level", F.explode(levels))
    first, last = F.expr(f"shiftright({p}_start div {width}, level)"), F.expr(f"shiftright(({p}_end - 1) div {width}, level)")
    return at.withColumn("bin", F.explode(F.sequence(first, last)))


def overlaps(a: DataFrame, b: DataFrame, by: tuple[str, str], key: tuple[str, str], start: tuple[str, str], end: tuple[str, str], width: int | None = None) -> DataFrame:
    """a_key, b_key, by: pairs of intervals of one key that share a moment; an interval holds its start but not its end.

    Starts and ends are times, dates or numbers. No end: the interval goes on for ever; no start or key, or an end at or before the
    start: it meets nothing. width: of the narrowest bins, in microseconds for times; a typical length if not given."""
    sides = []
    for df, k in ((a, 0), (b, 1)):
        kind = df.schema[start[k]].dataType.typeName()
        sides.append(df.select(F.col(key[k]).alias("k"), F.col(by[k]).alias("by"), _micros(F.col(start[k]), kind).alias("s"), _micros(F.col(end[k]), kind).alias("e")).filter("s IS NOT NULL"))
    both = sides[0].select("s", "e").union(sides[1].select("s", "e"))
    low, high, typical = both.agg(F.min("s"), F.max(F.greatest(F.col("s") + 1, F.coalesce("e", F.col("s") + 1))), F.percentile_approx(F.col("e") - F.col("s"), 0.5)).first()
    if low is None:
        low, high = 0, 1
    width = width or max(1, typical or 1)
    # moments count from the first start; an open interval ends with the last one
    begin, stop = F.col("s") - low, F.least(F.coalesce("e", F.lit(high)), F.lit(high)) - low
    x, y = (_levelled(df, F.col("k"), F.col("by"), begin, stop, width, p) for df, p in zip(sides, "ab"))
    found = None
    for lower, upper, p, q, same in ((x, y, "a", "b", True), (y, x, "b", "a", False)):  # equal levels meet in the first turn
        least = F.col(f"{p}_level") if same else F.col(f"{p}_level") + 1
        levels = sorted(r[0] for r in upper.select(f"{q}_level").distinct().collect())  # LEVELS numbers at most
        probes = _bins(lower, F.filter(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"), lambda n: n >= least), width, p)
        homes = _bins(upper, F.array(f"{q}_level"), width, q).withColumnsRenamed({"level": "home", "bin": "home_bin"})
        met = probes.join(homes, (F.col("a_by") == F.col("b_by")) & (F.col("level") == F.col("home")) & (F.col("bin") == F.col("home_bin")))
        here = F.expr(f"shiftright(greatest(a_start, b_start) div {width}, level)") == F.col("bin")
        pairs = met.filter((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & here).select("a_key", "b_key", F.col("a_by").alias("by"))
        found = pairs if found is None else found.union(pairs)
    return found


def valid_during(points: DataFrame, facts: DataFrame, by: tuple[str, str], key: tuple[str, str], at: str, start: str, end: str, width: int | None = None) -> DataFrame:
    """a_key, b_key, by: points in time with the facts in force then: open ends count, the end itself does not."""
    kind = points.schema[at].dataType.typeName()
    moment = points.withColumn("__at", _micros(F.col(at), kind)).withColumn("__then", F.col("__at") + 1)
    kind = facts.schema[start].dataType.typeName()
    spans = facts.withColumn("__s", F.coalesce(_micros(F.col(start), kind), F.lit(-(1 << 61)))).withColumn("__e", _micros(F.col(end), kind))
    return overlaps(moment, spans, by, key, ("__at", "__s"), ("__then", "__e"), width)
