"""Joins of points to intervals.

A condition like ``low < x AND x <= high`` has no key, so Spark would compare every row with every row. Here each interval of
whole numbers is cut into its dyadic blocks (2 for each power of two at most, none overlapping), each point names the
block that it lies in on every level that occurs, and block and level are the key of an ordinary join: shuffled,
spilled, and dealt anew by adaptive execution where many points share a block. A point meets each interval that holds
it once, and no row has to be checked again. Intervals may be of any length, overlap and nest.

Spark sizes a side by its files, before points are repeated for each level, and would broadcast the points of a table
that is small on disk. So the join is named here: a few blocks of intervals are broadcast, more are merged.

Where only the number of points in each interval is asked for, no pair is made: pairs grow with the product of both sides.
Points are counted by value, counts summed from the least value up, and an interval has the sum at its high end
less that before its low end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_LEVELS = 62
#: Blocks of intervals that are sent to every executor; more are shuffled.
MOST_SENT = 10_000
#: Bits of a value that one window of running sums goes over, so that none has more than 65,536 rows, and the levels of windows for all 64.
DIGIT, DIGITS = 16, 4


def dyadic_blocks(low: Column, high: Column) -> Column:
    """The blocks (level, block) that make up the whole numbers from ``low`` to ``high``, both included; none where one is null or high is less.

    From the smallest blocks up: an end that does not fill a block of the next size gives off its own.
    """
    kind = "array<struct<level: int, block: long>>"
    start = F.struct(low.cast("long").alias("a"), high.cast("long").alias("b"), F.array().cast(kind).alias("out"))

    def step(s: Column, level: Column) -> Column:
        a, b, open_ = s["a"], s["b"], s["a"] <= s["b"]
        one = lambda x: F.struct(level.cast("int").alias("level"), x.alias("block"))
        left, right = open_ & (F.pmod(a, F.lit(2)) == 1), open_ & (F.pmod(b, F.lit(2)) == 0)
        both = left & right & (a == b)
        out = F.concat(s["out"], F.when(left, F.array(one(a))).otherwise(F.array().cast(kind)), F.when(right & ~both, F.array(one(b))).otherwise(F.array().cast(kind)))
        return F.struct(F.when(open_, F.shiftright(F.when(left, a + 1).otherwise(a), 1)).otherwise(F.lit(1).cast("long")).alias("a"),
                        F.when(open_, F.shiftright(F.when(right, b - 1).otherwise(b), 1)).otherwise(F.lit(0).cast("long")).alias("b"), out.alias("out"))

    blocks = F.aggregate(F.sequence(F.lit(0), F.lit(MOST_LEVELS)), start, step, lambda s: s["out"])
    return F.when(low <= high, blocks).otherwise(F.array().cast(kind))


def interval_join(points: DataFrame, value: str, intervals: DataFrame, low: str, high: str) -> DataFrame:
    """The rows of ``points`` with those of ``intervals`` whose low..high (whole numbers, both included) holds their value; columns of both, which must differ."""
    cut = intervals.withColumn("_cut", F.explode(dyadic_blocks(F.col(low), F.col(high)))).select(*intervals.columns, F.col("_cut.level").alias("_level"), F.col("_cut.block").alias("_block"))
    held = {r["_level"]: r["count"] for r in cut.groupBy("_level").count().collect()}  # MOST_LEVELS + 1 at most
    levels = list(held)
    named = points.withColumn("_at", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(F.col(value).cast("long"), k).alias("block")) for k in levels)))) if levels else points.withColumn("_at", F.lit(None).cast("struct<level: int, block: long>"))
    named = named.select(*points.columns, F.col("_at.level").alias("_level"), F.col("_at.block").alias("_block"))
    return named.join(cut.hint("broadcast" if sum(held.values()) <= MOST_SENT else "merge"), ["_level", "_block"]).drop("_level", "_block")


def running_sums(counts: DataFrame, levels: int = DIGITS) -> DataFrame:
    """``counts`` (_at, each value once, and _n) with _upto, the sum of _n over all values up to it: sums inside blocks of values, and those of the blocks before them in the same way."""
    so_far = lambda w: F.sum("_n").over(w.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    if levels == 1:  # one window: the blocks of the last level are 65,536 at most
        return counts.withColumn("_upto", so_far(Window))
    blocks = counts.groupBy(F.shiftright("_at", DIGIT).alias("_at")).agg(F.sum("_n").alias("_n"))
    before = running_sums(blocks, levels - 1).select(F.col("_at").alias("_block"), (F.col("_upto") - F.col("_n")).alias("_before"))
    inside = counts.withColumn("_block", F.shiftright("_at", DIGIT)).withColumn("_inside", so_far(Window.partitionBy("_block")))
    return inside.join(before.hint("merge"), "_block").select("_at", "_n", (F.col("_before") + F.col("_inside")).alias("_upto"))


def interval_counts(points: DataFrame, value: str, intervals: DataFrame, low: str, high: str, key: str) -> DataFrame:
    """key, n: how many rows interval_join has for each ``key`` of ``intervals``, without making them; keys with none are left out."""
    end = lambda name, upper: F.struct(F.col(name).cast("long").alias("_at"), F.lit(upper).alias("_upper"))
    ends = intervals.where(F.col(low) <= F.col(high)).select(F.col(key), F.explode(F.array(end(low, False), end(high, True))).alias("_end")).select(key, "_end._at", "_end._upper")
    marks = points.select(F.col(value).cast("long").alias("_at"), F.lit(1).cast("long").alias("_n")).where("_at IS NOT NULL")
    marks = marks.unionAll(ends.select("_at", F.lit(0).cast("long").alias("_n")))
    # never null, also by its type: else each level's join puts its own test for nulls below the counts, and they are counted once a level
    counts = marks.groupBy(F.coalesce("_at", F.lit(0).cast("long")).alias("_at")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"))
    met = ends.join(running_sums(counts).hint("merge"), "_at")
    held = F.sum(F.when(F.col("_upper"), F.col("_upto")).otherwise(F.col("_n") - F.col("_upto")))
    return met.groupBy(key).agg(held.alias("n")).where("n > 0")
