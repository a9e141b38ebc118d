"""Key lookups, tables of rules, ladders and intervals.

No lookup forces a broadcast of a table that can grow: Spark measures the side at run time
and broadcasts it when small; otherwise it is a shuffle join, where the lookup side is unique
per key and a hot key of the other side is split by adaptive execution.  Only tables with a
size fixed in the rules are broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rule_table(spark, rows, schema: str) -> DataFrame:
    """Fixed rule rows as a broadcast table; the size is that of the rule list."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def unique_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last one in table order."""
    cols = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
    return last.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left lookup; rows without a match keep NULLs."""
    return df.join(table, key, "left")


def existing(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return df.join(table.select(key), key, "left_semi")


def missing(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return df.join(table.select(key), key, "left_anti")


def first_existing(df: DataFrame, ids: list[str], keys: str, table: DataFrame, key: str,
                   out: str) -> DataFrame:
    """First entry of the array ``keys`` that the table holds, NULL if none does."""
    tried = df.select(*ids, F.posexplode(keys).alias("_pos", key))
    found = existing(tried, table, key).groupBy(*ids).agg(F.min_by(key, "_pos").alias(out))
    return df.join(found, ids, "left")


def _ladder(ladder: DataFrame, keys, cap, code) -> DataFrame:
    """Distinct steps: the smallest code of each capacity."""
    return ladder.where(F.col(cap).isNotNull()).groupBy(*keys, cap).agg(F.min(code).alias(code))


def _range(value: Column) -> Column:
    """Number of a value range that rises with the value: 64 ranges for each doubling."""
    return F.when(value > 0, F.floor(F.log2(value) * 64)).otherwise(-100_000).cast("int")


def nearest_above(wants: DataFrame, ladder: DataFrame, keys: list[str], want: str, cap: str, code: str) -> DataFrame:
    """Smallest step >= the wanted value within the keys, plus the largest step.

    Wanted values and steps are merged into one list per key, read downward with a running
    minimum, so no (wanted, step) pairs are formed and the work is linear.  A key is cut into
    value ranges: a window over the ranges' smallest steps carries the next step above a range
    into it, and the other window never leaves its range.  Returns one row per distinct
    (keys, want): fit, fit_code, top.
    """
    steps = _ladder(ladder, keys, cap, code)
    merged = steps.select(*keys, F.col(cap).cast("double").alias("_v"),
                          F.struct(F.col(cap).alias("c"), F.col(code).alias("k")).alias("_step")
                          ).unionByName(
        wants.select(*keys, F.col(want).cast("double").alias("_v")).distinct()
        .withColumn("_w", F.lit(True)), allowMissingColumns=True)
    # a wanted value equal to a step up to rounding error still takes that step
    merged = merged.withColumn("_near", F.round("_v", 6)).withColumn("_range", _range(F.col("_near")))
    sums = merged.groupBy(*keys, "_range").agg(F.min("_step").alias("_low"), F.max("_step.c").alias("_high"))
    above = W.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias("_k" + k) for k in keys], F.col("_range").alias("_r"),
                       F.min("_low").over(above).alias("_next"), F.max("_high").over(W.partitionBy(*keys)).alias("top"))
    on = merged["_range"] == sums["_r"]
    for k in keys:
        on = on & merged[k].eqNullSafe(sums["_k" + k])
    inside = W.partitionBy(*keys, "_range").orderBy(F.desc("_near")).rangeBetween(W.unboundedPreceding, W.currentRow)
    fit = F.coalesce(F.col("_own"), F.col("_next"))
    return (merged.join(sums, on).withColumn("_own", F.min("_step").over(inside)).withColumn("_fit", fit)
            .where("_w").select(*keys, F.col("_v").alias(want), F.col("_fit.c").alias("fit"),
                                F.col("_fit.k").alias("fit_code"), "top"))


nearest_above_window = nearest_above


def round_up(value: Column, steps) -> Column:
    """STRUCT<step, clamped>: smallest step >= value; the largest one, marked, beyond them."""
    v = value.try_cast("double")
    ladder = F.array(*[F.lit(float(s)) for s in sorted(steps)])
    fit = F.array_min(F.filter(ladder, lambda s: s >= v))
    top = F.lit(float(max(steps)))
    return F.when(v.isNotNull(), F.struct(F.coalesce(fit, top).alias("step"),
                                          fit.isNull().alias("clamped")))


def bucket(value: Column, buckets) -> Column:
    """Label of the half-open bucket (lo, hi] that holds the value."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(buckets):
        out = F.when((value > lo) & (value <= hi), label).otherwise(out)
    return out


def bucket_join(df: DataFrame, buckets: DataFrame, value: str) -> DataFrame:
    """Left range join with a fixed table (lo, hi, label) of half-open, disjoint buckets."""
    inside = (F.col(value) > F.col("lo")) & (F.col(value) <= F.col("hi"))
    return df.join(buckets, inside, "left").drop("lo", "hi")


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], point: str,
                  lo: str, hi: str, radix: int = 16, levels: int = 16) -> DataFrame:
    """Containment join as an equality: pairs with lo <= point <= hi (integers).

    An interval is covered by aligned blocks of widths 1, radix, radix^2, ...; a point lies
    in exactly one block per width.  Joining on (keys, width, block) meets each containing
    interval once and no other one.  Sixteen levels of radix 16 span all 64-bit lengths, so an
    interval becomes at most 30 blocks a level, whatever its length.
    """
    def span(a, b, level):
        return F.when(a <= b, F.transform(F.sequence(a, b), lambda x: F.struct(
            F.lit(level).alias("level"), x.alias("block")))).otherwise(
            F.array().cast("array<struct<level:int,block:bigint>>"))

    def inside(width):
        return (F.ceil(F.col(lo) / width).cast("long"),
                F.floor((F.col(hi) + 1) / width).cast("long"))

    pieces = []
    for level in range(levels):
        width = radix ** level
        a, b = inside(width)
        if level == levels - 1:
            pieces.append(span(a, b - 1, level))
            continue
        wide_a, wide_b = (x * radix for x in inside(width * radix))
        pieces.append(F.when(wide_a < wide_b, F.concat(span(a, wide_a - 1, level),
                                                       span(wide_b, b - 1, level)))
                      .otherwise(span(a, b - 1, level)))
    covered = intervals.withColumn("_block", F.explode(F.concat(*pieces)))
    asked = points.withColumn("_block", F.explode(F.array(*[
        F.struct(F.lit(l).alias("level"), F.floor(F.col(point) / radix ** l).cast("long").alias("block"))
        for l in range(levels)])))
    return asked.join(covered, [*keys, "_block"]).drop("_block")
