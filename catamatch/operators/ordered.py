"""Operators over row order that stay spread out when one group holds most of the rows.

A plain window over (document) puts a whole document into one task.  Here the last order
column is an integer position, unique within the columns before it, so cutting it every
``CHUNK_ROWS`` positions bounds every chunk by that many rows.  Each operator aggregates per
chunk (combined map-side), runs a window over the small chunk summaries, and joins the
carried value back to the rows, whose own window then never leaves its chunk.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catamatch.operators.stage import written

CHUNK_ROWS = 1 << 16
_CHUNK = "_chunk"


def _chunked(df: DataFrame, order: list[str], chunk_rows: int) -> DataFrame:
    return df.withColumn(_CHUNK, F.expr(f"`{order[-1]}` div {chunk_rows}"))


def _scan(df, group, order, summary, over_summaries, local, combine, out, chunk_rows):
    """Chunk summaries -> window over them -> join back -> window inside the chunk."""
    rows = _chunked(df, order, chunk_rows)
    within = [*group, *order[:-1], _CHUNK]
    sums = rows.groupBy(*within).agg(summary.alias("_sum"))
    before = W.partitionBy(*group).orderBy(*order[:-1], _CHUNK)
    carried = sums.select(*within, over_summaries(F.col("_sum"), before).alias("_carry"))
    inside = W.partitionBy(*within).orderBy(order[-1])
    keys = {c: f"_k{i}" for i, c in enumerate(within)}
    carried = carried.select(*[F.col(c).alias(k) for c, k in keys.items()], "_carry")
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]  # NULL groups carry values too
    joined = rows.join(carried, reduce(and_, on), "left").drop(*keys.values())
    return (joined.withColumn(out, combine(local(inside), F.col("_carry")))
            .drop(_CHUNK, "_carry"))


def last_before(df: DataFrame, group: list[str], order: list[str], value: Column, out: str,
                chunk_rows: int = CHUNK_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """Last non-null ``value`` on an earlier row of the group (carry-forward).

    A group of at most ``chunk_rows`` rows is one window partition, only larger ones are cut into chunks.
    sizes: a table with at least the rows of df that is cheaper to count.
    """
    large = large_groups(df if sizes is None else sizes, group, chunk_rows)
    return last_before_beside(df, group, order, value, out, large, chunk_rows)


def large_groups(df: DataFrame, group: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame | None:
    """The keys of the groups of more than ``chunk_rows`` rows as _g0, _g1, ..., None without such a group."""
    counts = df.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]).count()
    large = written(counts.where(F.col("count") > chunk_rows).drop("count"))
    return None if large.isEmpty() else large


def last_before_beside(df: DataFrame, group: list[str], order: list[str], value: Column, out: str,
                       large: DataFrame | None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``last_before`` with the large groups known: only they are cut into chunks."""
    pos = F.col(order[-1])
    earlier = (W.unboundedPreceding, -1)
    whole = F.last(value, ignorenulls=True).over(W.partitionBy(*group).orderBy(*order).rowsBetween(*earlier))
    if large is None:
        return df.withColumn(out, whole)
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)])
    return df.join(large, on, "left_anti").withColumn(out, whole).unionByName(_scan(
        df.join(large, on, "left_semi"), group, order,
        F.max_by(value, F.when(value.isNotNull(), pos)),
        lambda s, w: F.last(s, ignorenulls=True).over(w.rowsBetween(*earlier)),
        lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(*earlier)),
        lambda own, carry: F.coalesce(own, carry), out, chunk_rows))


def previous(df: DataFrame, group: list[str], order: list[str], value: Column, out: str,
             chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``value`` of the row just before in the group, NULL on the first row."""
    pos = F.col(order[-1])
    boxed = F.struct(value.alias("v"))
    return _scan(
        df, group, order, F.max_by(boxed, pos),
        lambda s, w: F.lag(s).over(w), lambda w: F.lag(boxed).over(w),
        lambda own, carry: F.coalesce(own, carry)["v"], out, chunk_rows)


def running_total(df: DataFrame, group: list[str], order: list[str], value: Column, out: str,
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Sum of ``value`` up to and including the row, in group order."""
    return _scan(
        df, group, order, F.sum(value),
        lambda s, w: F.coalesce(F.sum(s).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        lambda w: F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)),
        lambda own, carry: F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0)), out, chunk_rows)


def row_numbers(df: DataFrame, group: list[str], order: list[str], out: str,
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """1-based row number in group order."""
    return running_total(df, group, order, F.lit(1).cast("long"), out, chunk_rows)


def range_numbers(df: DataFrame, group: list[str], order: list, out: str) -> DataFrame:
    """1-based row number in the order of any sort key, written once.

    The rows are cut by range of (group, order) at sampled quantiles, so a group of any size is numbered by
    many tasks: each counts its own rows of a group, and the counts of the ranges before are added.
    Only the counts, one a group and range, meet in one window.
    """
    key = [*[F.col(c) for c in group], *[F.col(c) if isinstance(c, str) else c for c in order]]
    placed = written(df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy(*group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(group)], F.col("_range").alias("_r"), "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(group)] + [F.col("_range") == F.col("_r")])
    return placed.join(written(counts), on).select(
        *df.columns, (F.col("_at") - F.col("_first") + 1 + F.col("_before")).alias(out))


def first_per_group(df: DataFrame, group: list[str], order: list, n: int, out: str = "rn",
                    slices: int | None = None) -> DataFrame:
    """The first ``n`` rows of every group with their rank.

    Up to a few hundred rows Spark cuts each map task's rows itself before the shuffle.  For
    a larger ``n`` pass ``slices``: every group is first cut to ``n`` rows in each of that
    many hash slices, so the last step sees at most ``n * slices`` rows of a group.
    """
    if slices:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(slices))
        part = W.partitionBy(*group, "_slice").orderBy(*order)
        df = (df.withColumn("_slice", salt).withColumn("_r", F.row_number().over(part))
              .where(F.col("_r") <= n).drop("_slice", "_r"))
    return (df.withColumn(out, F.row_number().over(W.partitionBy(*group).orderBy(*order)))
            .where(F.col(out) <= n))
