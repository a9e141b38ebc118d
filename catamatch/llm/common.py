"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Blank and \t..\r, the white space of all contracts.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS, BATCH_ROWS = 64, 512


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) plus the named columns; all others are left behind."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def small_batches(spark) -> None:
    """Cuts the session's Arrow batches to ``BATCH_ROWS`` rows; a smaller setting stays."""
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(most)) <= BATCH_ROWS:
        spark.conf.set(most, str(BATCH_ROWS))


def map_slices(df: DataFrame, fn, schema: str, rows: int = ROWS) -> DataFrame:
    """Runs ``fn(columns) -> columns`` on slices of a few rows in the tasks that hold them.

    ``columns``: name -> list; strings arrive as UTF-8 bytes, arrays of numbers as numpy
    arrays, others as lists.  ``fn`` may return any number of
    rows.  Slices keep the memory of a worker near that of a few texts.  Arrow batches of the
    session are cut to ``BATCH_ROWS`` rows: ten thousand whole texts would fill an executor.
    """
    small_batches(df.sparkSession)
    spark_schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                cols = {}
                for name, col in zip(part.schema.names, part.columns):
                    if pa.types.is_list(col.type) and pa.types.is_primitive(col.type.value_type):
                        at, values = col.offsets.to_numpy(), col.values.to_numpy()
                        cols[name] = [values[a:b] for a, b in zip(at, at[1:])]
                        continue
                    if pa.types.is_string(col.type):
                        col = col.cast(pa.binary())
                    cols[name] = col.to_pylist()
                yield pa.RecordBatch.from_pydict(fn(cols), arrow)

    return df.mapInArrow(run, spark_schema)


def same(df: DataFrame, other: DataFrame, key: str = "doc_id", how: str = "left") -> DataFrame:
    """Join on one key where null equals null; the right side has one row per key."""
    right = other.withColumnRenamed(key, "__key")
    return df.join(right, df[key].eqNullSafe(right["__key"]), how).drop("__key")


def pieces_of(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def numbered(df: DataFrame, group: list[str], order: list[str], amount: Column, out: str,
             chunks: int, total: str | None = None) -> DataFrame:
    """Running total of ``amount`` before each row of its group, in some fixed order.

    A group may hold any share of the rows: it is dealt into ``chunks`` parts by a hash of the
    order columns, each summed by itself; the parts' totals are then added up.  Neither window
    sees more than a part or ``chunks`` rows.  ``total`` also names the group's sum.
    """
    part = df.withColumn("__chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    keys = [*group, "__chunk"]
    inside = W.partitionBy(*keys).orderBy(*order)
    part = part.withColumn("__own", F.sum(amount).over(inside.rowsBetween(W.unboundedPreceding, -1)))
    sums = df.withColumn("__chunk", F.pmod(F.xxhash64(*order), F.lit(chunks))).groupBy(*keys).agg(
        F.sum(amount).alias("__sum"))
    w = W.partitionBy(*group).orderBy("__chunk")
    sums = sums.select(
        *[F.col(c).alias("__k" + str(i)) for i, c in enumerate(keys)],
        F.coalesce(F.sum("__sum").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        *([F.sum("__sum").over(W.partitionBy(*group)).alias(total)] if total else []))
    on = [part[c].eqNullSafe(sums["__k" + str(i)]) for i, c in enumerate(keys)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = part.join(sums, cond, "left")
    return joined.withColumn(out, F.coalesce("__own", F.lit(0)) + F.col("__before")).drop(
        "__own", "__before", "__chunk", *["__k" + str(i) for i in range(len(keys))])
