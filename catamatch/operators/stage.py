"""Intermediate tables that several branches of a plan read."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def _local_master(spark: SparkSession) -> bool:
    """True only for local and local[...]; local-cluster has executors of its own."""
    return re.match(r"local(\[|$)", spark.conf.get("spark.master", "")) is not None


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder in spark.checkpoint.dir; a temporary one only in local mode without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not _local_master(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="catamatch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_owned: ContextVar[list | None] = ContextVar("owned", default=None)


@contextmanager
def owned_tables(spark: SparkSession):
    """Owns the tables that ``written`` makes inside the block and removes them at its end, also after an error.

    Results built from them must be consumed (collected, or written elsewhere) inside the block.  An inner
    block owns its own tables only; tables written outside any block stay until their folder's owner removes them.
    """
    paths: list[str] = []
    token = _owned.set(paths)
    try:
        yield
    finally:
        _owned.reset(token)
        conf = spark._jsc.hadoopConfiguration()
        for path in paths:
            made = spark._jvm.org.apache.hadoop.fs.Path(path)
            made.getFileSystem(conf).delete(made, True)


#: HotSpot interprets longer methods for good, however often they run.
COMPILED_BYTES = 8000


def compilable(spark: SparkSession) -> None:
    """Lets the session fuse the operators of a stage only where the generated method can be compiled; a smaller limit stays."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(limit)) > COMPILED_BYTES:
        spark.conf.set(limit, str(COMPILED_BYTES))


def written(df: DataFrame) -> DataFrame:
    """Writes the table once and reads it back.

    The lineage ends in files that outlive any executor, each branch reads only its own
    columns, and derived columns are evaluated once instead of being inlined into every
    filter and join condition above them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    if (paths := _owned.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_facts(df: DataFrame, key: str, values: DataFrame, facts) -> DataFrame:
    """Joins ``facts(distinct values)``: what depends on a column alone is evaluated once for each of its values.

    key: a column of df without nulls; values: a table that holds all its values under the same name.
    """
    return df.join(written(facts(values.select(key).distinct())), key)
