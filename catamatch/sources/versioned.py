"""Tables that outlive a run: immutable parts under a manifest that is replaced atomically.

A table is a folder of part folders and numbered manifests.  A run writes its parts first and then the
next manifest, which names all valid parts; the rename into place fails where another run has taken that
number.  So a run that dies leaves only parts that nobody reads, a reader always sees one whole version,
and of two runs that collide the later one looks again at what the other has added.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catamatch.operators.stage import written

_NAME = "manifest-{:09d}.json"


class VersionedTable:
    """Parts by key (a slot of the sink, or the part's own name) in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), StructType.fromDDL(schema)
        self._hadoop = spark._jvm.org.apache.hadoop
        conf = spark._jsc.hadoopConfiguration()
        root = self._hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(conf)
        self._fs.mkdirs(root)
        self._context = self._hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(root).toUri(), conf)

    def _at(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """Number of the latest manifest, 0 without any."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop.fs.Path(self.path))]
        return max([int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Key -> part folder of a version (the latest one)."""
        version = self.version() if version is None else version
        if not version:
            return {}
        text = self.spark.read.text(f"{self.path}/{_NAME.format(version)}", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, parts: dict[str, str] | None = None) -> DataFrame:
        """The rows of the named parts (all valid ones)."""
        parts = self.manifest() if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in sorted(set(parts.values()))])

    def write_part(self, df: DataFrame, by: str | None = None) -> str:
        """Writes rows that no manifest names yet, where asked into a folder for each value of a column."""
        name = f"part-{uuid.uuid4().hex}"
        writer = df.select(*self.schema.names, *([by] if by else [])).write
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}")
        return name

    def commit(self, parts: dict[str, str], after: int) -> bool:
        """Makes ``parts`` the version that follows ``after``; False where another run was there first."""
        temporary, final = self._at(f"_writing-{uuid.uuid4().hex}"), self._at(_NAME.format(after + 1))
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        out.close()
        kind = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        no_overwrite = self.spark.sparkContext._gateway.new_array(kind, 1)
        no_overwrite[0] = kind.NONE
        try:
            self._context.rename(temporary, final, no_overwrite)
        except Exception:  # noqa: BLE001
            if self.version() <= after:
                raise
            self._fs.delete(temporary, False)
            return False
        return True


def process_new(table: VersionedTable, contents: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of ``contents`` with the outcome of their content, which is computed once for all runs.

    contents: any columns plus ``content``; table and process(hash, content) have ``hash`` and the
    outcome's columns.  Only contents whose hash no earlier run has stored are processed.  NULL is a content.
    """
    keyed = contents.withColumn("hash", F.coalesce(F.sha2("content", 256), F.lit("null")))
    distinct = keyed.select("hash", "content").dropDuplicates(["hash"])
    version = table.version()
    known = table.manifest(version)
    fresh = process(distinct.join(table.read(known).select("hash"), "hash", "left_anti"))
    part = table.write_part(fresh)
    while not table.commit({**known, part: part}, version):
        # what another run has stored meanwhile is its own
        version = table.version()
        known = table.manifest(version)
        added = table.read({part: part}).join(table.read(known).select("hash"), "hash", "left_anti")
        part = table.write_part(added)
    done = table.read({**known, part: part})
    return keyed.drop("content").join(done.withColumnRenamed("hash", "_hash"), F.col("hash") == F.col("_hash"), "left").drop("_hash")


#: Documents of a slot of the sink: neighbours by number.
SLOT_DOCS = 1 << 16


def replace_documents(table: VersionedTable, rows: DataFrame, order: list[str], slot_docs: int = SLOT_DOCS,
                      documents: DataFrame | None = None) -> None:
    """Puts the rows of this run's documents in place of what the table holds of them.

    ``order`` begins with the document's number.  Slots are neighbouring documents; only the slots of this
    run's documents are written anew, all in one pass that is cut by range of ``order`` and sorted, so the
    order holds inside and across the files of a slot, and slots follow one another by key.  A rerun leaves
    the same rows.  ``documents`` (one column) names documents that now have no rows.
    """
    doc, names = order[0], table.schema.names
    slot = F.lpad(F.expr(f"CAST(`{doc}` div {slot_docs} AS STRING)"), 20, "0")
    rows = written(rows.select(*names))
    run = rows.select(doc) if documents is None else rows.select(doc).unionByName(documents.select(F.col(documents.columns[0]).alias(doc)))
    run = written(run.distinct())
    touched = [r[0] for r in run.select(slot).distinct().collect()]
    while True:
        version = table.version()
        parts = table.manifest(version)
        old = {k: parts.pop(k) for k in touched if k in parts}
        both = rows.unionByName(table.read(old).join(run, doc, "left_anti").select(*names)).withColumn("_slot", slot)
        both = written(both)
        name = table.write_part(both.repartitionByRange(*order).sortWithinPartitions("_slot", *order), by="_slot")
        parts |= {r[0]: f"{name}/_slot={r[0]}" for r in both.select("_slot").distinct().collect()}
        if table.commit(parts, version):
            return
