"""Line deduplication with a sharded minimal perfect hash over distinct line hashes.

A line's key is the line without white space at both ends, A-Z lower-cased, hashed to 96 bits.
Distinct hashes are counted once (combined before the shuffle) and dealt to shards; a shard
holds a minimal perfect hash and, by slot, arrays of fingerprints, counts and largest doc_ids.
Documents send only their hashes to the shards and probe the arrays; line texts never move.

A hash that many documents hold would crowd its shard with probes.  Hashes of ``HOT`` documents or
more are at most one in ``HOT`` of all (document, line) pairs; they meet their documents in a join, where
adaptive execution splits the probes of one hash, and stay out of the shards.

Defined results: a null or empty text is one empty line; each row counts as a document, so rows
that repeat a doc_id count separately; the lines stay in every row of the largest doc_id that holds
them (a null doc_id is below all others); an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from catamatch.llm import mph
from catamatch.llm.common import map_slices, pieces_of, same, texts
from catamatch.operators.stage import written

LEAST_CHARS, LEAST_DOCS = 20, 3
SHARD = 4096
HOT = 1000


def line_hash(line: bytes, least_chars: int = LEAST_CHARS) -> bytes | None:
    """Twelve bytes for the line's key, None for a short one.  bytes.strip and lower know ASCII only."""
    key = line.strip().lower()
    if len(key) < least_chars or len(key) < 4 * least_chars and len(key.decode()) < least_chars:
        return None
    return hashlib.blake2b(key, digest_size=12).digest()


def line_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, h1, h2): the distinct line hashes of each row."""
    def run(cols):
        ids, keys = [], []
        for doc, text in zip(cols["doc_id"], cols["text"]):
            own = {line_hash(x, least_chars) for x in text.split(b"\n")} - {None}
            ids += [doc] * len(own)
            keys += own
        both = np.frombuffer(b"".join(keys), np.dtype([("h1", "<i8"), ("h2", "<i4")]))
        return {"doc_id": ids, "h1": both["h1"], "h2": both["h2"]}

    return map_slices(texts(docs), run, "doc_id bigint, h1 bigint, h2 int")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("h1", "h2"), F.lit(shards)).cast("int")


def _words(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return part["h1"].to_numpy(np.int64).view(np.uint64), part["h2"].to_numpy(np.int32).view(np.uint32).astype(np.uint64)


def build_index(counted: DataFrame, shards: int) -> DataFrame:
    """One row per shard: perfect hash and arrays of fingerprints, counts and largest doc_ids."""
    def build(part: pd.DataFrame) -> pd.DataFrame:
        hi, lo = _words(part)
        blob = mph.build(hi, lo)
        at = np.argsort(mph.slots(blob, hi, lo))
        return pd.DataFrame({
            "shard": part["shard"].iloc[:1], "hash": [blob],
            "prints": [part["h2"].to_numpy(np.int32)[at].tobytes()],
            "counts": [part["n"].to_numpy(np.int64)[at].tobytes()],
            "named": [part["last"].notna().to_numpy()[at].tobytes()],
            "last": [part["last"].fillna(0).to_numpy().astype(np.int64)[at].tobytes()]})

    return counted.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(
        build, "shard int, hash binary, prints binary, counts binary, named binary, last binary")


def probe(hashes: DataFrame, index: DataFrame, shards: int, least_docs: int) -> DataFrame:
    """Of the documents' hashes those whose lines go: common ones, except in their largest doc_id."""
    def look(part: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if part.empty or held.empty:
            return part[["doc_id", "h1", "h2"]].iloc[:0]
        row = held.iloc[0]
        at = mph.slots(row["hash"], *_words(part))
        prints, counts = np.frombuffer(row["prints"], np.int32), np.frombuffer(row["counts"], np.int64)
        known = (at >= 0) & (prints[at] == part["h2"].to_numpy())
        docs = part["doc_id"]
        named, last = np.frombuffer(row["named"], bool), np.frombuffer(row["last"], np.int64)
        mine = np.where(docs.isna(), ~named[at], named[at] & (docs.fillna(0).to_numpy().astype(np.int64) == last[at]))
        return part.loc[known & (counts[at] >= least_docs) & ~mine.astype(bool), ["doc_id", "h1", "h2"]]

    return hashes.withColumn("shard", _shard(shards)).groupBy("shard").cogroup(
        index.groupBy("shard")).applyInPandas(look, "doc_id bigint, h1 bigint, h2 int")


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
                   shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc_id and the hashes (12 bytes each) of the lines it loses."""
    hashes = written(line_hashes(docs, least_chars))
    pairs = hashes.count()
    shards = pieces_of(pairs, shard)
    counted = written(hashes.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")))
    index = written(build_index(counted.where(F.col("n") < hot), shards))
    marked = hashes.join(counted.where(F.col("n") >= hot), ["h1", "h2"], "left")
    cold = marked.where("n is null").select("doc_id", "h1", "h2")
    found = probe(cold, index, shards, least_docs).unionByName(
        marked.where((F.col("n") >= least_docs) & ~F.col("doc_id").eqNullSafe(F.col("last"))).select("doc_id", "h1", "h2"))
    return found.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))


def without_lines(docs: DataFrame, lost: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """All columns of the documents with the text cut, plus n_lines and n_dropped."""
    @pandas_udf("text string, n_lines bigint, n_dropped bigint")
    def cut(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        out = []
        for t, a, b in zip(text, h1, h2):
            lines = t.encode().split(b"\n")
            kept = lines
            if a is not None:
                gone = {int(x).to_bytes(8, "little", signed=True) + int(y).to_bytes(4, "little", signed=True)
                        for x, y in zip(a, b)}
                kept = [x for x in lines if line_hash(x, least_chars) not in gone]
            out.append((b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    joined = same(docs, lost.withColumnRenamed("lost", "__lost"))
    done = joined.withColumn("__cut", cut(F.coalesce("text", F.lit("")), F.col("__lost.h1"), F.col("__lost.h2")))
    return done.select(*[F.col("__cut.text").alias(c) if c == "text" else F.col(c) for c in docs.columns],
                       F.col("__cut.n_lines").alias("n_lines"), F.col("__cut.n_dropped").alias("n_dropped"))


def line_dedup(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, text without the repeated lines, n_lines (before) and n_dropped."""
    return without_lines(docs.select("doc_id", "text"), repeated_lines(docs, **settings))
