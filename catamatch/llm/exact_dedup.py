"""Exact deduplication against a history of digests under a minimal perfect hash.

Digests of normalised texts go to shards by their first bits.  ``history`` builds, for each
shard, a minimal perfect hash over the distinct digests seen before; a slot holds the full
digest, the locator of the row that won (its doc_id and length) and the number of rows.
``settle`` looks up the distinct digests of a new batch: a slot whose 32 bytes agree makes the
digest a member, whose repeats fall to the old or new winner; all others are grouped by
themselves.  Rows are combined per digest before any shuffle, so a group of copies of any size
reaches a shard as one row, and a shard is bounded by ``SHARD`` digests.

Defined results: a null text is the empty one; of equal texts the longest original, then the
smallest doc_id stays (a null doc_id loses to any other); rows that repeat a doc_id are one
document's rows, are counted each and marked alike; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catamatch.llm import mph
from catamatch.llm.common import BLANKS, pieces_of, texts
from catamatch.operators.stage import written

SHARD = 2048
_WON = "digest binary, n bigint, chars bigint, inverse bigint"


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, ""), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text without white space, chars of the original text."""
    return texts(docs).select("doc_id", _digest(F.col("text")).alias("digest"),
                              F.length("text").cast("long").alias("chars"))


def winners(rows: DataFrame) -> DataFrame:
    """Per digest: number of rows and the row that stays (longest, then smallest doc_id)."""
    best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("inverse")))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), best.alias("b")).select(
        "digest", "n", "b.chars", "b.inverse")


def _shard(digest: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def _keys(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)
    return both[:, 0], both[:, 1]


def history(known: DataFrame, shards: int) -> DataFrame:
    """Index of distinct digests with their winners: one row per shard."""
    def build(part: pd.DataFrame) -> pd.DataFrame:
        hi, lo = _keys(part["digest"].tolist())
        blob = mph.build(hi, lo)
        at = np.argsort(mph.slots(blob, hi, lo))
        # a winner without doc_id has no locator
        found = part["inverse"].notna().to_numpy()
        inverse = part["inverse"].fillna(0).astype(np.int64).to_numpy()
        return pd.DataFrame({
            "shard": part["shard"].iloc[:1], "hash": [blob],
            "held": [b"".join(part["digest"].iloc[at])],
            "n": [part["n"].to_numpy()[at].tolist()], "chars": [part["chars"].to_numpy()[at].tolist()],
            "inverse": [[v if f else None for v, f in zip(inverse[at].tolist(), found[at])]]})

    return known.withColumn("shard", _shard("digest", shards)).groupBy("shard").applyInPandas(
        build, "shard int, hash binary, held binary, n array<bigint>, chars array<bigint>, inverse array<bigint>")


def settle(new: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Distinct digests of history and batch with total rows and winner.

    Members combine both sides' counts and winners; nonmembers keep those of the batch.
    """
    def probe(part: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names = ["digest", "n", "chars", "inverse"]
        mine = part[names].astype({"inverse": "Int64"})
        if held.empty:
            return mine
        row = held.iloc[0]
        old = [row["held"][i:i + 32] for i in range(0, len(row["held"]), 32)]
        slots = mph.slots(row["hash"], *_keys(mine["digest"].tolist())) if len(mine) else []
        # the slot's whole digest decides
        member = [s >= 0 and old[s] == d for s, d in zip(slots, mine["digest"])]
        merged = pd.DataFrame({"digest": old, "n": row["n"], "chars": row["chars"],
                               "inverse": pd.array([None if v is None or v != v else int(v) for v in row["inverse"]],
                                                   dtype="Int64")})
        for s, hit, n, chars, inverse in zip(slots, member, mine["n"], mine["chars"], mine["inverse"]):
            if hit:
                merged.iat[s, 1] += n
                now = merged.iat[s, 3]
                low = -(1 << 63)
                if (chars, low if inverse is pd.NA else inverse) > (merged.iat[s, 2], low if now is pd.NA else now):
                    merged.iat[s, 2], merged.iat[s, 3] = chars, inverse
        return pd.concat([merged, mine[~np.array(member, bool)]])[names]

    left = new.withColumn("shard", _shard("digest", shards)).groupBy("shard")
    return left.cogroup(index.groupBy("shard")).applyInPandas(probe, _WON)


def exact_dedup(docs: DataFrame, earlier: Column, shard: int = SHARD) -> DataFrame:
    """Decisions for every row: doc_id, keep_id, group_size, kept, text_sha256.

    ``earlier`` marks the rows that arrived before and make up the history.
    """
    shards = pieces_of(docs.count(), shard)
    rows = written(digests(docs).withColumn("earlier", F.coalesce(earlier, F.lit(False))))
    index = written(history(winners(rows.where("earlier")), shards))
    settled = settle(winners(rows.where("not earlier")), index, shards).select(
        F.col("digest").alias("d"), F.col("n").alias("group_size"), F.bitwise_not("inverse").alias("keep_id"))
    return rows.join(settled, F.col("digest") == F.col("d")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def kept_documents(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: rows that are themselves kept, by doc_id and text."""
    kept = decisions.where("kept").select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__digest")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]) & (_digest(docs["text"]) == kept["__digest"]), "left_semi")
