"""Document fingerprints: one-permutation MinHash with optimal densification, low-order bits packed.

Each distinct word shingle of a text is hashed once.  The hash's high bits name one of ``BINS``
bins, the rest is its value; a bin keeps its smallest value.  An empty bin takes the value of the
first non-empty one among bins that a hash of (its number, attempt) names, the same for every
text, which keeps collisions unbiased (optimal densification).  Of each bin the low ``BITS`` bits
of the mixed value are packed.  Two unequal values agree in them by chance with probability
2^-BITS; the likeness corrects for that.

Defined results: a text of fewer words than a shingle is one shingle; a null, empty or blank text
has the fingerprint of all zero bits, like only to another such text (likeness 1, else 0); equal
texts have equal fingerprints; repeated rows each get theirs; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from catamatch.llm.common import map_slices, small_batches, texts
from catamatch.llm.words import mix, runs, word_hashes
from catamatch.operators.stage import written

BINS, BITS, SHINGLE = 256, 8, 5
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(4096)
def _donors(attempt: int, bins: int) -> np.ndarray:
    """The bin that each bin asks in its n-th attempt when it is empty, the same for every text."""
    return (mix(np.arange(bins, dtype=np.uint64) + np.uint64(attempt << 32)) % np.uint64(bins)).astype(np.int64)


def fingerprint(text: bytes, bins: int = BINS) -> bytes:
    """``bins`` bytes, the low eight bits of each bin; empty for a text without words."""
    words = word_hashes(text, lower=True)
    if not len(words):
        return b""
    hashes = np.sort(mix(runs(words, min(SHINGLE, len(words)))))
    shift = np.uint64(64 - (bins - 1).bit_length())
    owner = (hashes >> shift).astype(np.int64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    values = np.full(bins, _FULL)
    values[owner[first]] = hashes[first] & ((np.uint64(1) << shift) - np.uint64(1))
    filled = values != _FULL
    empty, attempt = np.flatnonzero(~filled), 1
    held = values.copy()
    while len(empty):
        donor = _donors(attempt, bins)[empty]
        found = filled[donor]
        held[empty[found]] = values[donor[found]]
        empty, attempt = empty[~found], attempt + 1
    return (mix(held) & np.uint64((1 << BITS) - 1)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of two fingerprints, corrected for chance agreement, in 0..1."""
    if not a or not b:
        return float(a == b)
    same = np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / len(a)
    chance = 2.0 ** -BITS
    return max(0.0, (same - chance) / (1 - chance))


def shown(print_: bytes, bins: int = BINS) -> str:
    return (print_ or bytes(bins)).hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex) of every whole text."""
    def run(cols):
        return {"doc_id": cols["doc_id"], "fingerprint": [shown(fingerprint(t)) for t in cols["text"]]}

    return map_slices(texts(docs), run, "doc_id bigint, fingerprint string")


def with_following(docs: DataFrame, fn, schema: str, parts: int | None = None) -> DataFrame:
    """``fn(doc_id, text, next) -> row`` for every document, texts as UTF-8 bytes.

    ``next`` is the text of the next document in descending doc_id (after the last, the first); a null
    doc_id comes last, equal ones are ordered by a hash of the text.  Texts are shuffled once, into
    ranges of that order (``parts`` of them, else as many as the session shuffles to), and a task reads its
    sorted range as a stream that holds one row.  The last row of a range is left open; its text meets the
    first text of the range after it in a join of one row a range.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    rows = texts(docs)
    placed = rows.repartitionByRange(parts, *key) if parts else rows.repartitionByRange(*key)
    placed = placed.sortWithinPartitions(*key, "text").select("doc_id", "text", F.spark_partition_id().alias("part"))
    result = StructType.fromDDL(schema)
    edges = StructType.fromDDL("__id bigint, __part int, __head binary, __tail binary")
    out = StructType([*result.fields, *edges.fields])
    arrow, blank = to_arrow_schema(out), (None,) * len(result)

    def stream(batches):
        before, done = None, []
        for batch in batches:
            ids, own, at = batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2)
            for i in range(batch.num_rows):
                text = own[i].as_py()
                if before is None:
                    done.append((*blank, None, at[i].as_py(), text, None))
                else:
                    done.append((*fn(before[0], before[1], text), None, None, None, None))
                before = ids[i].as_py(), text, at[i].as_py()
            yield _batch(done, arrow)
            done = []
        if before:
            yield _batch([(*blank, before[0], before[2], None, before[1])], arrow)

    def close(cols):
        made = [fn(*r) for r in zip(cols["__id"], cols["__tail"], cols["__next"])]
        return {f.name: [m[i] for m in made] for i, f in enumerate(result)}

    read = written(placed.mapInArrow(stream, out))
    heads = read.where("__head is not null").select(F.col("__part").alias("part"), F.col("__head").alias("__next"))
    tails = read.where("__tail is not null").select("__id", "__part", "__tail")
    # one row a range: the range after each, after the last the first
    order = W.orderBy("__part")
    after = tails.select("__part").select("__part", F.coalesce(
        F.lead("__part").over(order), F.min("__part").over(W.partitionBy())).alias("part"))
    open_ = tails.join(after, "__part").join(heads, "part").select("__id", "__tail", "__next")
    return read.where("__part is null").select(*result.names).unionByName(map_slices(open_, close, schema))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, text and the text of the next document (see ``with_following``)."""
    return with_following(docs, lambda *row: row, "doc_id bigint, text string, next string", parts)


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """Code points of the text, and the text with its last floor(n/3) ones replaced by as many first ones of the next."""
    own = text.decode("utf-8", "surrogateescape")
    n = len(own)
    # a code point has four bytes at most
    start = following[:4 * (n // 3) + 4].decode("utf-8", "ignore")[:n // 3]
    return n, (own[:n - n // 3] + start).encode("utf-8", "surrogateescape")


def edited_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form (see ``edited``), and their likenesses."""
    held: dict = {}

    def run(doc_id, text, following):
        # the next row of a range is the document that was just read as the following one
        own = held["print"] if held.get("text") == text else fingerprint(text)
        held["text"], held["print"] = following, fingerprint(following)
        n, other = edited(text, following)
        changed = fingerprint(other)
        return (doc_id, n, hashlib.sha256(other).digest(), own or bytes(BINS), changed or bytes(BINS),
                likeness(own, changed), likeness(own, held["print"]))

    made = with_following(docs, run, "doc_id bigint, n_chars bigint, sha binary, print binary, other binary, "
                                     "near_edited double, near_next double", parts)
    return made.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), F.lower(F.hex("print")).alias("fingerprint"),
                       F.lower(F.hex("other")).alias("edited_fingerprint"), "near_edited", "near_next")
