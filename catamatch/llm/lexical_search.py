"""Ranked lexical search by bags: equal documents are scored once.

A document's bag holds the items' terms that it contains, with their counts; everything else about it
that a score needs is one number m.  Documents with equal m and equal bags form a class: they meet by a
hash and are told apart by the whole bag.  A class goes on with its ten (k) smallest doc_ids, which are
the only ones of it that can be among an item's first ten, since all its members score the same.

1. One pass over the texts: terms, length and bag of every document.  Number and length of documents and
   the documents of each term are sums of what every task has counted.
2. Classes: each map task keeps the k smallest doc_ids of its classes before the shuffle.
3. Every task scores its classes against all items, expands members by ascending doc_id and returns its own
   first k documents of each item; the first k of these are the result.

The items' terms go to the tasks as one table of at most ``TERMS`` distinct terms and ``CELLS`` (term, item)
cells; more items are dealt to several such passes by a hash.

Defined results: a null text has no terms; an item without terms has no rows; items are distinct pairs of
item_id and text; rows that repeat a doc_id are documents of their own; a null doc_id comes after all others;
empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catamatch.llm.common import map_slices, pieces_of, texts
from catamatch.operators.ordered import first_per_group
from catamatch.operators.stage import written

FIRST, TERMS, CELLS = 10, 1 << 18, 1 << 21
_SCALE, _BM_K, _BM_B = 1_000_000_000, 1000, 75
_LAST, _LOW = (1 << 63) - 1, (1 << 26) - 1
#: Bytes that are in terms stay (A-Z in lower case), all others become a blank; bytes from 0x80 up are in terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(raw: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order."""
    return raw.translate(_TERM_BYTES).split()


class Items:
    """Items of one pass: which term is wanted how often by which item."""

    def __init__(self, rows: list[tuple[int | None, bytes]]):
        self.names = [r[0] for r in rows]
        counts = [Counter(terms(r[1])) for r in rows]
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
        cells = sorted((self.vocabulary[t], i, n) for i, c in enumerate(counts) for t, n in c.items())
        term, self.item, self.times = (np.array(x, np.int64) for x in zip(*cells)) if cells else [np.zeros(0, np.int64)] * 3
        self.starts = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))

    def scores(self, ids: np.ndarray, values: np.ndarray, at: np.ndarray, classes: int) -> np.ndarray:
        """(class, item) scores: ``values`` are what term ``ids`` add in class ``at``."""
        sizes = self.starts[ids + 1] - self.starts[ids]
        cell = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[ids], sizes)
        place = np.repeat(at, sizes) * len(self.names) + self.item[cell]
        gain = np.repeat(values, sizes) * self.times[cell]
        # two sums of doubles, each exact, make one of 64-bit integers
        low, high = [np.bincount(place, x, classes * len(self.names)).astype(np.int64) for x in (gain & _LOW, gain >> 26)]
        return ((high << 26) + low).reshape(classes, -1)


def bags(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n (all terms) and bag: (term, count) pairs of 32 bits each, ascending by term."""
    def run(cols):
        out = {"doc_id": cols["doc_id"], "n": [], "bag": []}
        get = items.vocabulary.get
        for raw in cols["text"]:
            own = terms(raw)
            out["n"].append(len(own))
            ids = np.array([i for i in map(get, own) if i is not None], np.int64)
            found, times = np.unique(ids, return_counts=True)
            out["bag"].append(np.stack([found, times], axis=1).astype("<u4").tobytes())
        return out

    return map_slices(texts(docs), run, "doc_id bigint, n bigint, bag binary")


def document_counts(found: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of ``size`` terms; every task adds up its own rows first."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for bag in batch["bag"].to_pylist():
                total[np.frombuffer(bag, "<u4")[::2]] += 1
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": held, "df": total[held]})

    out = np.zeros(size, np.int64)
    for r in found.select("bag").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def classes(found: DataFrame, documents: int, length: int, k: int) -> DataFrame:
    """m, bag and the k smallest doc_ids (null as the largest) of every class of documents with a bag."""
    m = 100 - _BM_B + F.expr(f"({_BM_B} * n * {documents}L) div {max(1, length)}L")
    rows = found.where("length(bag) > 0").select(m.alias("m"), "bag", F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"))
    rows = rows.withColumn("h", F.xxhash64("m", "bag"))
    firsts = first_per_group(rows, ["h", "m", "bag"], ["doc_id"], k)
    return firsts.groupBy("h", "m", "bag").agg(F.array_sort(F.collect_list("doc_id")).alias("members")).drop("h")


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def task_firsts(found: DataFrame, items: Items, weight: np.ndarray, k: int) -> DataFrame:
    """item (number), doc_id, score: the first k documents of each item among a task's classes."""
    def run(batches):
        best = pd.DataFrame({"item": [], "doc_id": [], "score": []}, dtype=np.int64)
        floor = np.zeros(len(items.names), np.int64)  # an item's score at place k so far
        rows = max(1, min(256, (1 << 20) // len(items.names)))
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                raw = part["bag"].to_pylist()
                pairs = np.frombuffer(b"".join(raw), "<u4").astype(np.int64).reshape(-1, 2)
                at = np.repeat(np.arange(len(raw)), [len(b) // 8 for b in raw])
                ids, times = pairs[:, 0], pairs[:, 1]
                m = part["m"].to_numpy()[at]
                values = weight[ids] * ((_SCALE * times) // (_BM_K * times + 8 * m))
                scores = items.scores(ids, values, at, len(raw))
                row, item = np.nonzero((scores > 0) & (scores >= floor))
                if not len(row):
                    continue
                members = part["members"].to_pylist()
                sizes = np.array([len(x) for x in members])
                flat, starts = np.concatenate([np.array(x, np.int64) for x in members]), np.cumsum(sizes) - sizes
                n = sizes[row]
                cell = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[row], n)
                new = pd.DataFrame({"item": np.repeat(item, n), "doc_id": flat[cell], "score": np.repeat(scores[row, item], n)})
                best = pd.concat([best, new]).sort_values(["item", "score", "doc_id"], ascending=[True, False, True])
                best = best.groupby("item").head(k)
                full = best[best.groupby("item").cumcount() == k - 1]
                floor[full["item"]] = full["score"]
        yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return found.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = FIRST, most_terms: int = TERMS, most_cells: int = CELLS) -> DataFrame:
    """item_id, rank, doc_id, score: the first k documents of every item."""
    spark = docs.sparkSession
    asked = written(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct())
    # how many items a pass can take: a text of n bytes has at most n / 2 + 1 terms
    size = asked.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    passes = pieces_of(math.ceil(size), min(most_terms, most_cells))
    results = []
    for p in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).collect()
        own = Items(sorted([(r["item_id"], r["text"].encode()) for r in rows], key=repr))
        found = written(bags(docs, own))
        sums = found.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
        if not own.vocabulary or not sums["length"]:
            continue
        weight = weights(document_counts(found, len(own.vocabulary)), sums["documents"])
        groups = classes(found, sums["documents"], sums["length"], k)
        firsts = task_firsts(groups, own, weight, k)
        ranked = first_per_group(firsts, ["item"], [F.desc("score"), "doc_id"], k, "rank")
        names = spark.createDataFrame([(i, n) for i, n in enumerate(own.names)], "no bigint, item_id bigint")
        results.append(written(ranked.join(F.broadcast(names), F.col("item") == F.col("no")).select(
            "item_id", "rank", F.nullif("doc_id", F.lit(_LAST)).alias("doc_id"), "score")))
    if not results:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
