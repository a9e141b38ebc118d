"""Substring deduplication: a count-min prefilter, then exact groups of what it lets through.

A window is 50 consecutive words.  Of the eight-word grams inside it, the one of smallest hash
(the first at ties) stands for the window, so equal windows have equal grams, and neighbouring
windows mostly share one: a maximal run of windows with the same gram occurrence is one row.

First pass: count-min rows of counters over the grams, each document adding one a gram; partitions
sum their own sketches (the map side of the aggregation) and the partial sketches are merged by
counter.  A window's documents are never more than the smallest counter of its gram, so dropping
runs with a counter below two loses no repeated window.  The counters' number grows with the runs.

Second pass, exact, on what is left: runs are grouped by (gram, hash of all words the run's windows
cover).  In every document but the first of such a group all windows of the run are covered.  The
first one's windows can still stand in other groups of the same gram, with other words around;
only these are written out one by one, as (gram, hash of the window), and grouped for their
first document.  Both hashes together have 128 bits.  A common passage is combined before every
shuffle, so no task meets all its copies.

Defined results: null, empty and short texts have no windows; a word is removed if any covered window
holds it; rows that repeat a doc_id are one document and do not cover each other, but each is cut by its
own text; a null doc_id counts as the largest; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from catamatch.llm.common import map_slices, texts
from catamatch.llm.words import runs, span_hashes, word_hashes
from catamatch.operators.stage import written

WINDOW, GRAM = 50, 8
ROWS, COUNTERS = 2, 8
_LAST = (1 << 63) - 1


def gram_runs(words: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(gram hash, hash of the words covered, first window, last window) of every run, as arrays."""
    n = len(words) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none
    grams = runs(words, gram)
    width = window - gram + 1
    # smallest high half first, then the earlier position
    ranked = grams >> np.uint64(32) << np.uint64(32) | np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(ranked) // width)
    padded = np.full(blocks * width, 0xFFFFFFFFFFFFFFFF, np.uint64)
    padded[:len(ranked)] = ranked
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    last = np.concatenate([first[1:], [n]]) - 1
    return grams[at[first]].view(np.int64), span_hashes(words, first, last + window).view(np.int64), first, last


def document_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id, text_hash (of the row) and its runs as four arrays."""
    def run(cols):
        found = [gram_runs(word_hashes(t), window, gram) for t in cols["text"]]
        return {"id": cols["id"], "text_hash": cols["text_hash"], "g": [f[0] for f in found], "c": [f[1] for f in found],
                "s": [f[2].astype(np.int32) for f in found], "e": [f[3].astype(np.int32) for f in found]}

    rows = texts(docs).select(*_key(), "text")
    return map_slices(rows, run, "id bigint, text_hash bigint, g array<bigint>, c array<bigint>, s array<int>, e array<int>")


def _key() -> list[Column]:
    """id (doc_id, null as the largest) says which document is earlier; with text_hash it names the row."""
    return [F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("text_hash")]


def _counter(row: int, width: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(row), "g"), F.lit(width)).alias("counter")


def sketch(found: DataFrame, row: int, width: int) -> DataFrame:
    """One row of the merged sketch: counters of two documents or more."""
    grams = found.select(F.explode(F.array_distinct("g")).alias("g"))
    return grams.groupBy(_counter(row, width)).agg(F.count("*").alias("n")).where("n > 1").select("counter")


def survivors(found: DataFrame, rows: int = ROWS, counters: int = COUNTERS) -> DataFrame:
    """(id, text_hash, g, c, s, e): runs whose gram has two documents or more by every row of the sketch."""
    width = max(1024, counters * (found.agg(F.sum(F.size("g"))).first()[0] or 0))
    left = found.select("id", "text_hash", F.explode(F.arrays_zip("g", "c", "s", "e")).alias("r")).select("id", "text_hash", "r.*")
    for row in range(rows):
        left = left.withColumn("counter", _counter(row, width)).join(
            written(sketch(found, row, width)), "counter", "left_semi").drop("counter")
    return left


def windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(id, text_hash, g, h, at) of every single window of the wanted runs (id, text_hash, g, s, e)."""
    per = wanted.groupBy("id", "text_hash").agg(F.collect_set(F.struct("g", "s", "e")).alias("r"))
    rows = texts(docs).select(*_key(), "text").join(per, ["id", "text_hash"]).select(
        "id", "text_hash", "text", "r.g", "r.s", "r.e")

    def run(cols):
        out = {"id": [], "text_hash": [], "g": [], "h": [], "at": []}
        for doc, key, text, g, s, e in zip(*[cols[c] for c in ("id", "text_hash", "text", "g", "s", "e")]):
            words = word_hashes(text)
            order = np.argsort(s, kind="stable")
            at = np.concatenate([np.arange(a, b + 1) for a, b in zip(s[order], e[order])])
            out["id"].append(np.full(len(at), doc))
            out["text_hash"].append(np.full(len(at), key))
            out["g"].append(np.repeat(g[order], e[order] - s[order] + 1))
            out["h"].append(span_hashes(words, at, at + window).view(np.int64))
            out["at"].append(at.astype(np.int32))
        return {k: np.concatenate(v) if v else [] for k, v in out.items()}

    return map_slices(rows, run, "id bigint, text_hash bigint, g bigint, h bigint, at int")


def covered(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, rows: int = ROWS, counters: int = COUNTERS) -> DataFrame:
    """id, text_hash and spans, the (first, last) windows of the row that an earlier document holds too."""
    left = written(survivors(written(document_runs(docs, window, gram)), rows, counters))
    groups = written(left.groupBy("g", "c").agg(F.min("id").alias("first")))
    marked = left.join(groups, ["g", "c"])
    whole = marked.where("id > first").select("id", "text_hash", "s", "e")

    # written, so that the join shuffles both sides by itself and a common gram can be split there
    several = written(groups.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
    alone = written(windows(docs, marked.where("id = first").join(several, "g", "left_semi"), window))
    earliest = alone.groupBy("g", "h").agg(F.min("id").alias("first"), F.max("id").alias("top")).where("first < top")
    single = alone.join(earliest, ["g", "h"]).where("id > first").select(
        "id", "text_hash", F.col("at").alias("s"), F.col("at").alias("e"))
    return whole.unionByName(single).groupBy("id", "text_hash").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, **settings) -> DataFrame:
    """doc_id, text of the kept words joined by blanks, n_words and n_removed."""
    @pandas_udf("text string, n_words bigint, n_removed bigint")
    def cut(text: pd.Series, s: pd.Series, e: pd.Series) -> pd.DataFrame:
        out = []
        for t, first, last in zip(text, s, e):
            words = t.encode().split()
            n = len(words)
            if first is not None:
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, first, 1)
                np.add.at(change, np.asarray(last) + window, -1)
                words = [w for w, gone in zip(words, np.cumsum(change[:n])) if not gone]
            out.append((b" ".join(words).decode(), n, n - len(words)))
        return pd.DataFrame(out, columns=["text", "n_words", "n_removed"])

    spans = covered(docs, window, **settings)
    rows = texts(docs).select("doc_id", *_key(), "text").join(spans, ["id", "text_hash"], "left")
    done = rows.select("doc_id", cut("text", F.col("spans.s"), F.col("spans.e")).alias("c"))
    return done.select("doc_id", "c.text", "c.n_words", "c.n_removed")
