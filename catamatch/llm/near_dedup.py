"""Near-duplicate classes by min-max hashing, confirmed on full shingle sets.

Each permutation of a document's shingle hashes gives two signature values, its minimum and its
maximum, so half as many permutations as values are evaluated.  Values are banded; documents that
share a band are candidates.  With 24 bands of 4 values a pair of similarity 0.85 shares none with
probability 2e-8, one of 0.8 with 3e-6.

Then, without ever listing the pairs of a group:

1. Documents with equal sets form a class, known by its smallest doc_id; only classes go on.  Where
   a doc_id repeats with different sets and is the smallest of several classes, all but one of these
   are known by a hash of the set from ``_OTHER`` up, so that each class has links of its own; so are
   classes without any doc_id.
2. A shingle that no other candidate holds can be in no intersection.  From their number follows
   a bound on the similarity of a class to any other one; classes below the threshold leave, and
   pairs below it are not looked at.  This is exact.
3. Every class is compared with the centre of each of its bands, the class with the least share of shingles of
   its own: one edge a class and band.  Edges are confirmed on the full sets and their components found.
4. Classes that still share a band across different components are compared too, where the bound of step 2
   and the differences from the band's centre allow a link.  Two classes are the nearer to each other the more
   of their differences from the centre they have in common, and these are at most the differences that some
   class of another component has as well, which one count a centre and shingle finds.  The bound is exact, so
   no link between different texts is lost that a band shows.

Components are found by alternating star contractions, a written table a round; nothing of
document size goes to the driver, and skewed bands and classes meet only in joins that adaptive
execution splits.

Defined results: a text of fewer words than a shingle is one shingle; a null, empty or blank text
has no set and no links; a component is named by the smallest doc_id in it, and the rows that bear
this doc_id are kept; rows that repeat a doc_id are judged each by its own text; a document without
doc_id is linked like any other but names nothing (a component without any doc_id has none, and all its rows
are kept); empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catamatch.llm.common import map_slices, same, texts
from catamatch.llm.words import mix, shingle_set, word_hashes
from catamatch.operators.stage import written

SHINGLE, PERMUTATIONS, BAND_VALUES = 5, 48, 4
PERCENT = 80
_SLICE = 4096
_OTHER = 1 << 62
#: The least of these in a band is its centre.
_CENTRE = "struct((n - m) / n AS own, rep, n, m)"
_RANDOM = np.random.Generator(np.random.PCG64(5))
_FACTORS = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), _SLICE):
        values = shingles[None, at:at + _SLICE] * _FACTORS[:, None] + _SHIFTS[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.concatenate([low, high])


def bands(values: np.ndarray) -> np.ndarray:
    """One uint64 a band, different for different bands; each mixes minima and maxima of other permutations."""
    rows = values.reshape(BAND_VALUES, -1)
    out = np.arange(rows.shape[1], dtype=np.uint64)
    for row in rows:
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + row)
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (with doc_id it names the row), n_shingles, set_hash (of the whole set), bands."""
    def run(cols):
        out = {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"], "n_shingles": [], "set_hash": [], "bands": []}
        for text in cols["text"]:
            found = shingle_set(word_hashes(text, lower=True), SHINGLE)
            out["n_shingles"].append(len(found))
            out["set_hash"].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            out["bands"].append(bands(signature(found)).view(np.int64) if len(found) else [])
        return out

    return map_slices(texts(docs, _text_hash()), run,
                      "doc_id bigint, text_hash bigint, n_shingles bigint, set_hash binary, bands array<bigint>")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def classes(found: DataFrame) -> DataFrame:
    """set_hash, name (the smallest doc_id of the class), own (text_hash of a row that bears it) and rep, which no other class has."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("f")
    named = written(found.where("n_shingles > 0").groupBy("set_hash").agg(first).select(
        "set_hash", F.col("f.doc_id").alias("name"), F.col("f.text_hash").alias("own")))
    several = named.groupBy("name").agg(F.count("*").alias("c"), F.min("set_hash").alias("__set")).where("c > 1")
    several = several.where("name is not null").select("name", "__set")
    other = F.shiftrightunsigned(F.xxhash64("set_hash"), 2).bitwiseOR(F.lit(_OTHER))
    plain = F.col("name").isNotNull() & (F.coalesce("__set", "set_hash") == F.col("set_hash"))
    return written(named.join(several, "name", "left").select(
        "set_hash", "name", "own", F.when(plain, F.col("name")).otherwise(other).alias("rep")))


def full_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep and its sorted shingles, for the named rows (doc_id, text_hash, rep) only."""
    def run(cols):
        return {"rep": cols["rep"], "shingles": [
            shingle_set(word_hashes(t, lower=True), SHINGLE).view(np.int64) for t in cols["text"]]}

    rows, named = texts(docs, _text_hash()), reps.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "rep")
    wanted = rows.join(named, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))
    wanted = wanted.select("rep", "text").dropDuplicates(["rep"])
    return map_slices(wanted, run, "rep bigint, shingles array<bigint>")


def possible(percent: int, a: str = "a", b: str = "b") -> Column:
    """Whether two classes can reach the threshold: m counts the shingles that others hold too."""
    return (F.least(f"{a}.m", f"{b}.m") * (100 + percent)) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * percent


def close_enough(percent: int, a: str = "a", b: str = "b") -> Column:
    """Whether the differences from a common centre allow the threshold.

    ``far`` counts the shingles that a class and the centre do not share, ``common`` those of them that a class
    of another component differs in as well.  The distance of two classes is the sum of their ``far`` less twice
    the differences they have in common.
    """
    least = F.col(f"{a}.far") + F.col(f"{b}.far") - 2 * F.least(f"{a}.common", f"{b}.common")
    return least * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)


def beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) with their full sets x and y; two sets at a time, inside the JVM."""
    left = sets.select(F.col("rep").alias("u"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rep").alias("v"), F.col("shingles").alias("y"))
    return pairs.join(left, "u").join(right, "v")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that reach the threshold on their full sets."""
    both = F.size(F.array_intersect("x", "y")).cast("long")
    rows = beside(pairs, sets).select("u", "v", (F.size("x") + F.size("y")).alias("every"), both.alias("both"))
    return rows.where(F.col("both") * 100 >= (F.col("every") - F.col("both")) * percent).select("u", "v")


def differences(around: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, far and common for classes u around centres v, given with the label of u's component."""
    differ = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    found = written(beside(around, sets).select("u", "v", "label", differ.alias("differ")))
    each = found.select("u", "v", "label", F.explode("differ").alias("s"))
    several = each.groupBy("v", "s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    common = each.join(written(several.select("v", "s")), ["v", "s"], "left_semi").groupBy("u", "v").agg(
        F.count("*").alias("common"))
    return written(found.select("u", "v", F.size("differ").cast("long").alias("far")).join(common, ["u", "v"], "left")
                   .fillna(0, ["common"]))


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node it reaches, for every node of the edges (u, v)."""
    def turned(e):
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def state(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now = state(e)
    while True:
        # large star: the larger neighbours of a node go to its smallest one
        both = turned(e)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u")
        e = written(e.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            e.select("u", F.col("m").alias("v"))).distinct())
        before, now = now, state(e)
        if now == before:
            break
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return written(e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots))


def open_pairs(rows: DataFrame, labels: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of different components in a band of rows (rep, band, key, n, m) that may reach the threshold."""
    rows = same(rows, labels.withColumnRenamed("node", "rep"), "rep").withColumn("label", F.coalesce("label", "rep"))
    open_ = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.expr(_CENTRE)).alias("c"))
    open_ = written(open_.where("lo < hi").select("key", F.col("c.rep").alias("v")))
    rows = written(rows.join(open_, "key").join(reps, "rep").withColumn(
        "before", F.slice("bands", F.lit(1), F.col("band"))).drop("bands"))
    bounds = differences(written(rows.select(F.col("rep").alias("u"), "v", "label").distinct()), sets)
    rows = written(rows.withColumnRenamed("rep", "u").join(bounds, ["u", "v"]).select(
        "key", F.struct(F.col("u").alias("rep"), "n", "m", "label", "far", "common", "before").alias("a")))
    pairs = rows.join(rows.select("key", F.col("a").alias("b")), "key").where(
        (F.col("a.rep") < F.col("b.rep")) & (F.col("a.label") != F.col("b.label")) & possible(percent) & close_enough(percent)
        & ~F.arrays_overlap("a.before", "b.before"))  # a pair is met in its first common band only
    return pairs.select(F.col("b.rep").alias("u"), F.col("a.rep").alias("v"))


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash for every row; doc_id and text_hash name the row.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets.
    """
    found = written(features(docs))
    # written, so that the join below shuffles by itself and a large class can be split there
    named = classes(found)
    members = written(found.join(named, "set_hash", "left").select(
        "doc_id", "text_hash", "n_shingles", "name", "rep",
        F.when(F.col("doc_id").eqNullSafe(F.col("name")) & (F.col("text_hash") == F.col("own")), F.col("bands")).alias("bands")))
    # repeated rows carry the same bands
    reps = written(members.where("bands is not null").select("rep", "doc_id", "text_hash", "bands").dropDuplicates(["rep"]))
    rows = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    rows = written(rows.join(shared, "key", "left_semi"))

    # step 2: what no other candidate holds
    wanted = reps.select("doc_id", "text_hash", "rep").distinct()
    sets = written(full_sets(docs, wanted.join(rows.select("rep").distinct(), "rep", "left_semi")))
    single = sets.select("rep", F.explode("shingles").alias("s")).groupBy("s").agg(
        F.count("*").alias("c"), F.min("rep").alias("rep")).where("c = 1").groupBy("rep").agg(F.count("*").alias("own"))
    alive = sets.select("rep", F.size("shingles").cast("long").alias("n")).distinct().join(single, "rep", "left").select(
        "rep", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("m"))
    alive = written(alive.where(F.col("m") * 100 >= F.col("n") * percent))
    rows = written(rows.join(alive, "rep"))

    # step 3: a star in every band
    me = F.struct("rep", "n", "m")
    centres = rows.groupBy("key").agg(F.min(F.expr(_CENTRE)).alias("a"), F.count("*").alias("c")).where("c > 1")
    stars = rows.select("key", me.alias("b")).join(centres, "key").where((F.col("a.rep") != F.col("b.rep")) & possible(percent))
    stars = written(stars.select(F.greatest("a.rep", "b.rep").alias("u"), F.least("a.rep", "b.rep").alias("v")).distinct())
    labels = components(linked(stars, sets, percent))

    # step 4: bands that join different components
    across = open_pairs(rows, labels, reps.select("rep", "bands"), sets, percent).join(stars, ["u", "v"], "left_anti")
    more = written(linked(across, sets, percent))
    final = labels
    if not more.isEmpty():
        old = labels.select(F.col("node").alias("u"), F.col("label").alias("v"))
        final = components(old.unionByName(more))

    final = final.select(F.col("node").alias("rep"), "label")
    # a class known by a hash can hold the smallest doc_id of its component
    named = final.join(named.select("rep", "name"), "rep")
    final = final.join(named.groupBy("label").agg(F.min("name").alias("top")), "label").select("rep", "top")
    component = F.coalesce("top", "name", "doc_id")
    return same(members.select("doc_id", "text_hash", "n_shingles", "name", "rep"), final, "rep").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
        "text_hash")


def kept_documents(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: rows that are themselves kept."""
    gone = decisions.where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["__hash"]), "left_anti")
