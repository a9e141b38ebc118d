"""Candidate generation: exact top-k catalogue rows per item without item x catalogue pairs.

Scoring compares sets of *atoms*: attribute values, option words, special words and so on.
Every atom an item shares with a catalogue row can only raise that row's score, on top of a
part that depends on the row alone.  So among the rows that hold a given atom set, the first k by (own
part, catalogue order) are the only ones that can reach an item's top k through that set.
``ranked_matches`` keeps just those per (block, atom set), lets each distinct item look up
the subsets of its own atoms, and ranks the few rows found.  The result equals the full
comparison; the work is one row per item and subset, not per pair.

A row holds at most one atom that starts with ``LONE`` (its interval), so an item that many
intervals fit asks for them one at a time.  Sets of more than ``max_atoms`` other atoms have too many
subsets; ``wide_matches`` finds their rows by posting lists over small blocks of alike rows, reading only
blocks whose best possible row can still be among the first k.

Items and catalogue rows are first reduced to distinct atom sets, so repeated descriptions
cost nothing and a block with most of the rows is as cheap as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catamatch.operators.ordered import first_per_group, range_numbers
from catamatch.operators.stage import written

MAX_ATOMS = 10
LONE = "i:"
#: Rows of a posting block are at most 2^BLOCK_BITS.
BLOCK_BITS = 8


def _free(atoms: Column) -> Column:
    return F.filter(atoms, lambda a: ~a.startswith(LONE))


def _subsets(atoms: Column) -> Column:
    """Keys of all subsets of a sorted array; of the atoms that exclude each other at most one."""
    start = F.array(F.lit(""))
    free = F.aggregate(_free(atoms), start, lambda acc, v: F.concat(
        acc, F.transform(acc, lambda s: F.concat(s, F.lit("\x01"), v))))
    lone = F.concat(start, F.transform(F.filter(atoms, lambda a: a.startswith(LONE)),
                                       lambda a: F.concat(F.lit("\x01"), a)))
    return F.flatten(F.transform(lone, lambda a: F.transform(free, lambda s: F.concat(s, a))))


def _keep_shared(df: DataFrame, ids: list[str], shared: DataFrame) -> DataFrame:
    """Cut each row's atoms to those both sides of its block know."""
    single = df.select(*ids, F.explode_outer("atoms").alias("atom"))
    known = single.join(shared.withColumn("_both", F.lit(True)), ["block", "atom"], "left")
    return known.groupBy(*ids).agg(F.array_sort(F.collect_set(
        F.when(F.col("_both"), F.col("atom")))).alias("atoms"))


def _score(gain) -> Column:
    shared = F.array_intersect("atoms", "row_atoms")
    return (F.col("own") + gain(shared, F.col("extra"))).alias("score")


def row_blocks(sets: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """The row sets with ``rb``, the number of a posting block: neighbours in the order of their atoms."""
    order = ["block", "atoms", "own", "ord"]
    placed = sets.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(placed.withColumn("rb", F.shiftright(F.monotonically_increasing_id(), bits)))


def block_bounds(items: DataFrame, blocks: DataFrame, gain) -> DataFrame:
    """(block, extra, atoms, rb, bound) of the posting blocks that share an atom with an item.

    A block's posting carries the best own part of its rows.  No row of it scores more than that and the
    gain of all the item's atoms that occur in the block.
    """
    postings = blocks.groupBy("block", "rb").agg(
        F.max("own").alias("top"), F.array_distinct(F.flatten(F.collect_set("atoms"))).alias("held")).select(
        "block", "rb", "top", F.explode("held").alias("atom"))
    met = items.select("block", "extra", "atoms", F.explode("atoms").alias("atom")).join(written(postings), ["block", "atom"])
    met = met.groupBy("block", "extra", "atoms", "rb").agg(
        F.max("top").alias("top"), F.array_sort(F.collect_set("atom")).alias("shared"))
    return met.select("block", "extra", "atoms", "rb", (F.col("top") + gain(F.col("shared"), F.col("extra"))).alias("bound"))


def chosen_blocks(bounds: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """The bounds that reach the k-th score of the rows seen; all of an item that has seen fewer."""
    item = ["block", "extra", "atoms"]
    best = W.partitionBy(*item).orderBy(F.desc("score"), "ord")
    least = seen.select(*item, "ord", "score").distinct().withColumn("rn", F.row_number().over(best)).where(
        F.col("rn") == k).select(*item, F.col("score").alias("least"))
    return bounds.join(least, item, "left").where("least is null or bound >= least").drop("least")


def wide_matches(items: DataFrame, sets: DataFrame, gain, k: int, bits: int = BLOCK_BITS) -> DataFrame:
    """(block, extra, atoms, ord, score): rows that hold every item's first k, without subsets of atoms.

    Every item first reads the rows of the best own part and the posting block of the highest bound.
    The k-th score found is a floor: of the other posting blocks it reads only those whose bound reaches it.
    """
    item = ["block", "extra", "atoms"]
    blocks = row_blocks(sets, bits)
    rows = blocks.select("block", "rb", "ord", "own", F.col("atoms").alias("row_atoms"))
    plain = W.partitionBy("block").orderBy(F.desc("own"), "ord")
    first = rows.withColumn("_r", F.row_number().over(plain)).where(F.col("_r") <= k).drop("_r", "rb")
    bounds = written(block_bounds(items, blocks, gain))

    def read(asked):
        return asked.select(*item, "rb").join(rows, ["block", "rb"]).select(*item, "ord", _score(gain))

    nearest = bounds.groupBy(*item).agg(F.max_by("rb", F.struct("bound", -F.col("rb"))).alias("rb"))
    seen = written(items.join(first, "block").select(*item, "ord", _score(gain)).unionByName(read(nearest)))
    more = chosen_blocks(bounds, seen, k).join(nearest, [*item, "rb"], "left_anti")
    return seen.unionByName(read(more))


def ranked_matches(items: DataFrame, rows: DataFrame, gain, k: int,
                   max_atoms: int = MAX_ATOMS) -> DataFrame:
    """Exact top k of ``own + gain(shared atoms)`` per distinct item.

    items: block, atoms, extra - distinct; ``extra`` is any column ``gain`` needs.
    rows:  block, ord, own, atoms.
    gain(shared, extra) -> Column, never falling when ``shared`` grows.
    Returns (block, atoms, extra) with hits ARRAY<STRUCT<rn, ord, score>>, ties in ``ord`` order.
    """
    # of rows with the same atoms and own part only the first k can be among an item's first k
    items, rows = written(items), written(first_per_group(rows, ["block", "own", "atoms"], ["ord"], k, "_r").drop("_r"))
    shared = (items.select("block", F.explode("atoms").alias("atom")).distinct()
              .join(rows.select("block", F.explode("atoms").alias("atom")).distinct(),
                    ["block", "atom"], "left_semi"))
    keyed = items.withColumn("full", F.col("atoms"))
    asked = written(_keep_shared(keyed, ["block", "full", "extra"], shared))

    # catalogue side: k rows per distinct atom set, then k rows per subset of it
    by_set = W.partitionBy("block", "own", "atoms").orderBy("ord")
    sets = (_keep_shared(rows, ["block", "ord", "own"], shared)
            .withColumn("_r", F.row_number().over(by_set)).where(F.col("_r") <= k).drop("_r"))
    sets = written(sets)
    narrow = F.size(_free(F.col("atoms"))) <= max_atoms
    by_key = W.partitionBy("block", "key").orderBy(F.desc("own"), "ord")
    index = (sets.where(narrow).withColumn("key", F.explode(_subsets(F.col("atoms"))))
             .withColumn("_r", F.row_number().over(by_key)).where(F.col("_r") <= k).drop("_r"))

    # item side: distinct reduced sets look up their subsets
    distinct = written(asked.select("block", "extra", "atoms").distinct())
    found = (distinct.where(narrow).withColumn("key", F.explode(_subsets(F.col("atoms"))))
             .join(index.withColumnRenamed("atoms", "row_atoms"), ["block", "key"])
             .select("block", "extra", "atoms", "ord", _score(gain)))
    wide_items, wide_sets = distinct.where(~narrow), sets.where(~narrow)
    if not wide_items.isEmpty():
        found = found.unionByName(wide_matches(wide_items, sets, gain, k))
    if not wide_sets.isEmpty():
        found = found.unionByName(wide_matches(distinct.where(narrow), wide_sets, gain, k))
    found = found.distinct()
    best = W.partitionBy("block", "extra", "atoms").orderBy(F.desc("score"), "ord")
    hits = (found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k)
            .groupBy("block", "extra", "atoms")
            .agg(F.array_sort(F.collect_list(F.struct("rn", "ord", "score"))).alias("hits")))
    return (asked.join(hits, ["block", "extra", "atoms"])
            .select("block", F.col("full").alias("atoms"), "extra", "hits"))


def token_matches(items: DataFrame, rows: DataFrame, item: str, k: int) -> DataFrame:
    """First k catalogue rows, in catalogue order, that share a token with the item.

    items: (item, token); rows: (token, ord).  Only a token's first k rows can be among an
    item's first k, so every posting list is cut to k before the join, frequent tokens included.
    """
    wanted = rows.join(items.select("token").distinct(), "token", "left_semi").distinct()
    postings = first_per_group(wanted, ["token"], ["ord"], k, "_r").drop("_r")
    hits = items.distinct().join(postings, "token").select(item, "ord").distinct()
    return first_per_group(hits, [item], ["ord"], k, "rn")


def _grams(text: Column, size: int) -> Column:
    """Distinct grams of a text; a shorter text is its own only gram."""
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def contained_matches(items: DataFrame, rows: DataFrame, item: str, k: int, gram: int = 3, wave: int = 64) -> DataFrame:
    """First k catalogue rows, in catalogue order, whose name contains a token of the item.

    items: (item, token); rows: (ord, form) with unique ord.  An empty token is in every name.  Of a
    token's grams only the one that the fewest names hold is looked up, and its names are verified in
    catalogue order, wave by wave: a token that has k names takes no part in the next wave, which is
    sixteen times as long.  Names are only read for the tokens still open.  Of equal names only the first k count.
    """
    items, rows = written(items.distinct()), written(first_per_group(rows, ["form"], ["ord"], k, "_r").drop("_r"))
    tokens = items.select("token").distinct()
    grams = written(tokens.where("token <> ''").select(
        "token", F.length("token").alias("size"), F.explode(_grams(F.col("token"), gram)).alias("gram")))
    wanted = written(grams.select("gram").distinct())
    # short tokens are grams of their own length
    parts = F.array_distinct(F.flatten(F.array(*[_grams(F.col("form"), g) for g in range(1, gram + 1)])))
    postings = rows.select("ord", F.explode(parts).alias("gram")).join(wanted, "gram", "left_semi")
    postings = range_numbers(postings, ["gram"], ["ord"], "pos")
    held = written(postings.groupBy("gram").agg(F.max("pos").alias("n")))
    rarest = grams.join(held, "gram", "left").groupBy("token").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("n"), F.min_by("gram", F.struct("n", "gram")).alias("gram")).where("n > 0")
    open_ = written(rarest)
    every = tokens.where("token = ''").join(first_per_group(rows.select(F.lit("").alias("token"), "ord"), ["token"], ["ord"], k, "_r"), "token")
    found, lo, hi = [written(every.select("token", "ord"))], 0, wave
    while not open_.isEmpty():
        met = open_.join(postings.where(F.col("pos").between(lo + 1, hi)), "gram").join(rows, "ord")
        hits = met.where(F.col("form").contains(F.col("token"))).select("token", "ord")
        found.append(written(first_per_group(hits, ["token"], ["ord"], k, "_r").drop("_r")))
        had = found[1]
        for f in found[2:]:
            had = had.unionByName(f)
        had = had.groupBy("token").agg(F.count("*").alias("had"))
        open_ = written(open_.where(F.col("n") > hi).join(had, "token", "left").where(
            F.coalesce("had", F.lit(0)) < k).drop("had"))
        lo, hi = hi, hi * 16
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    firsts = first_per_group(hits, ["token"], ["ord"], k, "_r").drop("_r")
    return first_per_group(items.join(firsts, "token").select(item, "ord").distinct(), [item], ["ord"], k, "rn")
