"""Mixing sources to target weights, with DataFrame and SQL functions only.

Sources get targets that share the size of the whole by weight, none above ``REPEATS`` times its
own size.  Each source's words, its documents one after another, form a stream that is cut into
the fewest blocks of at most ``BLOCK`` words, equal but for one word, so every slot of a source
is worth the same.  The expected slots of a source are its target by the words of its block, rounded at
random to whole slots.  Output shards of ``SLOTS`` slots draw multinomial source counts with these odds.
What chance has drawn beyond a source's slots over all shards is handed to the sources that came short,
so no source is more than a block off its target, and none is drawn past its last allowed pass.  The
slots of a source, numbered through all shards, are mapped to its blocks by an affine permutation of the
block numbers with its own multiplier and shift for each pass, so a block comes up again only after all
others have.  Slots and document pieces meet on (source, block).  Everything random is a hash of fixed numbers, so
reruns agree.

A source may hold any share of the rows: places in its stream come from running totals dealt to
parts, and the blocks of a source are as many join keys.  The table of sources, one row each, is
the mix's configuration; slots are rows of their own, spread by a hash.  Joins that grow with the documents
are merge joins, so none turns into a broadcast by its compressed size.

Defined results: a null or blank text has size 0 and gives nothing; a null source is a source of its
own, after all others; rows that repeat a doc_id are mixed each; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catamatch.llm.common import numbered, pieces_of
from catamatch.operators.stage import written

WEIGHTS = (1, 2, 3)
REPEATS = 3
BLOCK, SLOTS = 128, 1024
CHUNK = 512
WORD = r"[^\x20\x09-\x0D]+"
#: Multipliers of the permutations: primes, so each is coprime to all numbers but its multiples.
PRIMES = (2305843009213693951, 2147483647, 999999999989, 67280421310721, 1000000007, 998244353)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, no (its place in the order), source_size, target.

    The level at which no target is above its bound solves the repeated sharing of the excess:
    with sources by bound per weight, the first ones are at their bounds and the others share the
    rest by weight.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("no", F.row_number().over(order) - 1)
    per = per.withColumns({
        "weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int")),
        "bound": F.col("source_size").cast("double") * repeats})
    by = W.orderBy(F.col("bound") / F.col("weight"), "no")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    per = per.withColumn("level", level)
    open_ = F.col("level") * F.col("weight") <= F.col("bound")
    first = F.min(F.when(open_, F.struct((F.col("bound") / F.col("weight")).alias("b"), "no", "level"))).over(every)
    return per.select("source", "no", "source_size",
                      F.least("bound", F.col("weight") * F.coalesce(first["level"], F.lit(0.0))).alias("target"))


def _uniform(*cols) -> Column:
    """In [0, 1), from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def block_count(block: int) -> Column:
    """Blocks of a source: the fewest that hold its words."""
    return F.ceil(F.col("source_size") / block).cast("long")


def rounded(plan: DataFrame, block: int, repeats: int, seed: int) -> DataFrame:
    """no, blocks (of the source) and n, its slots over all shards: the whole part of what it expects or one more, by a random start."""
    each = plan.where("target > 0").withColumn("blocks", block_count(block))
    # x is at most repeats * blocks, a whole number: the bound only undoes rounding of the sum
    drawn = F.floor(F.col("target") / F.col("source_size") * F.col("blocks") + _uniform(F.lit(seed), "no"))
    return each.select("no", "blocks", F.least(drawn.cast("long"), F.col("blocks") * repeats).alias("n")).where("n > 0")


def multinomial(each: DataFrame, total: int, sources: int, slots: int, seed: int) -> DataFrame:
    """shard, no, count: every slot of every shard draws a source with the odds of its n.

    A slot draws a number below ``total``; the sources share these by ranges, and both meet on cells of equal width.
    """
    width = pieces_of(total, sources)
    ends = numbered(each, [], ["no"], F.col("n"), "lo", pieces_of(sources, CHUNK)).withColumn("hi", F.col("lo") + F.col("n"))
    div = lambda c: F.expr(f"{c} div {width}L")
    ranges = ends.select("no", "lo", "hi", F.explode(F.sequence(div("lo"), div("(hi - 1)"))).alias("cell"))
    drawn = each.sparkSession.range(total).select(
        F.expr(f"id div {slots}L").alias("shard"), F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(total)).alias("u"))
    met = drawn.withColumn("cell", div("u")).join(ranges, "cell").where("u >= lo and u < hi")
    return met.groupBy("shard", "no").agg(F.count("*").alias("count"))


def draws(plan: DataFrame, block: int, slots: int, repeats: int, seed: int) -> DataFrame:
    """Slots of all output shards: shard, no and blocks (of the source) and slot (its number among the source's slots).

    Shards of ``slots`` slots draw multinomial source counts.  A source's slots are numbered through the
    shards; those past its n are handed, one by one, to the sources that were drawn less often than their n.
    So in the end each source has the slots 0 to n - 1.
    """
    each = written(rounded(plan, block, repeats, seed))
    sums = each.agg(F.sum("n").alias("total"), F.count("*").alias("sources")).first()
    total, sources = sums["total"] or 0, sums["sources"]
    if not total:
        return each.select(F.lit(0).cast("long").alias("shard"), "no", "blocks", F.col("n").alias("slot"))
    counts = written(multinomial(each, total, sources, slots, seed))
    shards = pieces_of(total, slots)
    placed = written(numbered(counts, ["no"], ["shard"], F.col("count"), "first", pieces_of(shards, CHUNK)).join(each, "no"))

    def listed(rows, first, end):
        return rows.where(F.col(first) < F.col(end)).withColumn("slot", F.explode(F.sequence(first, F.col(end) - 1)))

    own = listed(placed.withColumn("end", F.least("n", F.col("first") + F.col("count"))), "first", "end")
    over = placed.withColumn("more", F.col("count") - F.greatest(F.lit(0), F.least("count", F.col("n") - F.col("first")))).where("more > 0")
    had = placed.groupBy("no").agg(F.sum("count").alias("had"))
    lacking = each.join(had, "no", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < n")

    def units(rows, amount, order, parts):
        """A row for each unit of the amount, numbered through all rows as ``unit``."""
        ranked = numbered(rows, [], order, F.col(amount), "lo", parts)
        return ranked.withColumn("unit", F.explode(F.sequence("lo", F.col("lo") + F.col(amount) - 1)))

    given = units(over.select("shard", "no", "more"), "more", ["shard", "no"], pieces_of(total, CHUNK * slots)).select("unit", "shard")
    wanted = units(lacking.withColumn("lack", F.col("n") - F.col("had")), "lack", ["no"], pieces_of(sources, CHUNK))
    moved = wanted.withColumn("slot", F.col("had") + F.col("unit") - F.col("lo")).join(given, "unit")
    names = ["shard", "no", "blocks", "slot"]
    return own.select(*names).unionByName(moved.select(*names))


def permuted(slot: Column, blocks: Column, no: Column, seed: int) -> tuple[Column, Column]:
    """Pass over the source's blocks and block of a slot."""
    index, wide = slot % blocks, "decimal(38,0)"
    turn = ((slot - index) / blocks).cast("long")
    coprime = F.filter(F.array(*[F.lit(p).cast("long") for p in PRIMES]), lambda p: blocks % p != 0)
    factor = F.element_at(coprime, (F.pmod(F.xxhash64(F.lit(seed), no, turn), F.size(coprime)) + 1).cast("int")) % blocks
    shift = F.pmod(F.xxhash64(F.lit(seed + 1), no, turn), blocks)
    at = (factor.cast("decimal(19,0)") * index.cast("decimal(19,0)")).cast(wide) + shift.cast(wide)
    return turn, (at % blocks.cast(wide)).cast("long")


def block_parts(streams: DataFrame, block: int) -> DataFrame:
    """Documents cut at block borders: doc_id, start, no, block, words, at (place of the first one in the document, from 1).

    The first ``more`` blocks of a source have ``short`` + 1 words, the others ``short``.
    """
    div = lambda a, b: F.call_function("div", a, b)
    short, more = div(F.col("source_size"), F.col("blocks")), F.col("source_size") % F.col("blocks")
    lo, hi = F.col("start"), F.col("start") + F.col("size")
    head = F.col("more") * (F.col("short") + 1)

    def holds(place):
        return F.when(place < head, div(place, F.col("short") + 1)).otherwise(F.col("more") + div(place - head, F.col("short")))

    def begins(no):
        return no * F.col("short") + F.least(no, F.col("more"))

    cut = streams.where("size > 0").withColumn("blocks", block_count(block)).withColumns({"short": short, "more": more})
    cut = cut.withColumn("block", F.explode(F.sequence(holds(lo), holds(hi - 1))))
    first = F.greatest(lo, begins(F.col("block")))
    return cut.withColumns({"words": F.least(hi, begins(F.col("block") + 1)) - first, "at": (first - lo + 1).cast("int")}).drop(
        "blocks", "short", "more")


def drawn_blocks(sized: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, slots: int = SLOTS,
                 chunk: int = CHUNK, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The documents' places in their source's stream, and the drawn blocks.

    The first has doc_id, no, source_size, target, size, start; the second has each (no, block, turn)
    once, with its shard: the block comes up in that pass.
    """
    sized = written(sized)
    plan = written(targets(sized, weights, repeats))
    named = plan.withColumnRenamed("source", "__source")
    keyed = sized.join(named, sized["source"].eqNullSafe(named["__source"])).drop("__source")
    streams = written(numbered(keyed, ["no"], ["doc_id", "size"], F.col("size"), "start", pieces_of(sized.count(), chunk)))
    taken = draws(plan, block, slots, repeats, seed)
    turn, at = permuted(F.col("slot"), F.col("blocks"), F.col("no"), seed)
    return streams, taken.select("shard", "no", turn.alias("turn"), at.alias("block"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted)."""
    streams, drawn = drawn_blocks(sizes(docs), **settings)
    times = drawn.groupBy("no", "block").agg(F.count("*").alias("times"))
    parts = block_parts(streams, settings.get("block", BLOCK)).join(times.hint("merge"), ["no", "block"])
    # among documents with words, (source, start) names one
    taken = parts.groupBy("no", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    key = F.when(F.col("size") > 0, F.col("start"))
    return (streams.withColumn("start", key).join(taken.hint("merge"), ["no", "start"], "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: one row for each document and pass that takes any of its words.

    A document taken whole keeps its text; of another one the taken words are joined by blanks.
    n_chars follows the text, other columns pass through.  Rows that repeat doc_id, text and source are copies.
    """
    # a missing doc_id or source leaves its part out; ids are shorter than hashes, so keys stay apart
    key = F.concat_ws("/", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))), F.md5("source"))
    streams, drawn = drawn_blocks(sizes(docs.withColumn("doc_id", key)), **settings)
    parts = block_parts(streams, settings.get("block", BLOCK)).join(drawn.hint("merge"), ["no", "block"])
    spans = parts.groupBy("no", "start", "turn").agg(
        F.max("doc_id").alias("__key"), F.max("size").alias("__size"), F.sum("words").alias("__taken"),
        F.array_sort(F.collect_list(F.struct("at", F.col("words").cast("int").alias("n")))).alias("__spans")
    ).select("__key", "__size", "__taken", "__spans")
    one = docs.withColumn("__doc", key).dropDuplicates(["__doc"])
    both = one.join(spans.hint("merge"), F.col("__doc") == F.col("__key"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    both = both.withColumn("__words", F.when(F.col("__taken") < F.col("__size"), words))
    cut = F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice("__words", s["at"], s["n"]))), " ")
    out = both.withColumn("__text", F.coalesce(cut, F.col("text")))
    named = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return out.select(*[named[c].alias(c) if c in named else F.col(c) for c in docs.columns])
