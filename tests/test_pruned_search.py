"""Searches that read only what can still matter: posting blocks, rarest grams, ranges."""

import random

import pytest
from pyspark.sql import functions as F

from catamatch.operators import match
from catamatch.operators.ordered import range_numbers
from catamatch.operators.stage import written


def gain(shared, extra):
    return F.size(shared) * 10 + extra


def full(items, rows, k):
    out = []
    for block, atoms, extra in items:
        scored = sorted((-(own + 10 * len(set(atoms) & set(held)) + extra), ord_) for b, ord_, own, held in rows if b == block)
        out += [(block, tuple(atoms), extra, n, o, -s) for n, (s, o) in enumerate(scored[:k], 1)]
    return sorted(out)


def tables(spark, items, rows):
    return (spark.createDataFrame(items, "block string, atoms array<string>, extra int"),
            spark.createDataFrame(rows, "block string, ord bigint, own int, atoms array<string>"))


@pytest.mark.parametrize("limit", [0, 2, 4])
def test_wide_sets_equal_the_full_comparison(spark, limit):
    r = random.Random(limit)
    words = [f"w{i:02}" for i in range(14)]
    items = sorted({(b, tuple(sorted(r.sample(words, r.randrange(0, 9)))), r.choice([0, 3])) for b in "ab" for _ in range(12)})
    rows = [(r.choice("ab"), i, r.choice([0, 0, -4, 6]), sorted(r.sample(words, r.randrange(0, 7)))) for i in range(300)]
    asked, held = tables(spark, [(b, list(a), x) for b, a, x in items], rows)
    got = match.ranked_matches(asked, held, gain, 4, max_atoms=limit).select("block", "atoms", "extra", F.explode("hits").alias("h"))
    found = sorted((x["block"], tuple(x["atoms"]), x["extra"], x["h"]["rn"], x["h"]["ord"], x["h"]["score"]) for x in got.collect())
    assert found == full(items, rows, 4)


def test_wide_search_reads_few_rows_of_a_large_block(spark):
    """One block of 200,000 rows: the posting blocks that can reach the fifth score hold a small part of it."""
    n = 200_000
    atom = lambda i, m: F.concat(F.lit(f"{m}:"), F.pmod(F.xxhash64(F.lit(m), "id"), F.lit(i)).cast("string"))
    sets = written(spark.range(n).select(
        F.lit("b").alias("block"), F.col("id").alias("ord"), F.pmod(F.xxhash64("id"), F.lit(5)).cast("int").alias("own"),
        F.array_sort(F.array(*[atom(i, m) for m, i in enumerate((8, 9, 10, 11, 12, 13))])).alias("atoms")))
    asked = [[f"{m}:{v % i}" for m, i in enumerate((8, 9, 10, 11, 12, 13))] for v in (3, 77)]
    items = spark.createDataFrame([("b", sorted(a), 0) for a in asked], "block string, atoms array<string>, extra int")
    blocks = match.row_blocks(sets)
    bounds = match.block_bounds(items, blocks, gain)
    best = match.wide_matches(items, sets, gain, 5)
    read = match.chosen_blocks(bounds, best, 5).select("rb").distinct().join(blocks, "rb").count()
    assert read < n / 4
    top = {}
    for r in best.distinct().collect():
        top.setdefault(tuple(r["atoms"]), []).append((-r["score"], r["ord"]))
    rows = sets.collect()
    for a in asked:
        want = sorted((-(r["own"] + 10 * len(set(a) & set(r["atoms"]))), r["ord"]) for r in rows)[:5]
        assert sorted(top[tuple(sorted(a))])[:5] == want


def test_containment_equals_brute_force(spark):
    r = random.Random(4)
    names = ["".join(r.choices("abcé中", k=r.randrange(0, 9))) for _ in range(400)] + ["abab"] * 200
    items = [(f"i{i}", "".join(r.choices("abcé中", k=r.choice([0, 1, 1, 2, 3, 4, 6])))) for i in range(80)]
    asked = spark.createDataFrame(items + items[:9], "item string, token string")
    rows = spark.createDataFrame(list(enumerate(names)), "ord bigint, form string")
    per = {}
    for i, token in items:
        per.setdefault(i, set()).update(o for o, n in enumerate(names) if token in n)
    for k, wave in ((3, 2), (25, 64), (150, 1)):
        want = sorted((i, o, n) for i, hits in per.items() for n, o in enumerate(sorted(hits)[:k], 1))
        got = match.contained_matches(asked, rows, "item", k, wave=wave)
        assert sorted((x["item"], x["ord"], x["rn"]) for x in got.collect()) == want
    assert match.contained_matches(asked.limit(0), rows, "item", 3).collect() == []
    assert match.contained_matches(asked, rows.limit(0), "item", 3).collect() == []


def test_range_numbers_spread_one_group(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.lit("hot")).alias("g"),
                                    F.pmod(F.xxhash64("id"), F.lit(500)).alias("y"), "id")
    got = range_numbers(df.repartition(6), ["g"], [F.col("y").desc(), "id"], "no")
    rows = got.collect()
    for g in (None, "hot"):
        mine = sorted((-r["y"], r["id"], r["no"]) for r in rows if r["g"] == g)
        assert [m[2] for m in mine] == list(range(1, len(mine) + 1))
    assert range_numbers(df.limit(0), ["g"], ["id"], "no").collect() == []
