"""The spread-out operator forms against plain windows and full comparisons."""

import random
import time

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catamatch.operators import context, lookup, ordered
from catamatch.operators.match import ranked_matches, token_matches


def same(a, b):
    key = lambda r: tuple(str(v) for v in r)
    cols = a.columns
    assert sorted(map(key, a.collect())) == sorted(map(key, b.select(*cols).collect()))


def stream(spark):
    rnd = random.Random(7)
    # one document holds most rows
    rows = [(1 if rnd.random() < 0.8 else rnd.randint(2, 5), rnd.randint(0, 2), i, rnd.choice([None, i * 1.5])) for i in range(400)]
    return spark.createDataFrame(rows, "d long, p int, i long, v double")


def test_ordered_forms_equal_plain_windows(spark):
    df = stream(spark)
    w = W.partitionBy("d").orderBy("p", "i")
    plain = (df.withColumn("last", F.last("v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
             .withColumn("prev", F.lag("v").over(w)).withColumn("n", F.row_number().over(w)))
    for chunk in (1, 7, 1000):
        out = ordered.last_before(df, ["d"], ["p", "i"], F.col("v"), "last", chunk)
        out = ordered.previous(out, ["d"], ["p", "i"], F.col("v"), "prev", chunk)
        out = ordered.row_numbers(out, ["d"], ["p", "i"], "n", chunk)
        same(out, plain)


def test_panels_in_one_window_absorb_like_joined_flags(spark):
    rnd = random.Random(9)
    some = lambda top: rnd.choice([None, *range(top)])
    rows = [(some(6), some(3), i, rnd.choice([None, True, False, False]), rnd.random() < 0.5, "c", "n", "s", "") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, panel_idx int, item_idx long, built_in boolean, lone boolean, "
                                     "code string, official string, conf string, note string")
    joined, window = (context.absorb_detectors(df, small=small) for small in (False, True))
    assert joined.where("absorbed").count() > 0
    same(joined, window)


def test_first_per_group_in_slices(spark):
    df = stream(spark)
    same(ordered.first_per_group(df, ["d"], ["i"], 5, slices=4), ordered.first_per_group(df, ["d"], ["i"], 5))


def test_ranked_matches_equals_full_comparison(spark):
    rnd = random.Random(3)
    atoms = [f"v:{c}" for c in "abcdefg"]
    pick = lambda: sorted(rnd.sample(atoms, rnd.randint(0, 5)))
    block = lambda: "hot" if rnd.random() < 0.7 else "cold"
    items = spark.createDataFrame([(block(), pick(), 0) for _ in range(60)], "block string, atoms array<string>, extra int").distinct()
    rows = spark.createDataFrame([(block(), i, rnd.choice([0, -4, 6]), pick()) for i in range(200)],
                                 "block string, ord long, own int, atoms array<string>")
    gain = lambda shared, extra: 18 * F.size(shared)
    pairs = items.alias("i").join(rows.alias("r"), "block").select(
        "block", "i.atoms", "ord", (F.col("own") + 18 * F.size(F.array_intersect("i.atoms", "r.atoms"))).alias("score"))
    w = W.partitionBy("block", "atoms").orderBy(F.desc("score"), "ord")
    full = pairs.withColumn("rn", F.row_number().over(w)).where("rn <= 4")
    for limit in (10, 2, 0):
        got = ranked_matches(items, rows, gain, 4, max_atoms=limit).select("block", "atoms", F.explode("hits").alias("h"))
        same(got.select("block", "atoms", "h.ord", "h.score", "h.rn"), full)


def test_nearest_above_forms_agree(spark):
    rnd = random.Random(5)
    wants = spark.createDataFrame([(rnd.choice("aab"), rnd.randint(0, 60) / 2) for _ in range(80)] + [("z", 1.0)], "k string, w double")
    steps = spark.createDataFrame([(rnd.choice("ab"), float(rnd.randint(0, 25)), f"c{i}") for i in range(40)], "k string, cap double, code string")
    near = wants.distinct().alias("w").join(steps.alias("s"), "k", "left").groupBy("k", "w").agg(
        F.min(F.when(F.col("cap") >= F.col("w.w"), F.struct("cap", "code"))).alias("m"), F.max("cap").alias("top")).select(
        "k", "w", F.col("m.cap").alias("fit"), F.col("m.code").alias("fit_code"), "top")
    same(lookup.nearest_above(wants, steps, ["k"], "w", "cap", "code"), near)


def test_nearest_above_is_linear_on_one_key(spark):
    n = 16_000
    wants = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") + 0.5).alias("w"))
    steps = spark.range(n).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("cap"), F.format_string("c%06d", "id").alias("code"))
    start = time.time()
    got = lookup.nearest_above(wants, steps, ["k"], "w", "cap", "code").agg(
        F.count("*"), F.sum("fit"), F.count("fit"), F.max("top")).first()
    assert tuple(got) == (n, n * (n - 1) / 2, n - 1, n - 1.0)
    assert time.time() - start < 20


def test_interval_join_equals_range_condition(spark):
    rnd = random.Random(9)
    points = spark.createDataFrame([(rnd.randint(0, 5000),) for _ in range(60)], "x long")
    spans = spark.createDataFrame([(i, lo, lo + rnd.choice([0, 1, 5, 60, 900, 4000])) for i, lo in
                                   enumerate(rnd.randint(0, 5000) for _ in range(60))], "id int, lo long, hi long")
    for radix, levels in ((16, 5), (2, 3), (4, 1)):
        same(lookup.interval_join(points, spans, [], "x", "lo", "hi", radix, levels),
             points.join(spans, F.col("x").between(F.col("lo"), F.col("hi"))))


def test_token_matches_keep_catalogue_order(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "item int, token string")
    rows = spark.createDataFrame([("a", o) for o in range(50, 90)] + [("b", o) for o in (3, 51, 60)], "token string, ord long")
    got = sorted(tuple(r) for r in token_matches(items, rows, "item", 4).select("item", "ord", "rn").collect())
    assert got == [(1, 3, 1), (1, 50, 2), (1, 51, 3), (1, 52, 4)]


def test_bucket_join_and_lookups(spark):
    df = spark.createDataFrame([(5.0,), (10.0,), (99.0,)], "v double")
    b = lookup.rule_table(spark, [(0.0, 5.0, "a"), (5.0, 10.0, "b")], "lo double, hi double, label string")
    assert sorted(str(tuple(r)) for r in lookup.bucket_join(df, b, "v").collect()) == ["(10.0, 'b')", "(5.0, 'a')", "(99.0, None)"]
    t = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 3, "x")], "code string, ord int, name string")
    assert {r["code"]: r["name"] for r in lookup.unique_by_key(t, "code", "ord").collect()} == {"k": "new", "j": "x"}
    keys = spark.createDataFrame([(1, ["q", "j", "k"]), (2, ["q"])], "id int, keys array<string>")
    got = {r["id"]: r["code"] for r in lookup.first_existing(keys, ["id"], "keys", t, "code", "code").collect()}
    assert got == {1: "j", 2: None}
