import random

import pytest
from pyspark.sql import functions as F

from catamatch.llm import mixing as op
from catamatch.llm.queries import op3_mix
from llm.cases import clashing, documents, rows

SF = "/root/testdata/sf0.001"


def brute_targets(size, weights=(1, 2, 3)):
    """Shares, with the excess dealt again and again."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * size[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= above
    return target


def random_docs(spark, seed, n=400):
    r = random.Random(seed)
    sources = [r.choice(["a", "a", "a", "B", "é", None, "", "z9", "tiny"]) for _ in range(n)]
    texts = [" ".join("w" for _ in range(2 if s == "tiny" else r.choice([0, 1, 20, 700]))) for s in sources]
    texts[3] = None
    return documents(spark, texts, sources=sources), texts, sources


def test_targets_and_taken(spark):
    docs, texts, sources = random_docs(spark, 1)
    got = {r["doc_id"]: r for r in op.mix(clashing(docs)).collect()}
    assert len(got) == len(texts)
    size = {}
    for t, s in zip(texts, sources):
        size[s] = size.get(s, 0) + len((t or "").split())
    target, taken = brute_targets(size), {}
    for i, (t, s) in enumerate(zip(texts, sources)):
        r = got[i]
        assert (r["size"], r["source_size"]) == (len((t or "").split()), size[s])
        assert r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 4 * op.BLOCK
    assert rows(op.mix(docs), "doc_id", "taken") == rows(op.mix(docs.repartition(7)), "doc_id", "taken")


def test_permutations(spark):
    for blocks in (1, 2, 3, 10, 97, 1000):
        turn, at = op.permuted(F.col("id"), F.lit(blocks).cast("long"), F.lit(3), 0)
        got = spark.range(3 * blocks).select(turn.alias("t"), at.alias("b")).distinct()
        assert got.count() == 3 * blocks and got.agg(F.max("b")).first()[0] == blocks - 1
    turn, at = op.permuted(F.lit(10**12 + 5), F.lit(999_999_999_990).cast("long"), F.lit(3), 0)
    assert 0 <= spark.range(1).select(at).first()[0] < 999_999_999_990


def test_only_sql_functions(spark):
    docs = documents(spark, ["a b"] * 5)
    for df in (op.mix(docs), op.mixed_documents(docs)):
        assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_documents_of_the_mix(spark):
    docs, texts, _ = random_docs(spark, 2)
    docs = docs.withColumn("text", F.when(F.length("text") > 0, F.concat("text", F.lit("\nend "), F.col("doc_id").cast("string"))).otherwise(F.col("text")))
    taken = {r["doc_id"]: r["taken"] for r in op.mix(docs).collect()}
    mixed = op.mixed_documents(clashing(docs)).collect()
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {}
    for r in mixed:
        words = r["text"].split()
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words)
        assert r["n_chars"] == len(r["text"])
        assert len(words) < len(whole[r["doc_id"]].split()) or r["text"] == whole[r["doc_id"]]
    # the order in a source follows the key's type, so single documents differ; sizes do not
    assert abs(sum(got.values()) - sum(taken.values())) <= 16 * op.BLOCK
    assert all(n <= 3 * len(whole[d].split()) for d, n in got.items())


def test_cases(spark):
    docs = documents(spark, ["a b", "a b", "c", None, ""], ids=[1, 1, None, None, 2], sources=[None, None, "s", "s", "t"])
    got = op.mix(docs).collect()
    assert len(got) == 5 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert op.mix(docs.limit(0)).collect() == [] and op.mixed_documents(docs.limit(0)).collect() == []
    assert op.mix(docs.where("text is null")).collect()[0]["taken"] == 0


def test_query(spark):
    got = op3_mix(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_small_sources_meet_their_targets(spark):
    sizes = [1, 20, 127, 128, 129, 130, 200, 257, 300, 700]
    sources, texts = ["big"], [" ".join(["w"] * 60000)]
    for i in range(200):
        sources.append(f"s{i:03}")
        texts.append(" ".join(["w"] * sizes[i % len(sizes)]))
    docs = documents(spark, texts, sources=sources)
    for slots in (op.SLOTS, 64):
        got = {r["doc_id"]: r for r in op.mix(docs, slots=slots).collect()}
        for i, t in enumerate(texts):
            r, n = got[i], len(t.split())
            # a source of one document: never more than one of its equal blocks off, exact at the bound
            assert abs(r["taken"] - r["target"]) <= -(-n // -(-n // op.BLOCK)) + 1e-6
            assert r["target"] < 3 * n or r["taken"] == 3 * n
        for n in sizes:
            some = [r for r in got.values() if r["size"] == n]
            assert sum(r["taken"] for r in some) == pytest.approx(sum(r["target"] for r in some), rel=0.05)


def test_short_blocks_are_unbiased(spark):
    # below their bound: each source expects a share of a block, over many seeds the mean is the target
    texts = [" ".join(["w"] * n) for n in (3000, 130, 200, 20)]
    docs = op.written(op.sizes(documents(spark, texts, sources=list("abcd"))))
    target, taken = {}, {}
    for seed in range(12):
        streams, drawn = op.drawn_blocks(docs, weights=(40.0, 3.0, 3.0, 0.9), seed=seed)
        parts = op.block_parts(streams, op.BLOCK).join(drawn, ["no", "block"])
        for r in parts.groupBy("no").agg(F.sum("words").alias("w")).collect():
            taken[r["no"]] = taken.get(r["no"], 0) + r["w"]
        target = target or {r["no"]: r["target"] for r in streams.collect()}
    for no, block in ((1, 65), (2, 100), (3, 20)):
        assert abs(taken.get(no, 0) / 12 - target[no]) <= 0.5 * block


def test_documents_that_share_an_id(spark):
    texts = ["a b c", "d e", "d e", "f", "g h", "i", "a b c", "a b c"]
    sources = ["s", "s", "t", None, "s", "t", "s", None]
    docs = documents(spark, texts, ids=[1, 1, 1, 1, None, None, 2, None], sources=sources)
    mixed = op.mixed_documents(docs, weights=(1,), block=1).collect()
    sizes = {r["no"]: r for r in op.targets(op.sizes(docs), (1,)).collect()}
    names = {r["source"]: r["target"] for r in sizes.values()}
    for source, target in names.items():
        words = [w for r in mixed if r["source"] == source for w in r["text"].split()]
        assert abs(len(words) - target) <= 1
    whole = {(r["doc_id"], r["source"], w) for r in docs.collect() for w in r["text"].split()}
    got = {(r["doc_id"], r["source"], w) for r in mixed for w in r["text"].split()}
    assert got <= whole
    full = op.mixed_documents(docs.withColumn("source", F.lit("s")))
    assert rows(full, "doc_id", "text") == sorted(zip([1, 1, 1, 1, None, None, 2, None], texts), key=repr)


def test_shards_draw_multinomial_counts(spark):
    names, slots = [(0, 900, 30_000), (1, 400, 15_000), (2, 100, 4_990), (3, 1, 10), (4, 500, 1)], 500
    each = spark.createDataFrame(names, "no bigint, blocks bigint, n bigint")
    total = sum(n for _, _, n in names)
    drawn = op.multinomial(each, total, len(names), slots, 7)
    assert drawn.agg(F.sum("count")).first()[0] == total
    per = {}
    for r in drawn.collect():
        per.setdefault(r["shard"], {})[r["no"]] = r["count"]
    assert len(per) == total // slots + 1 and all(sum(c.values()) == slots for h, c in per.items() if h < total // slots)
    full = [c for h, c in per.items() if h < total // slots]
    for no, _, n in names:
        p = n / total
        counts = [c.get(no, 0) for c in full]
        mean = sum(counts) / len(counts)
        variance = sum((c - mean) ** 2 for c in counts) / (len(counts) - 1)
        assert abs(mean - slots * p) < 5 * (slots * p / len(full)) ** 0.5 + 0.1
        if n > 1000:
            assert 0.6 < variance / (slots * p * (1 - p)) < 1.6


def test_every_slot_once(spark):
    docs, _, _ = random_docs(spark, 4)
    plan = op.written(op.targets(op.sizes(docs)))
    for slots in (8, 64):
        want = {r["no"]: r["n"] for r in op.rounded(plan, op.BLOCK, op.REPEATS, 0).collect()}
        got = op.draws(plan, op.BLOCK, slots, op.REPEATS, 0).collect()
        assert sorted((r["no"], r["slot"]) for r in got) == sorted((no, i) for no, n in want.items() for i in range(n))
        # what has been handed over stays in its shard, so shards keep their size
        size = {}
        for r in got:
            size[r["shard"]] = size.get(r["shard"], 0) + 1
        assert all(n == slots for h, n in size.items() if h < max(size))


def test_taken_against_a_replay(spark):
    docs, texts, _ = random_docs(spark, 5)
    streams, drawn = op.drawn_blocks(op.sizes(docs))
    places = {}
    for r in streams.where("size > 0").collect():
        words = places.setdefault(r["no"], {})
        for i in range(r["size"]):
            words[r["start"] + i] = r["doc_id"]
    taken = {}
    for r in drawn.collect():
        n = len(places[r["no"]])
        blocks = -(-n // op.BLOCK)
        short, more = divmod(n, blocks)
        first = r["block"] * short + min(r["block"], more)
        for at in range(first, first + short + (r["block"] < more)):
            doc = places[r["no"]][at]
            taken[doc] = taken.get(doc, 0) + 1
    got = {r["doc_id"]: r["taken"] for r in op.mix(docs).collect()}
    assert got == {i: taken.get(i, 0) for i in range(len(texts))}
