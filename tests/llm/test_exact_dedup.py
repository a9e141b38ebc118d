from pyspark.sql import functions as F

from catamatch.llm import exact_dedup as op
from llm.cases import clashing, documents, rows

TEXTS = [None, "", " \t", "a b", "ab ", "a\x0b b\n\n", "ab", "c", "c", "é", "x" * 100_000]


def brute(texts, ids):
    import re

    out = []
    for i, t in zip(ids, texts):
        key = re.sub("[\x20\x09-\x0d]", "", t or "")
        group = [(-len(u or ""), j) for j, u in zip(ids, texts) if re.sub("[\x20\x09-\x0d]", "", u or "") == key]
        keep = min(group)[1]
        out.append((i, keep, len(group), keep == i))
    return sorted(out, key=repr)


def test_every_way_of_splitting_the_history(spark):
    ids = list(range(10, 21))
    docs = documents(spark, TEXTS, ids=ids)
    for earlier in (F.lit(True), F.lit(False), F.col("doc_id") % 2 == 0, F.col("doc_id") > 14):
        got = op.exact_dedup(clashing(docs), earlier, shard=3)
        assert rows(got, "doc_id", "keep_id", "group_size", "kept") == brute(TEXTS, ids)


def test_cases(spark):
    docs = documents(spark, ["a", "a", "a", "b"], ids=[None, 7, 7, None])
    got = op.exact_dedup(docs, F.col("doc_id").isNull())
    assert rows(got, "doc_id", "keep_id", "group_size", "kept") == sorted(
        [(None, 7, 3, False), (7, 7, 3, True), (7, 7, 3, True), (None, None, 1, True)], key=repr)
    assert op.exact_dedup(docs.limit(0), F.lit(True)).collect() == []
    kept = op.kept_documents(clashing(docs), got)
    assert rows(kept, "doc_id", "text") == sorted([(7, "a"), (7, "a"), (None, "b")], key=repr)
    docs = documents(spark, ["a", "a", "b"], ids=[7, 3, 7])
    assert rows(op.kept_documents(docs, op.exact_dedup(docs, F.lit(False))), "doc_id", "text") == [(3, "a"), (7, "b")]


def test_slots_compare_the_whole_digest(spark, monkeypatch):
    """Digests that agree in the bytes the hash reads are told apart by the slot."""
    a, b = b"k" * 16 + b"a" * 16, b"k" * 16 + b"b" * 16
    schema = "digest binary, n bigint, chars bigint, inverse bigint"
    index = op.history(spark.createDataFrame([(a, 1, 5, ~1)], schema), 1)
    got = op.settle(spark.createDataFrame([(b, 2, 9, ~2), (a, 1, 5, ~0)], schema), index, 1)
    assert {bytes(r["digest"]): (r["n"], ~r["inverse"]) for r in got.collect()} == {a: (2, 0), b: (2, 2)}
