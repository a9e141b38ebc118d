import random

import numpy as np

from catamatch.llm import near_dedup as op
from catamatch.llm.queries import op5_near_dedup
from llm.cases import clashing, documents, rows

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(texts, ids, percent):
    sets = [shingles(t) for t in texts]
    label = dict(zip(ids, ids))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                u, v = root(ids[i]), root(ids[j])
                label[max(u, v)] = min(u, v)
    return sorted(((i, len(s), root(i), root(i) == i) for i, s in zip(ids, sets)), key=repr)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    texts = [None, "", " \n", "one", "ONE", "one two", "one two "]
    for _ in range(12):
        base = [word() for _ in range(r.choice([6, 40, 200, 400]))]
        for _ in range(r.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(int(len(base) * r.choice([0, 0.005, 0.01, 0.02, 0.04]))):
                copy[r.randrange(len(copy))] = word()
            if r.random() < 0.3:
                copy = copy[:int(len(copy) * r.uniform(0.8, 1))]
            if r.random() < 0.4:
                base = copy  # chains
            texts.append(" ".join(copy))
    return texts


def test_against_brute_force(spark):
    for seed in (1, 2, 3):
        texts = corpus(seed)
        ids = list(range(len(texts)))
        random.Random(seed).shuffle(ids)
        docs = documents(spark, texts, ids=ids)
        for percent in (80, 85):
            got = op.near_dedup(clashing(docs), percent)
            assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == brute(texts, ids, percent)


def test_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    ids, texts = zip(*docs)
    assert rows(op5_near_dedup(spark, SF), "doc_id", "n_shingles", "component_id", "kept") == brute(texts, ids, 85)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2700], r.integers(0, 1 << 63, 300, dtype=np.uint64)])
    same = (op.signature(a) == op.signature(b)).mean()
    assert abs(same - 2700 / 3300) < 0.15
    assert len(set(op.bands(op.signature(a)).tolist())) == 24


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + r.randrange(1, 40)) for _ in range(50)] + [(7, 7)]
    got = {(a["node"], a["label"]) for a in op.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(v, 100) for _, v in edges[60:-1]} | {(100, 100)}
    assert op.components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_cases(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None, "z"], ids=[None, 5, 5, 6, None])
    got = op.near_dedup(docs)
    assert rows(got, "doc_id", "component_id", "kept") == sorted(
        [(None, 5, False), (5, 5, True), (5, 5, True), (6, 6, True), (None, None, True)], key=repr)
    assert op.near_dedup(docs.limit(0)).collect() == []


def test_kept_documents_with_null_and_repeated_ids(spark):
    r = random.Random(9)
    long = [" ".join("".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(300)) for _ in range(3)]
    texts = ["a b c d e f", "a b c d e f", "a b c d e f", None, "z", "A B C D E F", "u v w x y z", "a b c d e f",
             long[0], long[0] + " end", long[1], long[2], long[2] + " end", None]
    ids = [None, 5, 5, 6, None, 7, 7, 7, 20, 21, 21, 30, 21, None]
    stays = [1, 2, 3, 4, 6, 8, 10, 12, 13]
    docs = clashing(documents(spark, texts, ids=ids))
    found = op.near_dedup(docs)
    components = [5, 5, 5, 6, None, 5, 7, 5, 20, 20, 21, 21, 21, None]
    want = [(i, c, i == c) for i, c in zip(ids, components)]
    assert rows(found, "doc_id", "component_id", "kept") == sorted(want, key=repr)
    kept = op.kept_documents(docs, found)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id", "text") == sorted(((ids[i], texts[i]) for i in stays), key=repr)


def test_classes_without_an_id_are_linked(spark):
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base + ["end"]), " ".join(base + ["stop"]), " ".join(other), " ".join(other + ["end"]),
             " ".join(other + ["end"])]
    docs = documents(spark, texts, ids=[5, None, 7, None, None, None])
    got = op.near_dedup(docs)
    assert rows(got, "doc_id", "component_id", "kept") == sorted(
        [(5, 5, True), (None, 5, False), (7, 5, False)] + [(None, None, True)] * 3, key=repr)
    # the two ends of a chain meet over a row without an id
    chain = [" ".join(base), " ".join(base[:54] + ["x"] * 6), " ".join(base[:48] + ["x"] * 12)]
    got = op.near_dedup(documents(spark, chain, ids=[3, None, 9]), percent=70)
    want = [(i, 3) for i in (3, None, 9)]
    assert rows(got, "doc_id", "component_id") == sorted(want, key=repr)


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(3 * op._SLICE))
    got = op.near_dedup(documents(spark, [long, long + " end", "w1 w2 w3 w4 w5"]))
    assert rows(got, "doc_id", "n_shingles", "component_id") == [(0, 3 * op._SLICE - 4, 0), (1, 3 * op._SLICE - 3, 0), (2, 1, 2)]


def test_groups_below_the_threshold_are_not_compared_pair_by_pair(spark, monkeypatch):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))

    def edited(words, places):
        words = list(words)
        for at in places:
            words[at] = word()
        return words

    base = [word() for _ in range(300)]
    other = edited(base, (30, 70, 110, 150, 190, 230, 270))  # similarity 0.79 to base
    texts = [base, other] + [edited(b, r.sample(range(300), 2)) for b, n in ((base, 120), (other, 60)) for _ in range(n)]
    texts = [" ".join(x) for x in texts]
    looked, inner = [], op.open_pairs
    monkeypatch.setattr(op, "open_pairs", lambda *a: looked.append(inner(*a)) or looked[-1])
    got = op.near_dedup(documents(spark, texts), 80).select("doc_id", "n_shingles", "component_id", "kept").collect()
    ids = sorted(x["doc_id"] for x in got)
    assert sorted(map(tuple, got), key=repr) == brute(texts, ids, 80)
    assert len({x["component_id"] for x in got}) == 2
    assert looked[0].count() < 120 * 60 / 20
