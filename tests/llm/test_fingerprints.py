import hashlib

import numpy as np

from catamatch.llm import fingerprints as op
from catamatch.llm.queries import op10_fingerprints
from llm.cases import clashing, documents, rows

SF = "/root/testdata/sf0.001"


def sets(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(texts):
    """doc_id -> (text, edited, next) by the definition."""
    order = sorted(texts, reverse=True)
    out = {}
    for i, d in enumerate(order):
        following = texts[order[(i + 1) % len(order)]]
        k = len(texts[d]) // 3
        out[d] = (texts[d], texts[d][:len(texts[d]) - k] + following[:k], following)
    return out


def check(got, texts):
    want, errors = edited(texts), []
    assert len(got) == len(texts)
    for r in got:
        text, changed, following = want[r["doc_id"]]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == op.shown(op.fingerprint(text.encode()))
        assert r["edited_fingerprint"] == op.shown(op.fingerprint(changed.encode()))
        errors += [r["near_edited"] - jaccard(text, changed), r["near_next"] - jaccard(text, following)]
    return np.array(errors)


def test_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    errors = check(op10_fingerprints(spark, SF).collect(), texts)
    assert abs(errors.mean()) < 0.02 and np.abs(errors).mean() < 0.04


def test_chunks(spark, monkeypatch):
    texts = {i * 7 - 50: ("wörd %d " % i) * (i % 9 * 5) for i in range(60)}
    docs = documents(spark, list(texts.values()), ids=list(texts))
    for size in (1, 7, 1000):
        got = op.with_next(clashing(docs), size).collect()
        want = edited(texts)
        assert {r["doc_id"]: (r["text"], r["next"]) for r in got} == {d: (w[0], w[2]) for d, w in want.items()}
        assert len(got) == len(texts)


def test_cases(spark):
    docs = documents(spark, [None, "", "a b", "a b", "only"], ids=[5, 4, 3, 3, None])
    got = op.edited_fingerprints(docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in got) == [(-1, 4), (3, 3), (3, 3), (4, 0), (5, 0)]
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 3}) == 1
    assert {r["near_next"] for r in got if r["doc_id"] == 5} == {1.0}
    assert op.edited_fingerprints(docs.limit(0)).collect() == []
    one = op.edited_fingerprints(documents(spark, ["abcdef"])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one[0]["near_next"] == 1.0
    assert rows(op.fingerprints(docs), "doc_id")[0] == (3,)


def test_estimates_are_unbiased_for_sparse_texts():
    r = np.random.default_rng(3)
    errors = []
    for _ in range(300):
        w = [str(x) for x in r.integers(0, 10**9, 30)]
        v = w[:22] + [str(x) for x in r.integers(0, 10**9, 8)]
        a, b = " ".join(w), " ".join(v)
        errors.append(op.likeness(op.fingerprint(a.encode()), op.fingerprint(b.encode())) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.03


def test_repeated_ids_form_one_ring(spark):
    """Rows that share an id, null ones too, each get a follower; the followers are all the texts."""
    texts = [f"text {i}" for i in range(40)] + ["same"] * 5
    ids = [None if i % 3 == 0 else i // 8 for i in range(45)]
    for parts in (1, 6):
        got = [(r["doc_id"], r["text"], r["next"]) for r in op.with_next(documents(spark, texts, ids=ids), parts).collect()]
        assert sorted(t for _, t, _ in got) == sorted(n for _, _, n in got) == sorted(texts)
        owner = dict(zip(texts, ids))
        rank = lambda d: -1 if d is None else d
        rises = [1 for d, t, n in got if "same" not in (t, n) and rank(owner[n]) > rank(d)]
        assert len(rises) <= 1


def test_edited_with_clashing_columns_and_long_texts(spark):
    texts = {1: "ab " * 400_000, 2: "", 3: "é𝄞x" * 50_001, 4: "w " * 9, 5: "é" * 20}
    docs = clashing(documents(spark, list(texts.values()), ids=list(texts)))
    for parts in (1, 4, None):
        check(op.edited_fingerprints(docs, parts).collect(), texts)
