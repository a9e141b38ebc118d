import random

import numpy as np

from catamatch.llm import substring_dedup as op
from llm.cases import clashing, documents, rows


def brute(texts, ids, window):
    words = [(t or "").split() for t in texts]
    first = {}
    for i, w in sorted(zip(ids, words)):
        for a in range(len(w) - window + 1):
            first.setdefault(tuple(w[a:a + window]), i)
    out = []
    for i, w in zip(ids, words):
        gone = set()
        for a in range(len(w) - window + 1):
            if first[tuple(w[a:a + window])] < i:
                gone |= set(range(a, a + window))
        out.append((i, " ".join(x for j, x in enumerate(w) if j not in gone), len(w), len(gone)))
    return sorted(out, key=repr)


def corpus(seed, n=60):
    r = random.Random(seed)
    passages = [[r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(8, 60))] for _ in range(8)]
    texts = []
    for _ in range(n):
        w = []
        for _ in range(r.randint(0, 6)):
            p = list(r.choice(passages)) if r.random() < 0.7 else [r.choice("xyzuvw") + str(r.randint(0, 9)) for _ in range(r.randint(1, 30))]
            if r.random() < 0.3 and p:
                p[r.randrange(len(p))] = "edit"
            w += p
        texts.append(r.choice([" ", "\n", " \t"]).join(w))
    return texts + [None, "", "a " * 300, "a " * 200, texts[0], texts[1] + " tail"]


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        ids = list(range(len(texts)))
        random.Random(seed).shuffle(ids)
        docs = documents(spark, texts, ids=ids)
        for rows_, counters in ((2, 8), (1, 1)):
            got = op.substring_dedup(clashing(docs), window=12, gram=4, rows=rows_, counters=counters)
            assert rows(got, "doc_id", "text", "n_words", "n_removed") == brute(texts, ids, 12)


def test_runs_share_the_smallest_gram():
    words = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9], np.uint64)
    g, c, s, e = op.gram_runs(words, 5, 2)
    assert s[0] == 0 and e[-1] == 4 and (s[1:] == e[:-1] + 1).all()
    again = op.gram_runs(np.concatenate([np.array([99], np.uint64), words]), 5, 2)
    assert set(g.tolist()) <= set(again[0].tolist())


def test_cases(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = documents(spark, [long, long, long, long, "x"], ids=[None, None, 4, 4, 5])
    got = rows(op.substring_dedup(docs), "doc_id", "n_removed")
    assert got == sorted([(None, 60), (None, 60), (4, 0), (4, 0), (5, 0)], key=repr)
    assert op.substring_dedup(docs.limit(0)).collect() == []


def test_null_and_repeated_ids_with_different_texts(spark):
    def words(tag, n):
        return " ".join(f"{tag}{i}" for i in range(n))

    passage = words("p", 30)
    texts = [passage + " " + words("a", 5), words("b", 90) + " " + passage, words("c", 90), words("d", 20),
             passage + " " + words("e", 40), words("f", 60) + " " + passage, words("g", 70), "p1 p2", None]
    ids = [1, None, None, None, None, 4, 4, 4, 4]
    removed = [0, 30, 0, 0, 30, 30, 0, 0, 0]
    want = [(i, " ".join(w for w in (t or "").split() if not n or w[0] != "p"), len((t or "").split()), n)
            for i, t, n in zip(ids, texts, removed)]
    got = op.substring_dedup(clashing(documents(spark, texts, ids=ids)), window=12, gram=4)
    assert rows(got, "doc_id", "text", "n_words", "n_removed") == sorted(want, key=repr)


def test_random_texts_under_few_ids(spark):
    for seed in (3, 4):
        texts = corpus(seed)
        r = random.Random(seed)
        ids = [r.choice([1, 2, 3, 4, None]) for _ in texts]
        last = [99 if i is None else i for i in ids]
        want = sorted(((None if i == 99 else i, *rest) for i, *rest in brute(texts, last, 12)), key=repr)
        got = op.substring_dedup(documents(spark, texts, ids=ids), window=12, gram=4)
        assert rows(got, "doc_id", "text", "n_words", "n_removed") == want


def test_text_longer_than_a_piece(spark):
    """A copy of an early passage far behind the first piece of hashed bytes is found, and nothing else goes."""
    from catamatch.llm import words

    fill = [f"w{i}" for i in range(words.PIECE // 4)]
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage), " ".join(fill + passage + ["end"])]
    assert len(texts[1]) > words.PIECE
    docs = documents(spark, texts, ids=[1, 2])
    got = rows(op.substring_dedup(docs), "doc_id", "n_words", "n_removed")
    assert got == [(1, 60, 0), (2, len(fill) + 61, 60)]
