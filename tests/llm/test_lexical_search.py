import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catamatch.llm import lexical_search as op
from llm.cases import clashing, documents, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "item_id bigint, text string"


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(texts, ids, items, k=10):
    bags = [Counter(terms(t)) for t in texts]
    many = sum(bool(b) for b in bags)
    length = sum(sum(b.values()) for b in bags)
    out = []
    for name, text in dict.fromkeys(items):
        found = []
        for i, b in zip(ids, bags):
            score = 0
            for t in terms(text):
                if b[t]:
                    df = sum(t in o for o in bags)
                    w = math.floor(1000 * math.log((2 * many + 2) / (2 * df + 1)))
                    m = 100 - 75 + 75 * sum(b.values()) * many // length
                    score += w * (1000000000 * b[t] // (1000 * b[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(name, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def corpus():
    r = random.Random(2)
    words = "the of and Apple apple pear42 Éa éa 中文 zebra x_y can't".split()
    texts = [" ".join(r.choices(words, k=r.randrange(1, 12))) for _ in range(60)]
    texts += ["Apple pie."] * 30 + [None, "", " \x1c!", "rare", "word " * 30_000 + "rare"]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    ids[3] = None
    ids[5] = ids[6]
    return texts, ids


ITEMS = [(1, "the apple"), (2, "THE the rare"), (3, None), (4, "!"), (5, "éa Éa 中文"), (5, "zebra"), (5, "zebra"),
         (None, "pie apple"), (7, "unseen"), (8, "can't x_y")]


@pytest.mark.parametrize("most", [1 << 18, 8])
def test_against_brute_force(spark, most):
    texts, ids = corpus()
    docs = clashing(documents(spark, texts, ids=ids)).repartition(5)
    items = spark.createDataFrame(ITEMS, SCHEMA)
    for c in ("doc_id", "rank", "score", "n", "bag"):
        items = items.withColumn(c, items["text"])
    got = op.search(docs, items, most_terms=most)
    assert rows(got, "item_id", "rank", "doc_id", "score") == brute(texts, ids, ITEMS)


def test_members_of_a_class_expand_in_order(spark):
    texts = ["one two", "two one!", "ONE two"] * 40 + ["one three three"]
    ids = list(range(len(texts)))[::-1]
    got = op.search(documents(spark, texts, ids=ids), spark.createDataFrame([(1, "one two"), (2, "three")], SCHEMA), k=5)
    assert rows(got, "item_id", "rank", "doc_id", "score") == brute(texts, ids, [(1, "one two"), (2, "three")], 5)
    groups = op.classes(op.bags(documents(spark, texts, ids=ids), op.Items([(1, b"one two")])), 121, 243, 5).collect()
    assert sorted(r["members"] for r in groups) == [[0], [1, 2, 3, 4, 5]]


def test_empty(spark):
    docs, items = documents(spark, ["a"]), spark.createDataFrame(ITEMS, SCHEMA)
    assert op.search(docs.limit(0), items).collect() == []
    assert op.search(docs, items.limit(0)).collect() == []
    assert op.search(documents(spark, [None, "!"]), items).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZ09 \x1c\x85_é中@[`{\x7f\n", max_size=30))
def test_terms(text):
    assert [t.decode() for t in op.terms(text.encode())] == terms(text)
