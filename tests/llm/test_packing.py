import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from catamatch.llm import packing
from catamatch.llm.queries import op4_pack
from llm.cases import clashing, documents, rows

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(VOCABULARY)


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="aAbs'é É\n\t\r\x0b\x1ć  19.,<|>Σßİ", max_size=40))
def test_ids_of_chunks_are_those_of_the_text(text):
    ids = np.frombuffer(packing.encoder(VOCABULARY).ids(text), "<u4").tolist()
    assert ids == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_special_strings():
    for text in ("a <|endoftext|> b", "x<|startoftext|>y"):
        ids = np.frombuffer(packing.encoder(VOCABULARY).ids(text), "<u4").tolist()
        assert ids == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 2000), max_size=32))
def test_plan_holds_every_piece_once(histogram):
    configs = packing.plan(histogram, 32, 40)
    held = sum((c * n for c, n in configs), np.zeros(33, np.int64))
    assert {i: int(v) for i, v in enumerate(held) if v} == histogram
    assert all((c * np.arange(33)).sum() <= 32 for c, _ in configs)


def test_pricing_is_the_best_multiset():
    values = np.zeros(13)
    values[[3, 4, 5]] = 3.0, 4.4, 5.1
    assert packing.price(values, 12)[[3, 4, 5]].tolist() == [0, 3, 0]


def gapless(got):
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    return len(by)


def test_query(spark):
    got = op4_pack(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces = {(r["doc_id"], r["piece"]): r for r in got}
    assert len(pieces) == len(got)
    for doc, text in docs.items():
        ids = np.array([*TOKENIZER.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for i, at in enumerate(range(0, len(ids), 2048)):
            r = pieces.pop((doc, i))
            assert (r["start"], r["length"]) == (at, len(ids[at:at + 2048]))
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + 2048].tobytes())
    assert not pieces
    assert gapless(got) <= -(-sum(r["length"] for r in got) // 2048) * 1.01 + 1


def test_cases(spark):
    docs = documents(spark, [None, "", "a b", "a b", "word " * 5000, "x"], ids=[1, 2, 3, 3, 4, None])
    packed = packing.pack(packing.token_pieces(clashing(docs), VOCABULARY))
    got = packed.collect()
    gapless(got)
    assert rows(packed.where("doc_id <> 4 or doc_id is null"), "doc_id", "length") == sorted(
        [(1, 1), (2, 1), (3, 3), (3, 3), (None, 2)], key=repr)
    assert [r["length"] for r in sorted((r for r in got if r["doc_id"] == 4), key=lambda r: r["piece"])] == [2048, 2048, 905]
    assert packing.pack(packing.token_pieces(docs.limit(0), VOCABULARY)).collect() == []
    whole = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(r["length"] for r in got)


def test_parts_in_use_outlive_a_full_memory(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 50)
    encode, whole = packing.Encoder(VOCABULARY), packing.Encoder(VOCABULARY).tokenizer
    asked = []

    class Counted:
        def __init__(self, merges):
            self.merges = merges

        def tokenize(self, form):
            asked.append(form)
            return self.merges.tokenize(form)

    encode.merges = Counted(encode.merges)
    for i in range(400):
        text = f"the größe àþÿ° of q{chr(97 + i % 26)}z{chr(97 + i // 26)}x"
        ids = np.frombuffer(encode.ids(text), "<u4").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids
        assert len(encode) <= 50 and len(encode.before) <= 50
    # it was read again after each of the emptyings before
    assert asked.count("the") == 1
