import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catamatch.llm import queries
from catamatch.llm import sentence_pieces as op
from llm.cases import clashing, documents, rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "a", " two  blanks \t\n", "▁ mark▁", "<s></s><unk><0x41>", "\x00​", "é中😀ﬁ①", "x" * 100_000,
         "same words " * 5000, "ab" * 41 + " " + "中" * 60, "trailing ", "กำ ຳ", "same", "same"]


@pytest.fixture(scope="module")
def own():
    return op.Agenda(MODEL)


def test_against_the_library(spark, own):
    docs = clashing(documents(spark, TEXTS, ids=[i if i % 7 else None for i in range(len(TEXTS))]))
    got = op.decoded(op.encoded(docs, MODEL), MODEL)
    want = [own.library.encode(t or "") for t in TEXTS]
    assert rows(got, "ids", "text") == sorted([(i, own.library.decode(i)) for i in want], key=repr)
    assert all(r["agreed"] for r in got.collect())
    assert op.decoded(op.encoded(docs.limit(0), MODEL), MODEL).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab th▁ \n.é中<0x41>ing", max_size=60) | st.text(max_size=20), max_size=8))
def test_batches(own, texts):
    ids, agreed = own.encode(texts)
    assert [i.tolist() for i in ids] == own.library.encode(texts) and all(agreed)


def test_heap_and_rounds_are_the_same(own):
    parts = ["▁" + w for w in "unbelievable internationalisation aaaaaaaaaaaa ththththing 中文字 x,y;z".split()]
    assert own.together(parts) == [own.alone(p) for p in parts]


def test_remembered_parts_are_bounded(own, monkeypatch):
    monkeypatch.setattr(op, "REMEMBERED", 5)
    for i in range(40):
        texts = [f"word{i} again {i * 7}", "again " * 3 + "w" * 100]
        assert [x.tolist() for x in own.encode(texts)[0]] == own.library.encode(texts)
    assert len(own.known) < 12 and not any(len(p) > op.SHORT for p in own.known)


def test_other_models_are_refused(monkeypatch):
    monkeypatch.setattr(op, "_MERGE_TYPE", 1)
    with pytest.raises(ValueError):
        op.Agenda(MODEL)


def test_query(spark, own, tmp_path):
    documents(spark, TEXTS).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_sentence_pieces(spark, str(tmp_path))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [own.library.encode(t or "") for t in TEXTS]
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(
        [(k, len(i), digest(",".join(map(str, i))), digest(own.library.decode(i))) for k, i in enumerate(want)], key=repr)
