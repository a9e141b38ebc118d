import zlib

from catamatch.llm import language as op
from catamatch.llm.queries import op9_language
from llm.cases import clashing, documents, rows

SF = "/root/testdata/sf0.01"
SAMPLE = {"en": "the house and the garden with this thing", "de": "das haus und der garten mit dieser sache",
          "fr": "la maison et le jardin avec cette chose", "es": "la casa y el jardín con esta cosa"}


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op9_language(spark, SF).collect()
    assert len(got) == len(truth)
    seen = [r for r in got if r["held_out"]]
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not op.has_letter(truth[r["doc_id"]][1] or ""))
    right = sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in seen)
    assert right >= 0.97 * len(seen)


def small(spark):
    texts, langs = [], []
    for i in range(60):
        lang = list(SAMPLE)[i % 4]
        words = SAMPLE[lang].split()
        texts.append(" ".join(words[i % 5:] + words[:i % 5]))
        langs.append(lang)
    return documents(spark, texts + [None, "", "123 ?!", "x", "é" * 10], langs + ["en", None, "de", None, "xx"])


def test_cases(spark):
    docs = small(spark)
    got = {r["doc_id"]: r for r in op.identify(clashing(docs)).collect()}
    assert len(got) == 65
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (60, 61, 62))
    assert got[63]["lang_pred"] in {*SAMPLE, "xx"}
    assert sum(got[i]["lang_pred"] == list(SAMPLE)[i % 4] for i in range(60)) >= 58
    assert rows(op.identify(docs), "doc_id", "lang_pred", "score") == rows(op.identify(docs.repartition(5)), "doc_id", "lang_pred", "score")
    kept = op.accepted(clashing(docs))
    assert kept.columns == clashing(docs).columns and not {60, 61, 62} & {r["doc_id"] for r in kept.collect()}


def test_nothing_to_learn_from(spark):
    docs = documents(spark, ["abc", None], langs=[None, None])
    assert rows(op.identify(docs), "lang_pred", "score") == [("und", 0.0), ("und", 0.0)]
    assert op.identify(docs.limit(0)).collect() == []
    one = documents(spark, ["abc"] * 8 + ["zz"], langs=["en"] * 9, ids=[*range(8), None])
    assert {r["lang_pred"] for r in op.identify(one).collect()} == {"en"}


def test_labels_of_held_out_documents_are_not_used(spark):
    docs = small(spark)
    other = docs.withColumn("lang", op.F.when(op.held_out(), "zz").otherwise(op.F.col("lang")))
    assert rows(op.identify(docs), "doc_id", "lang_pred", "score") == rows(op.identify(other), "doc_id", "lang_pred", "score")


def test_pieces(monkeypatch):
    text = "some text of words ".encode() * 30
    whole = op.features(text)
    monkeypatch.setattr(op, "PIECE", 64)
    assert abs(op.features(text) - whole).max() < 1e-6
    assert op.features(b"").sum() == 0


def test_accepted_without_a_model(spark):
    docs = clashing(documents(spark, ["abc", None, "", "12 ?!", "é 1", "x"], langs=[None] * 6, ids=[0, 1, 2, 3, 4, None]))
    kept = op.accepted(docs)
    assert kept.columns == docs.columns and rows(kept, "doc_id", "text") == [(0, "abc"), (4, "é 1"), (None, "x")]
    assert op.accepted(docs.limit(0)).collect() == []


def test_very_long_and_tied_texts(spark):
    """Long texts go through in pieces like short ones; equal texts under two languages get one of them, the same for both."""
    docs = small(spark)
    long = documents(spark, [SAMPLE["fr"] + " ", " ".join([SAMPLE["de"]] * 40_000)], langs=[None, None], ids=[1000, 1001])
    got = {r["doc_id"]: r["lang_pred"] for r in op.identify(docs.unionByName(long)).collect()}
    assert (got[1000], got[1001]) == ("fr", "de")
    tied = documents(spark, ["same words here"] * 80, langs=["en", "de"] * 40)
    preds = rows(op.identify(tied).select("lang_pred", "score").distinct(), "lang_pred", "score")
    assert len(preds) == 1 and preds[0][0] in ("en", "de")
    assert preds == rows(op.identify(tied.repartition(7)).select("lang_pred", "score").distinct(), "lang_pred", "score")
