"""The pipeline stage by stage against brute force on a small table."""

import importlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from catamatch.llm.common import table
from llm.cases import clashing, documents, rows
from llm.test_line_dedup import brute as line_brute
from llm.test_near_dedup import brute as near_brute
from llm.test_packing import gapless

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = pipeline.written(stage(spark, docs, SF))
        assert docs.columns == columns
        after = docs.collect()
        kept[name] = (before, after)
    before, after = kept["language ID"]
    gone = set(before) - {r["doc_id"] for r in after}
    assert all(not any(c.isalpha() for c in before[d]["text"] or "") for d in gone)
    before, after = kept["line dedup"]
    want = line_brute([r["text"] for r in before.values()], list(before))
    assert sorted((r["doc_id"], r["text"]) for r in after) == sorted((w[0], w[1]) for w in want)
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = kept["MinHash near-dedup"]
    want = near_brute([r["text"] for r in before.values()], list(before), 80)
    assert sorted(r["doc_id"] for r in after) == sorted(w[0] for w in want if w[3])
    before, after = kept["mixing sources"]
    taken = {}
    for r in after:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(r["text"].split())
    assert all(n <= 3 * len(before[d]["text"].split()) for d, n in taken.items())
    out = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert gapless(out) <= -(-sum(r["length"] for r in out) // 2048) * 1.02 + 1
    tokens = Tokenizer.from_file(public_tokenizers.path(pipeline.VOCABULARY))
    assert sum(r["length"] for r in out) == sum(len(tokens.encode(r["text"], add_special_tokens=False).ids) + 1 for r in after)


def test_run_and_registration(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries()["pipeline"](spark, SF).count() > 0
    assert sorted(n for n in entry.queries() if n.startswith("op") and n[2].isdigit()) == sorted(
        ["op1_exact_dedup", "op2_personal_data", "op3_mix", "op4_pack", "op5_near_dedup", "op6_url_filter", "op7_line_dedup",
         "op8_substring_dedup", "op9_language", "op10_fingerprints", "op11_sentence_pieces", "op12_conversation_repair",
         "op13_lexical_search"])


def test_stages_take_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_stages_with_nulls_repeats_and_clashing_columns(spark):
    """The defined results of the module's docstring, over a table that has every odd row at once."""
    clean = [f"the garden number {i} has {i * 7} trees and {i * 13} stones by the house of {i * 3} people" for i in range(24)]
    texts = [*clean, None, "", "12 ?!", clean[0], clean[1], "a second text under a used id with words of its own", clean[2], clean[2]]
    ids = [*range(24), 24, 25, 26, 40, None, 3, None, 2]
    docs = clashing(documents(spark, texts, langs=["en"] * len(texts), sources=[None, "a", "b", "a"] * 8, ids=ids))
    columns, kept = docs.columns, []
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.written(stage(spark, docs, SF))
        assert docs.columns == columns, name
        kept.append(rows(docs, "doc_id", "text"))
    language, lines, near, _ = kept
    odd = {None, "", "12 ?!"}
    assert language == sorted([(d, t) for d, t in zip(ids, texts) if t not in odd], key=repr)
    assert {(3, clean[3]), (3, "a second text under a used id with words of its own")} <= set(near)
    left = [(d, t) for d, t in lines if t]
    assert {t for _, t in near if t} == {t for _, t in left}
    # repeated rows of the document that stays are that document
    assert len({r for r in near if r[1]}) == len({t for _, t in left})
    out = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert out and gapless(out) >= 1
