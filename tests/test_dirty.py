"""Dirty inputs with literal expected values: shapes, flags, NULLs, huge numbers, repeated codes."""

import pytest
from pyspark.sql import functions as F

from catamatch.functions import extract as x
from catamatch.operators import ordered
from catamatch.operators.candidates import candidates, catalogue_features, item_features
from catamatch.operators.pipeline import ITEM_FIELDS, select_items
from catamatch.operators.scores import option_bonus
from catamatch.sources import documents as docs
from test_golden import CATALOGUE, one

CAT = "ord long, code string, name string, volt string, kind string, spec string"


def item_table(spark, names):
    rows = [(1, 0, "盤", i, n, *["1" if f == "qty" else False if f in ("load_detail", "unclear", "cable") else ""
                                for f in ITEM_FIELDS[1:]]) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "doc_id long, panel_idx int, panel string, item_idx long, name string, qty string, "
                                 "volt string, symbol string, kw string, grp string, load_detail boolean, unclear boolean, cable boolean")


@pytest.mark.parametrize("raw,text,qty", [
    ("CT×２", "CT", "２"), ("CT×　2", "CT", "2"), ("2.2kW" + " " * 70 + "×2", "2.2kW" + " " * 70 + "×2", None),
    ("2.2kW　×2 VT x3", "2.2kW　×2 VT", "3")])
def test_counts_in_any_script(spark, raw, text, qty):
    assert tuple(one(spark, "s string", (raw,), x.split_quantity(F.col("s")).alias("q"))["q"]) == (text, qty)


def test_feeder_behind_a_wide_blank(spark):
    assert one(spark, "s string", ("　1L1 MCB",), x.feed_number(F.col("s")))[0] == "1L1"


def test_wrong_shapes_are_failures(spark):
    texts = ["123", "[1, 2]", '{"panels": 5}', "no", '{"panels": []}', '{"other": 1}',
             '{"panels": [{"panel": "P", "items": [{"name": "a", "unclear": "true", "load_detail": 1, "cable": 0},'
             ' {"name": "b", "unclear": false, "cable": true, "load_detail": ""}]}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = docs.read_documents(df, ["id"], "t", F.lit("f")).collect()
    assert sorted(r["id"] for r in got if r["name"] == "unreadable") == [0, 1, 2, 3]
    flags = {r["name"]: (r["unclear"], r["load_detail"], r["cable"]) for r in got if r["id"] == 6}
    assert flags == {"a": (True, True, False), "b": (False, False, True)}


def test_null_content_keeps_its_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "a")], "id int, c string")
    done = docs.process_once(df, "c", lambda d: d.select("hash", F.length("c").alias("n")))
    assert sorted((r["id"], r["n"]) for r in done.collect()) == [(1, None), (2, 1), (3, None), (4, 1)]


def test_null_documents_carry_values(spark):
    df = spark.createDataFrame([(None, 0, 0, 1.0), (None, 1, 0, None), (7, 0, 0, None)], "d long, p int, i long, v double")
    got = ordered.last_before(df, ["d"], ["p", "i"], F.col("v"), "last").collect()
    assert sorted((r["d"] or 0, r["p"], r["last"]) for r in got) == [(0, 0, None), (0, 1, 1.0), (7, 0, None)]


def test_whole_texts_are_put_together(spark):
    df = spark.createDataFrame([(1, float(i % 7), float(i // 7), "x" * 50) for i in range(3000)], "d int, x double, y double, t string")
    text = docs.assemble(df, "d", "x", "y", "t").first()["text"]
    assert text.count("\n") == 2999 and len(text) > 170_000


def test_huge_numbers_and_repeated_codes(spark):
    big = "9" * 20
    names = ["VCB 7.2kV 600A 12.5kA", f"CT {big}/5A", f"MCB 3P {big}AF/{big}AT", f"TR 3φ {big}kVA", f"SC {big}kvar", f"MCB 3P50/{big}"]
    cats = [*CATALOGUE, (13, "41101", "VCB 7.2kV 600A 12.5kA 標準", "6.6kV", "", ""), (14, "44999", f"CT {big}/5A~200/5A", "", "", "")]
    got = select_items(item_table(spark, names), spark.createDataFrame(cats, CAT)).collect()
    assert sorted(r["item_idx"] for r in got) == list(range(len(names)))
    first = next(r for r in got if r["item_idx"] == 0)
    assert (first["code"], first["rule"]) == ("41101", "R15")


def test_options_named_twice_count_twice(spark):
    cats = catalogue_features(spark.createDataFrame([(0, "1", "VCB G-RY付", "", "", ""), (1, "2", "VCB", "", "", "")], CAT))
    feats = item_features(spark.createDataFrame([("VCB G-RY付", "")], "cname string, volt string"))
    top = candidates(feats, cats).first()["cands"]
    score = {c["code"]: c["score"] for c in top}
    row = feats.select("form", "opts").first()
    bonus = one(spark, "o array<string>, f string, r string", (row["opts"], row["form"], "vcbgry付"),
                option_bonus(F.col("o"), F.col("f"), F.col("r")))[0]
    assert len(row["opts"]) == 2 and bonus == 10 and score["1"] - score["2"] == 10


def test_other_items_options_do_not_widen_rows(spark):
    """Every catalogue name holds the bracket texts of some item; each item still meets few rows."""
    marks = "0123456789ab"
    names = [f"VCB 7.2kV 600A ({m})" for m in marks]
    feats = item_features(spark.createDataFrame([(n, "") for n in names], "cname string, volt string"))
    best = {}
    for n in (100, 400):
        rows = [(i, str(i), f"VCB 0123456789ab {i}", "", "", "") for i in range(n)]
        got = candidates(feats, catalogue_features(spark.createDataFrame(rows, CAT))).collect()
        assert len(got) == len(marks)
        best[n] = {tuple(c["ord"] for c in r["cands"]) for r in got}
    assert best[100] == best[400]
