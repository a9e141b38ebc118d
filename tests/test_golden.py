"""Hand-made cases (FIXTURES.md, section 2)."""

import pytest
from pyspark.sql import functions as F

from catamatch import rules
from catamatch.functions import extract as x
from catamatch.functions import text as t
from catamatch.operators import context as ctx
from catamatch.operators import decide, lookup, report, scores
from catamatch.operators.pipeline import ITEM_FIELDS, attached_details, select_items


def one(spark, schema, row, *cols):
    return spark.createDataFrame([row], schema).select(*cols).first()


@pytest.mark.parametrize("raw,form", [
    ("VCB 7.2kV 600A 12.5kA", "vcb72kv600a125ka"), ("Ｍ）ＭＣＢ ３Ｐ", "mmcb3p"), ("インバータ", "インバタ"),
    ("ｶﾞｽ ㌔", "ガスキロ"), (None, "")])
def test_squeeze(spark, raw, form):
    assert one(spark, "s string", (raw,), t.squeeze(t.nfkc(F.col("s"))))[0] == form


@pytest.mark.parametrize("raw,text,qty", [
    ("PF×3 40A", "PF 40A", "3"), ("SC 7.2kV 50kvar(SC×3)", "SC 7.2kV 50kvar(SC)", "3"), ("CT×2", "CT", "2"),
    ("2.2kW×2", "2.2kW×2", None), ("DS×3 7.2kV 600A", "DS 7.2kV 600A 3P", None), ("MCB 600A×3", "MCB 600A", "3"),
    ("2.2kW×2 MCB x4", "2.2kW×2 MCB", "4"), ("A×1234", "A×1234", None)])
def test_quantity(spark, raw, text, qty):
    assert tuple(one(spark, "s string", (raw,), x.split_quantity(F.col("s")).alias("q"))["q"]) == (text, qty)


@pytest.mark.parametrize("form,af,at", [
    ("225af/200at", "225", "200"), ("mcb3p225/150", "225", "150"), ("mcb3p225", "225", None), ("mcb3p50/3015kw", "50", "30")])
def test_frame(spark, form, af, at):
    df = x.with_frame(spark.createDataFrame([(form,)], "f string"), "f")
    assert tuple(df.select("af", "at").first()) == (af, at)


@pytest.mark.parametrize("text,vals", [
    ("VCB 7.2kV 600A 12.5kA", {"HV", "600A", "12.5kA"}), ("MCB 3P 225AF/200AT", {"3P", "225AF", "200AT"}),
    ("CT 150/5A", {"150/5A"}), ("SPD クラスII 20.0kA", {"クラスii", "20kA"}), ("MDF 50P", {"50P", "0P"})])
def test_values(spark, text, vals):
    assert set(one(spark, "s string", (text,), x.attribute_values("s"))[0]) == vals


@pytest.mark.parametrize("vals,row,name,score", [
    (["HV", "600A", "12.5kA"], ["HV", "600A", "20kA"], "VCB", 12),
    (["150/5A"], ["100/5A", "200/5A"], "CT 100/5A~200/5A", 10), ([], ["HV"], "VCB", 0)])
def test_value_score(spark, vals, row, name, score):
    got = one(spark, "v array<string>, r array<string>, n string", (vals, row, name),
              scores.value_score(F.col("v"), F.col("r"), x.interval_of_name(F.col("n"))))
    assert got[0] == score


@pytest.mark.parametrize("kind,value,step,clamped", [
    ("direct", "4", 5.5, False), ("direct", "80", 75.0, True), ("inverter", "0.5", 0.75, False)])
def test_round_up(spark, kind, value, step, clamped):
    got = one(spark, "v string", (value,), lookup.round_up(F.col("v"), rules.MOTOR_SUFFIX[kind]).alias("r"))["r"]
    assert tuple(got) == (step, clamped)
    assert one(spark, "v string", ("x",), lookup.round_up(F.col("v"), rules.MOTOR_SUFFIX[kind]).alias("r"))["r"] is None


@pytest.mark.parametrize("value,code", [(40, "44121"), (41, "44122"), (75, "44122"), (200, "44123"), (201, None)])
def test_bucket(spark, value, code):
    assert one(spark, "v int", (value,), lookup.bucket(F.col("v"), rules.CT_HV_BUCKETS))[0] == code


@pytest.mark.parametrize("sym,kw,volt,parts", [
    ("J", "7.5", "200V", [("22023", 1), ("22021", 1)]), ("E", "11", "400V", [("26031", 2)]),
    ("A", "5", "200V", [("", 1)]), ("C", "x", "200V", [("", 1)]), ("Z", "1", "200V", [("", 1)])])
def test_recipe(spark, sym, kw, volt, parts):
    df = spark.createDataFrame([(sym, kw, volt)], "symbol string, kw string, volt string").withColumn(
        "known", t.strings(rules.rule_codes()))
    got = decide.with_recipe(df, "symbol", F.col("kw"), F.col("volt"), F.lit(False), "known").first()["parts"]
    assert [(p["code"], p["qty"]) for p in got] == parts


def test_rate_rounds_half_to_even(spark):
    df = spark.createDataFrame([(g,) for g in "◎◎◎◎◎△△△——"], "conf string")
    assert tuple(report.summary(df).first()) == (8, 5, 0, 3, 2, 62)


def test_alias_order(spark):
    got = [one(spark, "f string", (f,), x.detect_part("f"))[0] for f in ("mctt3p", "vmc200a", "mmccb3p", "6600vs210v", "tl3φ50kva")]
    assert got == ["MCTT", "VCS", "M)MCB", "VS", "TR"]


CATALOGUE = [
    (0, "42075", "マルチ指示計 MDA", "", "", ""), (1, "46401", "LGR ZCT付", "", "", ""), (2, "47501", "ZCT 100A", "", "", ""),
    (3, "71001", "電圧計 標準", "", "", ""), (4, "50903", "TB 225A", "", "", ""), (5, "60103", "M)MCB 3P 100AF", "", "", ""),
    (6, "50103", "M)MCB 3P 100AF/100AT", "", "", ""), (7, "40533", "MCB 3P 50AF", "", "", ""), (8, "22021", "L-S 7.5kW", "200V", "", ""),
    (9, "45101", "TR 3φ3W 75kVA 支給品", "", "", ""), (10, "45102", "TR 3φ3W 100kVA 支給品", "", "", ""),
    (11, "41101", "VCB 7.2kV 600A 12.5kA 標準", "6.6kV", "", ""), (12, "41102", "VCB 7.2kV 600A 20kA 引出", "6.6kV", "", ""),
]
ROWS = [
    # doc, panel_idx, panel, item_idx, name, extra fields
    (1, 0, "動力制御盤", 0, "M)MCB 3P 100AF/100AT", {}), (1, 0, "動力制御盤", 1, "CVT60", {}),
    (1, 0, "動力制御盤", 2, "端子台 225A", {}), (1, 0, "動力制御盤", 3, "1L1 MCB3P 50/30", {}),
    (1, 0, "動力制御盤", 4, "L-1A 5kVA", {"load_detail": True}), (1, 0, "動力制御盤", 5, "L-2A 3kVA", {"load_detail": True}),
    (1, 0, "動力制御盤", 6, "F×3 3A", {}), (1, 0, "動力制御盤", 7, "マルチ指示計", {}),
    (1, 1, "受電盤", 0, "L-9 1kVA", {"load_detail": True}), (1, 1, "受電盤", 1, "V", {}), (1, 1, "受電盤", 2, "LGR", {}),
    (1, 1, "受電盤", 3, "ZCT", {}), (1, 1, "受電盤", 4, "TR 3φ 90kVA 6.6kV/210V", {}), (1, 1, "受電盤", 5, "TR 3φ 750kVA", {}),
    (1, 1, "受電盤", 6, "VCB 7.2kV 600A 12.5kA", {}), (1, 1, "受電盤", 7, "ポンプ", {"symbol": "C", "kw": "7"}),
    (1, 1, "受電盤", 8, "VCB 7.2kV 600A 12.5kA", {"unclear": True}), (1, 1, "受電盤", 9, "ZCT 100A", {"grp": "LGR"}),
    (2, 0, "盤", 0, "V", {}), (2, 0, "盤", 1, "ZCT 100A", {"grp": "LGR"}), (2, 0, "盤", 2, "MCB 3P CVT60 50/30", {}),
]


@pytest.fixture(scope="module")
def items(spark):
    empty = {"qty": "1", "load_detail": False, "unclear": False, "cable": False}
    data = [(*r[:5], *[r[5].get(f, empty.get(f, "")) for f in ITEM_FIELDS[1:]]) for r in ROWS]
    return spark.createDataFrame(data, "doc_id long, panel_idx int, panel string, item_idx long, name string, qty string, "
                                 "volt string, symbol string, kw string, grp string, load_detail boolean, unclear boolean, cable boolean")


@pytest.fixture(scope="module")
def graded(spark, items):
    cat = spark.createDataFrame(CATALOGUE, "ord long, code string, name string, volt string, kind string, spec string")
    return {(r["doc_id"], r["panel_idx"], r["item_idx"]): r for r in select_items(items, cat).collect()}


def test_pipeline(graded):
    pick = {k: (r["rule"], r["code"], r["conf"]) for k, r in graded.items()}
    assert pick[1, 0, 0] == ("R4", "50103", "◎")
    assert pick[1, 0, 2] == ("R1", "50903", "○")          # the cable row between is gone first
    assert pick[1, 0, 3] == ("R4", "40533", "◎")
    assert pick[1, 0, 7][1:] == ("42075", "△")
    assert pick[1, 1, 1][1:] == ("42075", "△") and graded[1, 1, 1]["carried"]
    assert pick[1, 1, 2] == ("R11", "46401", "◎")
    assert pick[1, 1, 3][1:] == ("", "—") and graded[1, 1, 3]["absorbed"]
    assert pick[1, 1, 4] == ("R7", "45102", "○")
    assert pick[1, 1, 5] == ("R7", "", "△")
    assert pick[1, 1, 6] == ("R15", "41101", "○")
    assert pick[1, 1, 7] == ("SYMBOL", "22021", "◎")
    assert pick[1, 1, 8][1:] == ("41101", "△")
    assert pick[2, 0, 1][1:] == ("47501", "◎")
    assert pick[2, 0, 2][:2] == ("R4", "40533")
    assert graded[2, 0, 0]["carried"] is False
    gone = {(1, 0, 1), (1, 0, 4), (1, 0, 5), (1, 0, 6), (1, 1, 0)}
    assert set(graded) == {r[:2] + (r[3],) for r in ROWS} - gone


def test_details_and_display(graded, items):
    row = graded[1, 0, 3]
    assert row["loads"] == ["L-1A", "L-2A"] and row["feed"] == "1L1"
    assert row["display"] == "MCB3P 50/30 〈1L1〉(L-1A, L-2A)"
    got = sorted((r["parent_idx"], r["load"]) for r in attached_details(items).collect())
    assert got == [(3, "L-1A"), (3, "L-2A")]               # the detail that opens a panel is lost


def test_lists_hold_every_load(spark):
    d = spark.createDataFrame([(1, 0, 0, i, "x" * 10) for i in range(1, 5)] + [(1, 0, 9, 10, "y")],
                              "doc_id long, panel_idx int, parent_idx long, item_idx long, load string")
    got = {r["item_idx"]: (r["loads"], r["n_loads"]) for r in ctx.loads_per_parent(d).collect()}
    assert got == {0: (["x" * 10] * 4, 4), 9: (["y"], 1)}


def test_no_code_outside_the_catalogue(graded):
    known = {c[1] for c in CATALOGUE} | {""}
    assert {r["code"] for r in graded.values()} <= known
    for r in graded.values():
        ranks = [c["rn"] for c in r["candidates"] or []]
        assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) <= 5
