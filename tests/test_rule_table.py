import pytest
from pyspark.sql import functions as F

from catamatch import rules
from catamatch.operators import decide
from catamatch.operators.ruletable import with_ruling
from catamatch.functions import text as t

TABLE = (
    ("A", "big !red", "own", "x", "{n} big"), ("B", "red big", "own", "y", "{n} and {n}, {gap}"), ("C", "", "", "z", "else"))
SCHEMA = "priority long, rule string, conditions string, code string, conf string, note string"


def ruled(spark, table):
    df = spark.createDataFrame([(1, 200, "red"), (2, 200, "blue"), (3, 1, "red"), (4, None, None), (5, 300, None)],
                               "id int, n int, colour string")
    out = with_ruling(df, table, {"big": F.col("n") > 100, "red": F.col("colour") == "red"}, {"own": F.col("colour")},
                      {"n": F.col("n").cast("string"), "gap": F.lit(None).cast("string")})
    return {r["id"]: tuple(r["sel"]) if r["sel"] else None for r in out.collect()}


def frame(spark, table):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(table)][::-1], SCHEMA)


def test_first_rule_that_fits(spark):
    want = {1: ("B", "red", "y", "200 and 200, "), 2: ("A", "blue", "x", "200 big"), 3: ("C", "", "z", "else"),
            4: ("C", "", "z", "else"), 5: ("A", "", "x", "300 big")}
    assert ruled(spark, TABLE) == want
    assert ruled(spark, frame(spark, TABLE)) == want


def test_order_and_missing_rules(spark):
    got = ruled(spark, frame(spark, (TABLE[2], *TABLE[:2])))
    assert {v[0] for v in got.values()} == {"C"}
    assert ruled(spark, TABLE[:1])[3] is None
    assert set(ruled(spark, frame(spark, ())).values()) == {None}


def test_unknown_conditions_fail(spark):
    bad = (("A", "!huge", "", "x", ""),)
    with pytest.raises(ValueError, match="huge"):
        ruled(spark, bad)
    with pytest.raises(Exception, match="huge"):
        ruled(spark, frame(spark, bad))


def test_more_conditions_than_bits(spark):
    many = {f"c{i}": F.lit(i == 62) for i in range(63)}
    df = spark.range(1)
    assert with_ruling(df, (("Z", "c62 !c0", "", "", ""),), many, {}, {}).first()["sel"]["rule"] == "Z"
    with pytest.raises(ValueError):
        with_ruling(df, (), many | {"c63": F.lit(True)}, {}, {})


def test_codes_and_fields_of_the_built_in_rules(spark):
    """Every name the built-in table uses exists; a table of its rows settles items alike (see test_golden for the results)."""
    assert len({r[1] for r in rules.DECISION_RULES}) == len(rules.DECISION_RULES)
    assert rules.DECISION_RULES[-1][1] == ""


@pytest.mark.parametrize("sym,kw,notes", [
    ("C", "7", ["direct starter 7 -> 7.5 kW"]), ("E", "11", ["direct starter 11 -> 11 kW x2"]),
    ("J", "7.5", ["inverter 7.5 kW", "direct starter as bypass 7.5 kW"]), ("A", "5", ["symbol A: supply only"]),
    ("z", "1", ["symbol Z unknown, check"]), ("C", "x", ["direct starter, check"]), ("", "1", None)])
def test_part_notes(spark, sym, kw, notes):
    df = spark.createDataFrame([(sym, kw, "200V")], "symbol string, kw string, volt string").withColumns({
        "known": t.strings(rules.rule_codes()), "names": F.create_map(F.lit("22021"), F.lit("L-S 7.5kW"))})
    df = decide.with_recipe(df, "symbol", F.col("kw"), F.col("volt"), F.lit(False), "known")
    parts = decide.with_part_notes(df, "symbol", F.col("kw"), "names").first()["parts"]
    assert (parts and [p["note"] for p in parts]) == notes
    for p in parts or []:
        assert p["name"] == ("L-S 7.5kW" if p["code"] == "22021" else "")
