"""Tables that repeat their texts: work on texts must not grow with the repetitions, results must not change."""

import compare
import duckdb
import pytest

import __spark_entry__ as entry
from catamatch.operators import candidates, context, decide, match, ordered, pipeline, stage
from catamatch.plans import queries

SOURCE, TIMES = "/root/testdata/sf0.001", 40


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """(folder, catalogue rows, items): part and orders repeated with shifted keys."""
    folder, con = str(tmp_path_factory.mktemp("repeated")), duckdb.connect()
    n = {}
    for table, shifts in (("part", {"p_partkey": 10**6}), ("orders", {"o_orderkey": 10**7, "o_custkey": 0})):
        cols = [r[0] for r in con.execute(f"DESCRIBE SELECT * FROM '{SOURCE}/{table}.parquet'").fetchall()]
        made = ", ".join(f"{c} + i * {shifts[c]} AS {c}" if c in shifts else c for c in cols)
        con.execute(f"COPY (SELECT {made} FROM '{SOURCE}/{table}.parquet', range({TIMES}) r(i)) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        n[table] = con.execute(f"SELECT count(*) FROM '{folder}/{table}.parquet'").fetchone()[0]
    return folder, n["part"], n["orders"]


@pytest.fixture
def sizes(monkeypatch):
    """Rows of each table that a query writes."""
    seen = []

    def counted(df):
        out = stage.written(df)
        seen.append((out.count(), out.columns))
        return out

    for module in (candidates, context, decide, match, ordered, pipeline, queries):
        if hasattr(module, "written"):
            monkeypatch.setattr(module, "written", counted)
    return seen


def differences(spark, name, folder):
    con = duckdb.connect()
    for table in ("part", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return compare.differences(spark, con, entry.queries()[name], entry.oracle_sql()[name], folder)


@pytest.mark.parametrize("name", ["candidate_topk", "attr_score"])
def test_candidates_grow_with_texts_not_with_repeated_rows(spark, repeated, sizes, name):
    folder, n_rows, _ = repeated
    n, diff = differences(spark, name, folder)
    assert n > 0 and diff == []
    # fifteen rows a catalogue row stood in the blocks before
    assert max(c for c, _ in sizes) < n_rows
    features = [c for c, cols in sizes if "interval" in cols]
    assert features and max(features) <= n_rows // 3


@pytest.mark.parametrize("name", ["residual_explain", "option_bonus", "first_match_in_ranked"])
def test_candidates_are_taken_from_the_first_parts_of_each_description(spark, repeated, monkeypatch, name):
    folder, n_rows, _ = repeated
    given = []
    monkeypatch.setattr(candidates, "first_alike", lambda cat, first=candidates.first_alike: given.append(cat.count()) or first(cat))
    n, diff = differences(spark, name, folder)
    assert n > 0 and diff == []
    # every part was joined with its texts before
    assert len(given) == 1 and given[0] <= candidates.KEPT * n_rows // TIMES


def test_contained_tokens_grow_with_names_not_with_repeated_rows(spark, repeated, sizes):
    folder, n_rows, _ = repeated
    n, diff = differences(spark, "token_contains_topk", folder)
    assert n > 0 and diff == []
    # every catalogue row was written, with all its grams, before
    assert max(c for c, cols in sizes if "form" in cols) < n_rows


@pytest.mark.parametrize("name", ["decision_list", "group_promotion"])
def test_decisions_write_items_twice_at_most(spark, repeated, sizes, name):
    folder, n_rows, n_items = repeated
    n, diff = differences(spark, name, folder)
    assert n > 0 and diff == []
    # three times before, two of them with the forms of every text
    long = [cols for c, cols in sizes if c > n_items // 2]
    assert len(long) <= (2 if name == "decision_list" else 1) and not any("panel_form" in cols for cols in long)
    assert max(c for c, cols in sizes if "interval" in cols) <= n_rows // 3


@pytest.mark.parametrize("name", ["report_detail", "review_diff"])
def test_reports_write_items_once(spark, repeated, sizes, name):
    folder, _, n_items = repeated
    n, diff = differences(spark, name, folder)
    assert n > 0 and diff == []
    # the graded rows were written too before, to be shuffled by panel after they had been shuffled by document
    assert len([cols for c, cols in sizes if c > n_items // 2]) == 1


def test_reviewed_rows_meet_no_load_details(spark, repeated):
    folder, _, _ = repeated
    plan = entry.queries()["review_diff"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    # the rows were joined with their loads before, though the result shows none
    assert "LeftOuter" not in plan


def test_large_documents_are_graded_alike(spark, repeated, monkeypatch):
    folder, _, _ = repeated
    asked = []
    monkeypatch.setattr(pipeline, "large_groups", lambda df, group: asked.append(group) or ordered.large_groups(df, group, 600))
    n, diff = differences(spark, "report_detail", folder)
    assert n > 0 and diff == [] and asked == [["doc_id"]]
