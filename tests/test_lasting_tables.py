"""Alias tables, results that outlive a run, and sinks that replace documents."""

import pathlib
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from catamatch.functions import extract as x
from catamatch.functions import text as t
from catamatch import rules
from catamatch.operators import decide
from catamatch.operators.dictionary import first_aliases
from catamatch.operators.stage import owned_tables, written
from catamatch.plans import views
from catamatch.sources import documents
from catamatch.sources.versioned import VersionedTable, process_new, replace_documents


def test_alias_table_equals_the_case_form(spark):
    names = [(t.squeeze_literal(a), p, i) for i, (a, p) in enumerate(rules.aliases())]
    table = spark.createDataFrame(names, "alias string, part string, priority int")
    d = "/root/testdata/sf0.001"
    forms = views.items(spark, d).select(t.squeeze(t.nfkc(F.col("name"))).alias("form")).distinct()
    extra = [("pf20a",), ("xpf",), ("p",), ("",), (None,), ("apfa",), ("pf",), ("中pf中",), ("va",), ("lgrzct",)]
    forms = forms.unionByName(spark.createDataFrame(extra, "form string")).where("form is not null")
    want = forms.select("form", F.expr(f"CASE {x.first_alias('form')} END").alias("part")).distinct()
    got = forms.distinct().join(first_aliases(forms, table).select("form", "part"), "form", "left")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_a_dictionary_of_100_000_aliases(spark):
    r = random.Random(1)
    aliases = list({"".join(r.choices("abcdefgh", k=r.randrange(1, 9))) for _ in range(140_000)})[:100_000]
    r.shuffle(aliases)
    rank = {a: i // 2 for i, a in enumerate(aliases)}  # ties too
    forms = ["".join(r.choices("abcdefghz9", k=r.randrange(0, 20))) for _ in range(300)]
    table = spark.createDataFrame([(a, a.upper(), n) for a, n in rank.items()], "alias string, part string, priority int")
    want = {}
    for f in forms:
        hits = []
        for size in range(1, 9):
            for i in range(len(f) - size + 1):
                a = f[i:i + size]
                before, after = f[i - 1:i] if i else "", f[i + size:i + size + 1]
                if a in rank and (size > 2 or not ("a" <= before <= "z" or "a" <= after <= "z")):
                    hits.append((rank[a], a))
        if hits:
            want[f] = min(hits)
    got = first_aliases(spark.createDataFrame([(f,) for f in forms], "form string"), table)
    assert {r["form"]: (r["priority"], r["alias"]) for r in got.collect()} == want


OUTCOME = "hash string, n bigint"


def counting(seen):
    def process(new):
        rows = new.collect()
        seen.extend(r["content"] for r in rows)
        return new.select("hash", F.length("content").cast("long").alias("n"))
    return process


def test_only_new_contents_are_processed(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/results", OUTCOME)
    docs = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "doc_id int, content string")
    seen = []
    got = process_new(table, docs, counting(seen))
    assert sorted((r["doc_id"], r["n"]) for r in got.collect() if r["n"]) == [(1, 1), (2, 2), (3, 1)] and got.count() == 4
    assert sorted(seen, key=repr) == sorted(["a", "bb", None], key=repr)
    seen.clear()
    more = docs.unionByName(spark.createDataFrame([(5, "ccc"), (6, "bb")], docs.schema))
    got = process_new(VersionedTable(spark, f"file://{tmp_path}/results", OUTCOME), more, counting(seen))
    assert seen == ["ccc"] and {r["doc_id"]: r["n"] for r in got.collect()} == {1: 1, 2: 2, 3: 1, 4: None, 5: 3, 6: 2}
    assert table.version() == 2


def test_a_run_that_dies_leaves_no_trace(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, f"file://{tmp_path}/results", OUTCOME)
    docs = spark.createDataFrame([(1, "a")], "doc_id int, content string")
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            process_new(table, docs, counting([]))
    assert table.version() == 0 and table.read().collect() == []
    seen = []
    process_new(table, docs, counting(seen))
    assert seen == ["a"] and table.read().count() == 1


def test_two_runs_that_collide(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/results", OUTCOME)
    docs = spark.createDataFrame([(1, "a"), (2, "bb")], "doc_id int, content string")

    def slow(new):
        out = counting([])(new)
        if not table.version():  # another run stores one of the contents first
            process_new(table, docs.where("doc_id = 1"), counting([]))
        return out

    got = process_new(table, docs, slow)
    assert {r["doc_id"]: r["n"] for r in got.collect()} == {1: 1, 2: 2}
    assert table.version() == 2 and sorted(r["n"] for r in table.read().collect()) == [1, 2]
    assert not table.commit({}, 1)


def test_sink_replaces_documents(spark, tmp_path):
    schema = "doc_id bigint, item_idx bigint, note string"
    table = VersionedTable(spark, f"file://{tmp_path}/sink", schema)
    first = spark.createDataFrame([(d, i, f"first {d}") for d in range(30) for i in range(20)], schema).repartition(4)
    order = ["doc_id", "item_idx"]
    replace_documents(table, first, order, slot_docs=10)
    before = table.manifest()
    again = first.where("doc_id in (3, 12)").withColumn("note", F.lit("again")).where("item_idx < 5")
    for _ in range(2):  # a rerun leaves the same
        replace_documents(table, again, order, slot_docs=10, documents=spark.createDataFrame([(14,)], "doc_id bigint"))
        rows = sorted((r["doc_id"], r["item_idx"], r["note"]) for r in table.read().collect())
        want = [(d, i, "again" if d in (3, 12) else f"first {d}") for d in range(30) if d != 14 for i in range(5 if d in (3, 12) else 20)]
        assert rows == want
    after = table.manifest()
    assert sorted(after) == sorted(before) and [k for k in before if before[k] == after[k]] == [f"{2:020d}"]
    # the order holds inside and across files
    read = []
    for _, part in sorted(after.items()):
        for f in sorted((tmp_path / "sink" / part).glob("part-*.parquet")):
            read += [(r["doc_id"], r["item_idx"]) for r in pq.read_table(f).to_pylist()]
    assert read == sorted(read) and len(read) == len(want)


def test_spec_table_equals_built_in_spec(spark):
    order, rows = {}, []
    for cls, attr, required, pattern in rules.attr_spec():
        order[cls] = order.get(cls, -1) + 1
        rows.append((cls, order[cls], attr, required, pattern))
    rows += [("VCB", 9, "unpatterned", True, None), ("vcb", 0, "own spelling", True, "never")]
    spec = spark.createDataFrame(rows, "class string, pos int, attr string, required boolean, pattern string")
    texts = ["VCB 7.2kV 600A 12.5kA", "MCB 3P 100AF", "elb 2p 30/20", "SC 50kvar", "", None, "7.2kv"]
    items = [(p, x) for p in ("VCB", "MCB", "ELB", "SC", "other", None) for x in texts] + [("VCB", texts[0])] * 3
    df = spark.createDataFrame(items, "part string, cname string").withColumn("pattern", F.lit("clash"))
    got = decide.with_missing_attributes(df, "part", "cname", spec)
    want = df.withColumns({"missing_attrs": decide.missing_attributes("part", "coalesce(cname, '?')", True),
                           "missing_opt": decide.missing_attributes("part", "coalesce(cname, '?')", False)})
    blank = F.col("cname").isNull()
    want = want.withColumns({c: F.when(blank, F.array().cast("array<string>")).otherwise(F.col(c))
                             for c in ("missing_attrs", "missing_opt")})
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    lower = spark.createDataFrame([("vcb", "x"), ("Vcb", "x")], "part string, cname string")
    found = {r["part"]: r["missing_attrs"] for r in decide.with_missing_attributes(lower, "part", "cname", spec).collect()}
    assert found["vcb"] == found["Vcb"] and "own spelling" not in found["vcb"]


def test_catalogue_arrays_keep_places_and_failures(spark):
    text = ' [{"code": "1", "name": "a\\n}, {"}, 7, null, {"name": "n"}, {"code": "", "name": "e"}, {"code": "2", "extra": [1]}, {"code": "1"}]'
    df = spark.createDataFrame([(1, text), (2, "[]"), (3, '{"code": "1"}'), (4, None), (5, '[{"code"'), (6, "")], "f int, j string")
    got = sorted(map(tuple, documents.catalogue_rows(df, ["f"], "j").select("f", "ord", "failed", "code", "name").collect()), key=repr)
    assert got == sorted([
        (1, 0, False, "1", "a\n}, {"), (1, 1, True, "", "7"), (1, 2, True, "", ""), (1, 3, True, "", '{"name":"n"}'),
        (1, 4, True, "", '{"code":"","name":"e"}'), (1, 5, False, "2", ""), (1, 6, False, "1", ""),
        (3, None, True, "", '{"code": "1"}'), (4, None, True, "", ""), (5, None, True, "", '[{"code"'), (6, None, True, "", "")], key=repr)


def test_owned_tables_go_with_their_block(spark):
    def held(df):
        return {pathlib.Path(f.removeprefix("file://")).parent for f in df.inputFiles()}

    outside = written(spark.range(3))
    with owned_tables(spark):
        first = written(spark.range(5))
        with owned_tables(spark):
            inner = held(written(first.where("id > 1")))
            assert all(p.exists() for p in inner)
        assert not any(p.exists() for p in inner)
        mine = held(first)
        assert first.count() == 5
    assert mine and not any(p.exists() for p in mine)
    with pytest.raises(ZeroDivisionError), owned_tables(spark):
        late = held(written(spark.range(2)))
        1 / 0
    assert not any(p.exists() for p in late)
    assert outside.count() == 3
