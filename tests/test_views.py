"""Tables derived from the driver tables: same rows as their SQL, texts evaluated once per distinct description."""

import re

import duckdb
from pyspark.sql import functions as F

from catamatch.operators import stage
from catamatch.plans import views


def part_table(path, times):
    """Parts with repeated descriptions, nulls among them; the first of a base is not the first row."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT CAST(abs(i - 500) * 10 + i % 3 AS BIGINT) AS p_partkey,
        CASE WHEN i % 29 = 0 THEN NULL ELSE list_extract(['STANDARD', 'ECONOMY', 'MEDIUM', 'PROMO'], i % 4 + 1) END AS p_type,
        CASE WHEN i % 31 = 0 THEN NULL ELSE i % 5 END AS p_size, 'Brand#' || CAST(i % 3 AS VARCHAR) AS p_brand,
        CASE WHEN i % 37 = 0 THEN NULL ELSE 'red ' || list_extract(['bolt', 'ring', 'rod', 'gizmo', 'other'], i % 5 + 1) END AS p_name
        FROM range({times}) r(i)) TO '{path}/part.parquet' (FORMAT parquet)""")
    return con


def test_catalogue_is_its_sql_and_reads_each_description_once(spark, tmp_path, monkeypatch):
    con = part_table(tmp_path, 3000)
    # the texts are read from the distinct descriptions, not from the rows
    read, sql = [], type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, **tables: (
        read.extend(df.count() for df in tables.values() if "AS name" in text), sql(self, text, **tables))[1])
    mine = views.catalogue(spark, str(tmp_path))
    assert len(read) == 1 and read[0] < 3000 / 2
    asked = con.execute(views.CATALOGUE.format(part=f"'{tmp_path}/part.parquet'"))
    names = [c[0] for c in asked.description]
    theirs = sorted(asked.fetchall(), key=str)
    assert mine.columns == names
    assert sorted((tuple(r) for r in mine.collect()), key=str) == theirs and len(theirs) > 1000


def test_catalogue_tests_no_code_on_the_parts(spark, tmp_path):
    part_table(tmp_path, 3000)
    plan = views.catalogue(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    # parts are read here once, for the join; before, the condition on the codes stood on a second scan of them
    assert len(re.findall(r"Relation \[.*p_brand", plan)) == 1


def test_first_described_rows_are_those_of_the_sql(spark, tmp_path):
    con = part_table(tmp_path, 3000)
    (tmp_path / "unique").mkdir()
    part = f"'{tmp_path}/unique/part.parquet'"
    con.execute(f"COPY (SELECT * FROM '{tmp_path}/part.parquet' QUALIFY row_number() OVER (PARTITION BY p_partkey) = 1) TO {part} (FORMAT parquet)")
    for k in (1, 3, 1000):
        theirs = con.execute(f"""SELECT c.* FROM ({views.CATALOGUE.format(part=part)}) c JOIN {part} p ON p.p_partkey = c.ord
            QUALIFY row_number() OVER (PARTITION BY p_type, p_size, p_brand, split_part(p_name, ' ', 2) ORDER BY ord) <= {k}""").fetchall()
        mine = views.first_described(spark, str(tmp_path / "unique"), k)
        assert sorted((tuple(r) for r in mine.collect()), key=str) == sorted(theirs, key=str) and len(theirs) > 20
        # no part meets a text in a join
        assert "Join" not in mine._jdf.queryExecution().optimizedPlan().toString()


def test_long_expressions_are_compiled(spark):
    limit, d = "spark.sql.codegen.hugeMethodLimit", "/root/testdata/sf0.001"
    before = spark.conf.get(limit)
    try:
        for value, kept in (("65535", stage.COMPILED_BYTES), ("4000", 4000)):
            for view in (views.items, views.catalogue):
                spark.conf.set(limit, value)
                assert view(spark, d).agg(F.count("*")).first()[0] > 0
                assert int(spark.conf.get(limit)) == kept
    finally:
        spark.conf.set(limit, before)
