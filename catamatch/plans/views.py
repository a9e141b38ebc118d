"""Item and catalogue tables derived from the driver tables.

``orders`` become drawing items and ``part`` becomes the product catalogue, row by row, so
both grow with the tables.  The text is plain SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catamatch.operators.ordered import first_per_group
from catamatch.operators.stage import compilable, written

_KW = "0.75,1.5,2.2,3.7,5.5,7.5,11,15,18.5,22,30,37,45,55,75,90"
_FRAMES = "50,100,225,400,600,800"


def pick(words: str, key: str) -> str:
    return f"split_part('{words}', ',', CAST(({key}) % {len(words.split(','))} + 1 AS INT))"


def div(a: str, b: int) -> str:
    return f"CAST(floor(({a}) / {b}) AS BIGINT)"


_ITEM_TEXTS = [
    f"'MCB3P ' || {pick(_FRAMES, 'u')} || '/' || {pick('30,50,100,200,3015', div('u', 6))}",
    f"'ELB 2P ' || {pick(_FRAMES, 'u')} || 'AF/' || {pick('20,30,75,200', div('u', 6))} || 'AT'",
    f"'M)MCB 3P ' || {pick(_FRAMES + ',125', 'u')} || 'AF/' || {pick('50,100,150', div('u', 7))} || 'AT'",
    "'B)MCB 2P 50AF/20AT×' || CAST(u % 4 + 1 AS VARCHAR(9))",
    "'1L' || CAST(u % 9 AS VARCHAR(9)) || ' MCCB 3P 100/75'",
    f"'VCB 7.2kV ' || {pick('200,400,600', 'u')} || 'A ' || {pick('8,12.5,20', div('u', 3))} || 'kA' || {pick(',(電動), 引出,', div('u', 9))}",
    f"'VMC 6.6kV ' || {pick('200,400', 'u')} || 'A'",
    f"'DS 7.2kV ' || {pick('200,400,600', 'u')} || 'A' || {pick(', 1P, 3P', div('u', 3))}",
    f"'DS×3 7.2kV ' || {pick('200,400,600', 'u')} || 'A'",
    f"'LBS 7.2kV ' || {pick('200,400', 'u')} || 'A PF' || {pick('30,40', div('u', 2))} || 'A'",
    f"'CT ' || {pick('10,15,30,40,60,75,100,150,200,250,300,400', 'u')} || '/5A'",
    f"'端子台 ' || {pick('50,100,150,225,400,600', 'u')} || 'A'",
    f"'TR ' || {pick('1φ,3φ', 'u')} || ' ' || {pick('10,20,30,50,75,100,150,200,300,500,750', div('u', 2))} || 'kVA ' || {pick('6.6kV/210V,6600/210V,6600V,', div('u', 22))}",
    f"'SC 7.2kV ' || {pick('10.6,25,50,75,100,200', 'u')} || 'kvar(SC×3)'",
    f"'SR ' || {pick('1.6,3.19,6.38,12.8', 'u')} || 'kvar' || {pick(' L=6%, 200V, 234V', div('u', 4))}",
    f"'LGR' || {pick(', 2段警報, 0.2A', 'u')}",
    f"'ZCT ' || {pick('50,100,200', 'u')} || 'A'",
    f"{pick('マルチ指示計,デジタルマルチメーター,MDA', 'u')} || ' 多機能'",
    pick('V,VM,電圧計,A,電流計,THR', 'u'),
    f"'L-S ' || {pick(_KW, 'u')} || 'kW'",
    f"'インバータ ' || {pick(_KW, 'u')} || 'kW' || {pick('(支給),', div('u', 16))}",
    f"'動力 ' || {pick(_KW, 'u')} || 'kW'",
    "'動力負荷' || CAST(u % 7 AS VARCHAR(9))",
    "'L-' || CAST(u % 20 AS VARCHAR(9)) || 'A 5kVA CVT14'",
    f"{pick('CVT,CV,FP,KIV', 'u')} || CAST(u % 100 + 1 AS VARCHAR(9))",
    pick('F×3 3A,F,計器ヒューズ,fx2 3A', 'u'),
    f"'XYZ ' || {pick('50,100,200', 'u')} || 'A' || {pick(', 標準, 電動', div('u', 3))}",
    f"'SPD用MCCB 3P' || {pick(', 50AF,', 'u')}",
    f"'SPD クラスII 3P ' || {pick('20,25', 'u')} || 'kA'",
    "'コンセント 2P 15A×' || CAST(u % 12 + 1 AS VARCHAR(9))",
    f"'WHM ' || {pick('1φ,3φ', 'u')} || {pick(' 検付,', div('u', 2))}",
    f"'PF×3 ' || {pick('20,40,60', 'u')} || 'A'",
    f"'OVGR ZPD付 ' || {pick('静止型,標準', 'u')}",
    f"'PAS 7.2kV ' || {pick('200,300', 'u')} || 'A SOG付'",
    "'2.2kW×2 ' || '電動機'",
]
_N = len(_ITEM_TEXTS)

ITEMS = f"""
SELECT c AS doc_id, panel_idx,
       {pick('受電盤,動力制御盤,電灯分電盤,高圧コンデンサ盤,M1盤', 'c + panel_idx')} AS panel,
       k AS item_idx,
       CASE m {' '.join(f'WHEN {i} THEN {s}' for i, s in enumerate(_ITEM_TEXTS))} END AS name,
       CAST(u % 5 + 1 AS VARCHAR(9)) AS qty,
       CASE WHEN m IN (10, 19) THEN {pick('HV,200V,400V,', 'u')} WHEN m = 22 THEN {pick(',400V', 'u')} ELSE '' END AS volt,
       CASE WHEN m IN (21, 22) THEN {pick('A,B,C,D,E,F,G,H,I,J,K,L,Z', div('u', 5))} ELSE '' END AS symbol,
       CASE WHEN m = 22 THEN {pick('0.4,2.2,4,7.5,11,20,80,x', div('u', 3))} ELSE '' END AS kw,
       CASE WHEN m IN (16, 26, 32) OR u % 11 = 0 THEN 'LGR' ELSE '' END AS grp,
       m = 23 AS load_detail, u % 13 = 0 AS unclear, (m = 26 AND u % 17 = 0) AS cable
FROM (SELECT o_orderkey AS k, o_custkey AS c,
             CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS panel_idx,
             CAST(round(o_totalprice * 100) AS BIGINT) % {_N} AS m,
             CAST(floor(CAST(round(o_totalprice * 100) AS BIGINT) / {_N}) AS BIGINT) AS u
      FROM {{orders}}) AS o
"""

_TYPES = ("STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL")


def _by_type(*cells: str) -> str:
    return "CASE p_type " + " ".join(f"WHEN '{t}' THEN {c}" for t, c in zip(_TYPES, cells)) + " END"


_A3 = pick('200,400,600', 'z')
_NAMES = {
    "bolt": f"{_by_type(*[repr(d) for d in ('MCB', 'ELB', 'M)MCB', 'B)MCB', 'B)ELB', 'M)ELB')])} || ' ' || "
            f"CAST(b % 3 + 2 AS VARCHAR(9)) || 'P ' || {pick(_FRAMES, 'z')} || 'AF/' || {pick('20,30,50,75,100,200', 'b')} || 'AT'",
    "gear": _by_type(
        f"'VCB 7.2kV ' || {_A3} || 'A ' || {pick('8,12.5,20', 'b')} || 'kA 標準'",
        f"'VCB 7.2kV ' || {_A3} || 'A ' || {pick('12.5,20', 'b')} || 'kA 引出 電動'",
        f"'VCS 7.2kV ' || {pick('200,400', 'z')} || 'A' || {pick(' 引出,,', 'b')}",
        f"'LBS 7.2kV ' || {pick('200,400', 'z')} || 'A PF=' || {pick('30,40', 'b')} || 'A'",
        f"'PAS 7.2kV ' || {pick('200,300', 'z')} || 'A SOG付'",
        f"'VCB 7.2kV ' || {_A3} || 'A ' || {pick('8,12.5', 'b')} || 'kA (手動)'"),
    "rod": f"'DS 7.2kV ' || {_A3} || 'A ' || {pick('1,3', 'b')} || 'P ' || {pick('標準,電動,標準', 'b + z')}",
    "ring": f"CASE WHEN z % 2 = 0 THEN {pick('CT 20/5A~40/5A,CT 50/5A~75/5A,CT 100/5A~200/5A', 'b')} "
            f"ELSE 'CT ' || {pick('10,15,100,200,300,400,500,600', 'b')} || '/5A' END",
    "plate": f"'TB ' || {pick('50,100,200,225,400,600', 'b')} || 'A'",
    "widget": _by_type(
        f"'TR 3φ3W ' || {pick('10,20,30,50,75,100,150,200,300,500', 'z')} || 'kVA 支給品'",
        f"'TR 1φ3W ' || {pick('10,20,30,50,75,100', 'z')} || 'kVA 支給品'",
        f"'SC ' || {pick('10.6,25,50,100', 'z')} || 'kvar 支給品'",
        f"'SR L=6% ' || {pick('1.6,3.19,6.38', 'z')} || 'kvar 支給品'",
        f"'SC 200V ' || {pick('10,20,50', 'z')} || 'kvar'",
        f"'SR 200V ' || {pick('1.6,6.38', 'z')} || 'kvar スペース'"),
    "anvil": _by_type(
        "'LGR ZCT付'", "'LGR 2段警報'", f"'ZCT ' || {pick('50,100,200', 'z')} || 'A'",
        f"'マルチ指示計 ' || {pick('MDA,T/D付,通信', 'z')}", f"'電圧計 ' || {pick('広角,標準', 'z')}",
        f"'SPD クラスII 3P ' || {pick('20,25', 'z')} || 'kA'"),
    "gizmo": _by_type(
        f"'L-S ' || {pick(_KW, 'z')} || 'kW'", f"'INV ' || {pick(_KW, 'z')} || 'kW'",
        f"'コンセント 2P ' || {pick('15,20', 'z')} || 'A'", f"'WHM ' || {pick('1φ,3φ', 'z')} || ' 検付'",
        f"'PF ' || {pick('20,40,60', 'z')} || 'A'", f"'OVGR ' || {pick('静止型,標準', 'z')}"),
}
_DIGIT = pick('5,1,2,4,6,8', 'z')
_BASES = {
    "bolt": f"{pick('40,50,60', 'b + z')} || {_DIGIT} || CASE WHEN p_type IN ('MEDIUM', 'SMALL') THEN '03' "
            f"WHEN p_type IN ('STANDARD', 'PROMO') THEN {pick('22,33,46', 'b')} ELSE {pick('25,36,46', 'b')} END",
    "ring": f"CASE WHEN z % 2 = 0 THEN {pick('44121,44122,44123', 'b')} "
            f"ELSE {pick('72000,72001,72002,72003,72004,72005,72006,72007', 'b')} END",
    "plate": pick('50901,50902,50903,50904,68509,68109,68209,68409,68609', 'z'),
    "widget": _by_type(*[f"'{p}' || CAST(100 + z AS VARCHAR(9))" for p in ('451', '452', '453', '454', '463', '464')]),
    "anvil": _by_type("'46401'", "'46403'", "'475' || CAST(z % 3 AS VARCHAR(9)) || '1'",
                      f"{pick('42075,42076,42088', 'z')}", "'71001'", "'68701'"),
    "gizmo": _by_type(
        f"{pick('22,26', 'b')} || {pick('000,001,011,021,031,041,061,071,022,032,042', 'z')}",
        f"{pick('22,26', 'b')} || {pick('993,983,053,003,013,023,033,995,055,015', 'z')}",
        "'80001'", "'73001'", "'44901'", "'47301'"),
    "gear": "'411' || CAST(z AS VARCHAR(9))",
    "rod": "'433' || CAST(z AS VARCHAR(9))",
}


def _by_noun(cells: dict[str, str]) -> str:
    return "CASE noun " + " ".join(f"WHEN '{n}' THEN {s}" for n, s in cells.items()) + " END"


_BASE, _NAME = _by_noun(_BASES), _by_noun(_NAMES)
_VOLT = f"""CASE noun WHEN 'gear' THEN {pick('6.6kV,', 'b')} WHEN 'rod' THEN {pick('7.2kV,6.6kV', 'b')}
               WHEN 'ring' THEN CASE WHEN z % 2 = 0 THEN '6.6kV' ELSE {pick('200V,400V,', 'b')} END
               WHEN 'gizmo' THEN CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN {pick('AC200V,AC400V', 'b')} ELSE '' END
               ELSE '' END"""
_SPEC = "CASE WHEN noun = 'anvil' AND p_type = 'ECONOMY' AND b % 2 = 0 THEN 'ZCT含' ELSE '' END"

CATALOGUE = f"""
SELECT x.ord, CASE WHEN x.ord = f.first_ord THEN x.base ELSE x.base || '-' || CAST(x.ord AS VARCHAR(20)) END AS code,
       x.name, x.volt, x.kind, x.spec
FROM (SELECT p_partkey AS ord, {_BASE} AS base, {_NAME} AS name,
             {_VOLT} AS volt,
             noun AS kind, {_SPEC} AS spec
      FROM (SELECT p_partkey, p_type, p_size AS z, CAST(split_part(p_brand, '#', 2) AS INT) AS b,
                   split_part(p_name, ' ', 2) AS noun FROM {{part}}) AS p) AS x
JOIN (SELECT base, min(ord) AS first_ord
      FROM (SELECT p_partkey AS ord, {_BASE} AS base
            FROM (SELECT p_partkey, p_type, p_size AS z, CAST(split_part(p_brand, '#', 2) AS INT) AS b,
                         split_part(p_name, ' ', 2) AS noun FROM {{part}}) AS q) AS g
      GROUP BY base) AS f ON x.base = f.base
"""

# the same catalogue with its texts read once per distinct description of a part
_DESCRIPTION = ["p_type", "z", "b", "noun"]
_PARTS = """SELECT p_partkey AS ord, p_type, p_size AS z, CAST(split_part(p_brand, '#', 2) AS INT) AS b,
                   split_part(p_name, ' ', 2) AS noun FROM {part}"""
_TEXTS = f"SELECT *, {_BASE} AS base, {_NAME} AS name, {_VOLT} AS volt, {_SPEC} AS spec FROM {{kinds}}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    compilable(spark)
    return spark.sql(ITEMS, orders=table(spark, sf_dir, "orders"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    compilable(spark)
    return spark.sql(_PARTS, part=table(spark, sf_dir, "part"))


def _texts(kinds: DataFrame) -> DataFrame:
    """The texts of every description; its ``first_ord``, the first part it holds, becomes that of all with its base."""
    return kinds.sparkSession.sql(_TEXTS, kinds=kinds).where("base is not null").withColumn(
        "first_ord", F.min("first_ord").over(W.partitionBy("base")))


def _rows(df: DataFrame) -> DataFrame:
    code = F.when(F.col("ord") == F.col("first_ord"), F.col("base")).otherwise(
        F.concat("base", F.lit("-"), F.col("ord").cast("string")))
    return df.select("ord", code.alias("code"), "name", "volt", F.col("noun").alias("kind"), "spec")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``CATALOGUE``: every part, its texts evaluated once per distinct description and joined back.

    The descriptions are written first: otherwise Spark tests the codes on every part, below the grouping, and takes
    the parts for the small side of the join, which sends them all through the driver.
    """
    parts = _parts(spark, sf_dir)
    texts = _texts(written(parts.groupBy(*_DESCRIPTION).agg(F.min("ord").alias("first_ord"))))
    texts = texts.withColumnsRenamed({c: f"_{c}" for c in _DESCRIPTION})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _DESCRIPTION])
    return _rows(parts.join(texts, same))


def first_described(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The rows of ``CATALOGUE`` that are among the first ``k`` of their description, with the codes they have there.

    Parts of one description are alike in every text, so the first ``k`` rows of any texts are among these.  The parts
    are read once, cut to ``k`` a description by each task, and joined with nothing.
    """
    firsts = first_per_group(_parts(spark, sf_dir), _DESCRIPTION, [F.col("ord").asc_nulls_last()], k)
    kinds = written(firsts.groupBy(*_DESCRIPTION).agg(
        F.min("ord").alias("first_ord"), F.collect_list(F.struct("ord")).alias("held")))
    return _rows(_texts(kinds).withColumn("ord", F.explode("held.ord")))
