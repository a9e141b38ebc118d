"""Decision rules as a table, compiled to one pass over the rows.

A rule is a row: the rule's label, the names of its conditions, and an outcome.  A name with ``!`` in front
must not hold, a condition that is not named may be anything.  Every condition is evaluated once per row
and becomes a bit of a mask; each rule becomes two numbers, the bits it needs and the bits it forbids.
The lowest rule whose numbers fit the mask settles the row.

The table may be rows of plain data or a DataFrame (priority, rule, conditions, code, conf, note), whose
rules travel as one scalar array; it is as long as there are rules and doesn't grow with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catamatch.functions import text as t

#: A mask is a long, its sign bit stays free.
MOST_CONDITIONS = 63
_RULE = "struct<priority bigint, need bigint, forbid bigint, rule string, code string, conf string, note string>"


def _bits(names: list[str], conditions) -> int:
    at = {name: i for i, name in enumerate(conditions)}
    unknown = [n for n in names if n not in at]
    if unknown:
        raise ValueError(f"unknown condition {', '.join(unknown)}")
    return sum(1 << at[n] for n in set(names))


def _literal_rules(table, conditions) -> Column:
    rows = []
    for i, (rule, wanted, code, conf, note) in enumerate(table):
        names = wanted.split()
        need = _bits([n for n in names if not n.startswith("!")], conditions)
        forbid = _bits([n[1:] for n in names if n.startswith("!")], conditions)
        rows.append(F.struct(F.lit(i).cast("bigint"), F.lit(need).cast("bigint"), F.lit(forbid).cast("bigint"),
                             *[F.lit(v) for v in (rule, code, conf, note)]).cast(_RULE))
    return F.array(*rows).cast(f"array<{_RULE}>")


def _table_rules(table: DataFrame, conditions) -> Column:
    """The rules of a DataFrame as a scalar array in priority order; an unknown condition ends the job."""
    bits = t.text_map({name: 1 << i for i, name in enumerate(conditions)})
    names = F.filter(F.split(F.coalesce("conditions", F.lit("")), r"\s+"), lambda n: n != "")

    def mask(kept, bare):
        bit = lambda n: F.coalesce(F.try_element_at(bits, bare(n)).cast("bigint"), F.raise_error(
            F.concat(F.lit("unknown condition "), n)).cast("bigint"))
        return F.aggregate(F.filter(names, kept), F.lit(0).cast("bigint"), lambda acc, n: acc.bitwiseOR(bit(n)))

    negated = lambda n: n.startswith("!")
    rule = F.struct(F.col("priority").cast("bigint"), mask(lambda n: ~negated(n), lambda n: n).alias("need"),
                    mask(negated, lambda n: F.substring(n, 2, 1 << 20)).alias("forbid"), "rule", "code", "conf", "note")
    return table.select(rule.cast(_RULE).alias("r")).agg(F.array_sort(F.collect_list("r"))).scalar()


def with_ruling(df: DataFrame, table, conditions: dict[str, Column], codes: dict[str, Column],
                fields: dict[str, Column], out: str = "sel") -> DataFrame:
    """Adds ``out`` STRUCT<rule, code, conf, note> by the first rule that fits, NULL where none does.

    conditions: name -> boolean column, null counts as false.  A rule's ``code`` is the name of one of the
    ``codes`` columns, a name that isn't there (and a null value) gives no code; ``{name}`` in its note is
    replaced by that field.  Rules of equal priority stand in the order of their masks.
    """
    if len(conditions) > MOST_CONDITIONS:
        raise ValueError(f"more than {MOST_CONDITIONS} conditions")
    rules = _table_rules(table, conditions) if isinstance(table, DataFrame) else _literal_rules(table, conditions)
    mask = reduce(lambda a, b: a.bitwiseOR(b), [
        F.when(c, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, c in enumerate(conditions.values())])
    # three columns on end, so that the mask and the rule found are evaluated once each
    df = df.withColumns({"_mask": mask, "_rules": rules})
    fits = lambda r: (F.col("_mask").bitwiseAND(r["need"]) == r["need"]) & (F.col("_mask").bitwiseAND(r["forbid"]) == 0)
    df = df.withColumn("_hit", F.get(F.filter("_rules", fits), 0))
    code = F.lit("")
    for name, value in codes.items():
        code = F.when(F.col("_hit.code") == name, F.coalesce(value, F.lit(""))).otherwise(code)
    note = F.col("_hit.note")
    for name, value in fields.items():
        mark = "{" + name + "}"
        used = F.when(F.col("_hit.note").contains(mark), value)
        note = F.replace(note, F.lit(mark), F.coalesce(used, F.lit("")))
    result = F.struct(F.col("_hit.rule").alias("rule"), code.alias("code"), F.col("_hit.conf").alias("conf"), note.alias("note"))
    return df.withColumn(out, F.when(F.col("_hit").isNotNull(), result)).drop("_mask", "_rules", "_hit")
