"""Result tables: detail, summary, options, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catamatch import rules


def grade_counts(conf: str = "conf") -> list[Column]:
    return [F.count_if(F.col(conf) == rules.SURE).alias("ok"),
            F.count_if(F.col(conf) == rules.NEARLY).alias("warn"),
            F.count_if(F.col(conf) == rules.CHECK).alias("chk"),
            F.count_if(~F.col(conf).isin(rules.SURE, rules.NEARLY, rules.CHECK)).alias("detail")]


def summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total, ok, warn, chk, detail and the share settled automatically (half to even)."""
    c = df.groupBy(*(by or [])).agg(*grade_counts())
    total = F.col("ok") + F.col("warn") + F.col("chk")
    rate = F.bround((F.col("ok") + F.col("warn")) * F.lit(100.0) / F.greatest(total, F.lit(1)), 0)
    return c.select(*(by or []), total.alias("total"), "ok", "warn", "chk", "detail",
                    rate.cast("long").alias("rate"))


def summary_lines(sums: DataFrame, attached: DataFrame) -> DataFrame:
    """Label/value rows; the detail line counts the load details attached to a row."""
    n = attached.agg(F.count("*").alias("n")).scalar()
    one = sums.withColumn("d", n)
    return one.select(F.stack(
        F.lit(6), F.lit("items"), F.col("total").cast("string"),
        F.lit("◎"), F.col("ok").cast("string"), F.lit("○"), F.col("warn").cast("string"),
        F.lit("△"), F.col("chk").cast("string"), F.lit("rate"), F.concat(F.col("rate").cast("string"), F.lit("%")),
        F.lit("load details"), F.col("d").cast("string")).alias("label", "value"))


def detail(df: DataFrame) -> DataFrame:
    """The seven report columns in document order keys."""
    return df.select("doc_id", "panel_idx", "item_idx", "panel", F.col("name").alias("raw"), "qty",
                     F.when(F.col("code") == "", "—").otherwise(F.col("code")).alias("code"),
                     F.coalesce("official", F.lit("")).alias("official"), "conf", "note")


def of_grade(df: DataFrame, grade: str) -> DataFrame:
    return df if grade == "all" else df.where(F.col("conf") == grade)


def options(code: Column, official: Column, candidates: Column, shown: int = 5) -> Column:
    """Pick list: the chosen code first, then up to ``shown`` candidates, each code once."""
    def label(c, n):
        return F.struct(c.alias("code"), F.concat(c, F.lit("（"), F.coalesce(n, F.lit("")), F.lit("）")).alias("label"))
    rest = F.transform(F.slice(candidates, 1, shown), lambda c: label(c["code"], c["name"]))
    empty = F.filter(F.array(label(F.lit(""), F.lit(""))), lambda o: F.lit(False))
    rest = F.filter(F.coalesce(rest, empty), lambda o: o["code"] != code)
    return F.when(code != "", F.concat(F.array(label(code, official)), F.array_distinct(rest))
                  ).otherwise(F.array_distinct(rest))


def changed(presented: Column, final: Column) -> Column:
    """A reviewed row counts as changed when a final code is set and differs."""
    return (F.coalesce(final, F.lit("")) != "") & (final != presented)
