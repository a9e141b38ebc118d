"""Alias dictionaries as tables: the first alias of a dictionary of any size that a text names.

A CASE over every alias can't be planned for a large dictionary.  Here aliases stand in buckets by their
first ``PREFIX`` characters, a text asks for the buckets of all its positions, and what the buckets hold is
verified against the text.  Texts meet aliases in an equality join; of those found the lowest priority wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catamatch.operators.stage import written

#: Aliases of at most SHORT characters need a word boundary on both sides.
PREFIX, SHORT = 4, 2


def _starts(form: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters."""
    last = F.length(form) - size + 1
    cut = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(form, i, F.lit(size)))
    return F.when(last >= 1, F.array_distinct(cut)).otherwise(F.slice(cut, 1, 0))


def _whole_word(form: Column, alias: Column) -> Column:
    """Does the alias stand in the text without a letter a-z on either side?"""
    letter = lambda c: (c != "") & c.between("a", "z")
    places = F.sequence(F.lit(1), F.greatest(F.length(form), F.lit(1)))
    return F.exists(places, lambda i: (F.substring(form, i, F.length(alias)) == alias)
                    & ~F.when(i > 1, letter(F.substring(form, i - 1, F.lit(1)))).otherwise(False)
                    & ~letter(F.substring(form, i + F.length(alias), F.lit(1))))


def first_aliases(texts: DataFrame, aliases: DataFrame, form: str = "form") -> DataFrame:
    """(form, alias, part, priority) of the distinct texts that name an alias, by the lowest priority.

    aliases: alias (matching form, not empty), part, priority (equal ones are settled by alias).
    """
    aliases = written(aliases.where("alias <> ''").groupBy("alias").agg(
        F.min(F.struct("priority", "part")).alias("b")).select("alias", "b.part", "b.priority", F.substring("alias", 1, PREFIX).alias("key")))
    keys = F.flatten(F.array(*[_starts(F.col("form"), n) for n in range(1, PREFIX + 1)]))
    asked = texts.select(F.col(form).alias("form")).where("form is not null").distinct().select("form", F.explode(keys).alias("key"))
    found = asked.join(aliases, "key").where(F.when(
        F.length("alias") > SHORT, F.col("form").contains(F.col("alias"))).otherwise(_whole_word(F.col("form"), F.col("alias"))))
    return found.groupBy("form").agg(F.min(F.struct("priority", "alias", "part")).alias("b")).select(
        F.col("form").alias(form), "b.alias", "b.part", "b.priority")
