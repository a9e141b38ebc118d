"""Text normalisation and small text helpers, all as columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that NFKC leaves alone and that never combine with a neighbour.  Text made of
# these only (nearly all text) skips the Arrow round trip's work.
_STABLE = r"^[\x00-\x7FÀ-ÖØ-öø-ÿ×Α-Ωα-ωぁ-ゖァ-ヺ・ー、。〈〉一-鿿◎○△—]*$"
_DROPPED = r"[ー\-\s\x1c-\x1f　()（）\[\]、,．.]"
_LETTER = r"[\p{L}\p{N}_]"


@F.pandas_udf(StringType())
def _nfkc_batch(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


# Spark must not copy the call into every expression that uses the folded text.
_nfkc_once = _nfkc_batch.asNondeterministic()


def nfkc(text: Column, full: bool = True) -> Column:
    """Compatibility form of the text; NULL becomes ''.

    ``full=False`` stays inside the JVM and folds full-width ASCII only.
    """
    text = F.coalesce(text, F.lit(""))
    if not full:
        wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
        return F.translate(text, wide, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ")
    return F.coalesce(_nfkc_once(F.when(~text.rlike(_STABLE), text)), text)


def squeeze(folded: Column) -> Column:
    """Matching form of NFKC text: lower case without blanks, brackets, dots and dashes."""
    return F.regexp_replace(F.lower(folded), "(?U)" + _DROPPED, "")


def squeeze_literal(word: str) -> str:
    """``squeeze(nfkc(word))`` for a word of a rule table."""
    return re.sub(_DROPPED, "", unicodedata.normalize("NFKC", word).lower())


def compact(folded: Column) -> Column:
    """Lower case without blanks, punctuation kept."""
    return F.regexp_replace(F.lower(folded), r"(?U)[\s\x1c-\x1f　]", "")


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def sql(value: str) -> str:
    """A raw SQL string literal."""
    return "r'" + value + "'"


def every_sql(column: str, pattern: str, tag: str = "", before: str = "") -> str:
    """SQL for all matches of group 1, each between the two marks."""
    found = f"regexp_extract_all({column}, {sql(pattern)}, 1)"
    return f"transform({found}, v -> concat({sql(before)}, v, {sql(tag)}))" if tag else found


def flag_sql(column: str, pattern: str, tag: str) -> str:
    """SQL for [tag] where the pattern occurs, else []."""
    return f"IF({column} rlike {sql(pattern)}, array({sql(tag)}), CAST(array() AS array<string>))"


def text_map(pairs: dict) -> Column:
    return F.expr("map(" + ", ".join(sql(str(v)) for kv in pairs.items() for v in kv) + ")")


def every(text: Column, pattern: str, tag: str = "", group: int = 1) -> Column:
    """All matches of a group, each followed by the tag."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.transform(found, lambda v: F.concat(v, F.lit(tag))) if tag else found


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def strings(words) -> Column:
    return F.expr("array(" + ", ".join(sql(w) for w in words) + ")") if words else empty_strings()


def contains_any(text: Column, words) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def number_text(value: Column) -> Column:
    """Shortest plain text of a number: 5 rather than 5.0."""
    return F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")


def strip_marks(text: Column) -> Column:
    """Drop blanks, commas and ideographic commas at both ends."""
    return F.regexp_replace(text, r"^[ ,、]+|[ ,、]+$", "")


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
