"""The parts of a candidate's score as columns over one item and one catalogue row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catamatch import rules
from catamatch.functions import text as t


def value_score(vals: Column, row_vals: Column, interval: Column) -> Column:
    """+10 per common value, -8 per missing one; ratios inside the row's interval count once as
    common and none of them as missing."""
    missing = F.array_except(vals, row_vals)
    lost = F.size(F.filter(missing, lambda v: v.endswith("/5A")))
    inside = F.coalesce(F.exists(F.filter(vals, lambda v: v.endswith("/5A")), lambda v: F.regexp_extract(
        v, r"^(\d+)", 1).try_cast("long").between(interval["lo"], interval["hi"])), F.lit(False))
    plain = 10 * F.size(F.array_intersect(vals, row_vals)) - 8 * F.size(missing)
    return plain + F.when(inside & (lost > 0), 10 + 8 * lost).otherwise(0)


def option_bonus(opts: Column, form: Column, row_form: Column) -> Column:
    """+5 per option in the name, -4 per special word only the name has, +4 per default word
    unless the item asks for a special type."""
    hits = F.size(F.filter(opts, lambda o: (t.squeeze(o) != "") & row_form.contains(t.squeeze(o))))
    special = t.strings([t.squeeze_literal(w) for w in rules.SPECIAL_WORDS])
    extra = F.size(F.filter(special, lambda w: row_form.contains(w) & ~form.contains(w)))
    default = F.size(F.filter(t.strings([t.squeeze_literal(w) for w in rules.DEFAULT_WORDS]),
                              lambda w: row_form.contains(w)))
    asked = t.contains_any(form, [t.squeeze_literal(w) for w in rules.SPECIAL_IN_DRAWING])
    return 5 * hits - 4 * extra + F.when(asked, 0).otherwise(4 * default)
