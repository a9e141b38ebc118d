"""Reading quantities, options, bands, numbers and attribute values out of item text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catamatch import rules
from catamatch.functions import text as t

# --- fixed values: patterns of the item grammar ------------------------------------------
_TIMES = r"(?U)[xX×]\s*(\d{1,3})(?![\p{L}\p{N}_])"
_POWER_COUNT = r"(?iU)((?:kw|kva|kvar|kvr)\s*)(?=[x×])"
# a private character set between a power unit and a multiplication mark, which is no count then
_GUARD = "\ue000"
_DS_TOKEN = r"(?i)(?<![a-z])ds(?![a-z])"
_BRACKET = r"[（(]([^（）()]*)[）)]"
_THREE = r"(?U)[xX×]\s*3(?![\p{L}\p{N}_])"


def split_quantity(raw: Column) -> Column:
    """STRUCT<text, qty>: take one device count (``×N``) out of the text.

    A count right after kW/kVA/kvar describes the load and stays.  A disconnector with ``×3``
    is one three-phase unit: the count is dropped and the pole number written out.
    """
    raw = F.coalesce(raw, F.lit(""))
    three_phase = raw.rlike(_DS_TOKEN) & raw.rlike(_THREE)
    without = t.strip_marks(F.regexp_replace(raw, _THREE, ""))
    poles = F.when(without.rlike(r"(?i)[123]p"), without).otherwise(F.concat(without, F.lit(" 3P")))
    guarded = F.regexp_replace(raw, _POWER_COUNT, "$1" + _GUARD)
    found = F.regexp_extract(guarded, f"(?<!{_GUARD})" + _TIMES, 1)
    rest = F.replace(F.regexp_replace(guarded, f"(?sU)^(.*?)(?<!{_GUARD})" + _TIMES + "(.*)$", "$1$3"), F.lit(_GUARD), F.lit(""))
    return F.struct(
        F.when(three_phase, poles).when(found != "", t.strip_marks(rest)).otherwise(raw).alias("text"),
        F.when(~three_phase & (found != ""), found).alias("qty"),
    )


def with_options(df: DataFrame, folded: str, form: str, words=rules.OPTION_WORDS) -> DataFrame:
    """Adds main_text, main_form and opts: the main device text and its options.

    Options are bracket contents, tokens ending in 付, then known option words that occur in
    the text and were not named yet.
    """
    df = df.withColumn("_bare", t.trim_all(F.regexp_replace(folded, _BRACKET, "")))
    df = df.withColumn("_attached", F.filter(F.split("_bare", r"[\s　,、]"),
                                             lambda w: w.endswith("付") & (F.length(w) > 1)))
    inside = F.transform(t.every(F.col(folded), _BRACKET), t.trim_all)
    df = df.withColumn("main_text", F.aggregate(
        "_attached", F.col("_bare"), lambda acc, w: t.trim_all(F.replace(acc, w, F.lit("")))))
    df = df.withColumn("_named", F.concat(inside, "_attached"))
    df = df.withColumn("_forms", F.transform("_named", t.squeeze))
    known = F.filter(t.strings(list(dict.fromkeys(words))), lambda w: F.contains(
        F.col(form), t.text_map({w: t.squeeze_literal(w) for w in words})[w]) & ~F.array_contains("_forms", w))
    return (df.withColumn("opts", F.concat("_named", known))
            .withColumn("main_form", t.squeeze(F.col("main_text")))
            .drop("_bare", "_attached", "_named", "_forms"))


def band_of_text(given: Column, form: Column, spaced: Column) -> Column:
    """Voltage band of an item: the given one, else the first band its text names."""
    return (F.when(given.isin("HV", "400V", "200V", "100V"), given)
            .when(spaced.rlike(r"6kv|6\.6kv|7\.2kv|12\.5"), "HV")
            .when(form.rlike("415|440"), "400V")
            .when(form.rlike("210|220"), "200V")
            .when(form.rlike("105|100v"), "100V")
            .otherwise(""))


def band_of_catalogue(volt: Column) -> Column:
    """Voltage band of a catalogue row."""
    low = F.lower(F.coalesce(volt, F.lit("")))
    return (F.when(low.contains("kv"), "HV").when(low.contains("400"), "400V")
            .when(low.contains("200"), "200V").when(low.contains("100"), "100V").otherwise(""))


def power_kw(folded: Column) -> Column:
    return t.first(F.lower(folded), r"(\d+\.\d+|\d+)\s*kw")


def capacity_kva(folded: Column) -> Column:
    return t.first(folded, r"(?i)(\d+\.?\d*)\s*k?var?")


def amps(form: Column) -> Column:
    return t.first(form, r"(\d+)a")


def poles(form: Column) -> Column:
    return F.coalesce(t.first(form, r"(\d)p"), F.lit("3"))


def ratio(form: Column) -> Column:
    return t.first(form, r"(\d+)/5a")


def _standard_amp(digits: Column) -> Column:
    """The digits if they are a standard value, else their longest standard prefix."""
    known = [str(v) for v in rules.STANDARD_AMPS]
    tries = [F.when(digits.isin(known), digits)]
    tries += [F.when(F.substring(digits, 1, n).isin([k for k in known if len(k) == n]),
                     F.substring(digits, 1, n)) for n in (4, 3, 2)]
    return F.coalesce(*tries)


def with_frame(df: DataFrame, form: str) -> DataFrame:
    """Adds af and at, frame and trip of a breaker, from its matching form."""
    f = F.col(form)
    pair = r"[234]p(\d{2,4})(?:/(\d{2,4}))?"
    df = df.withColumns({"_af": t.first(f, r"(\d+)af"), "_at": t.first(f, r"(\d+)at"),
                         "_paf": t.first(f, pair, 1), "_pat": t.first(f, pair, 2)})
    df = df.withColumns({"_at": _standard_amp(F.col("_at")), "_pat": _standard_amp(F.col("_pat"))})
    paired = F.col("_af").isNull() & F.col("_paf").isNotNull()
    return df.withColumns({
        "af": F.coalesce("_af", "_paf"),
        "at": F.when(paired, F.coalesce("_pat", "_at")).otherwise(F.col("_at")),
    }).drop("_af", "_at", "_paf", "_pat")


def with_loose_frame(df: DataFrame, form: str) -> DataFrame:
    """Adds af_any and at_any: readings used when no frame is written out (needs af, at)."""
    f = F.col(form)
    pair = r"(\d{2,4})/(\d{2,4})"
    df = df.withColumns({"_paf": t.first(f, pair, 1), "_pat": t.first(f, pair, 2),
                         "_lone": t.first(F.regexp_replace(f, "[234]p", ""), r"(\d{2,4})")})
    paired = F.col("af").isNull() & F.col("_paf").isNotNull()
    return df.withColumns({
        "af_any": F.coalesce("af", "_paf", "_lone"),
        "at_any": F.when(paired, F.coalesce("at", "_pat")).otherwise(F.col("at")),
    }).drop("_paf", "_pat", "_lone")


def standard_frame(af: Column, at: Column, frames=rules.STANDARD_FRAMES) -> Column:
    """Smallest standard frame that holds the breaker; the largest one beyond the table; NULL without one."""
    af, at = af.try_cast("long"), at.try_cast("long")
    steps = F.array(*[F.lit(f).cast("long") for f in frames])
    base = F.when((at > 0) & (at <= af) & (at <= frames[-1]), at).otherwise(af)
    fit = F.array_min(F.filter(steps, lambda s: s >= base))
    return F.when(af.isin(list(frames)), af).when(af.isNotNull(), F.coalesce(fit, F.lit(frames[-1]).cast("long")))


# --- fixed values: value families (pattern, tag) ------------------------------------------
_VALUES = (
    (r"(\d)P(?![a-zA-Z0-9])", "P"), (r"(\d{2,3})P(?![a-zA-Z])", "P"),
    (r"(\d+)\s*AF", "AF"), (r"(\d+)\s*AT", "AT"),
    (r"(?i)(\d+\.?\d*)\s*kW", "kW"), (r"(?i)(\d+\.?\d*)\s*kvar", "kvar"),
    (r"(\d+\.?\d*)\s*kVA", "kVA"), (r"(\d+)/5A", "/5A"),
    (r"(?<![/\d])(\d{2,4})A(?![A-Za-z])", "A"), (r"(\d)D(?![a-z])", "D"),
    (r"(\d+)回路", "回路"), (r"([13])[φΦ]", "φ"), (r"(?i)(\d+)\s*KVA", "KVA"), (r"(\d+)KA", "ka"),
)
_FLAGS = (
    (r"(?i)7\.2kV|6\.6kV|6kV", "HV"), (r"415|440", "400V"), (r"210|220", "200V"),
    (r"105|100V", "100V"), (r"(?i)amp", "AMP"), (r"(?i)mix", "MIX"), (r"片切", "片切"),
    (r"両切", "両切"), (r"(?i)6a", "6A"), (r"調光", "調光"), (r"接点入力", "接点入力"),
    (r"(?i)(クラス|保護レベル|class)i(?!i)", "クラスi"), (r"(?i)(クラス|保護レベル|class)ii", "クラスii"),
)
_VOLT_FLAGS = ((r"(?i)kv", "HV"), (r"400", "400V"), (r"200", "200V"), (r"100", "100V"))


def attribute_values(folded: str, volt: str | None = None) -> Column:
    """Sorted set of tagged values (3P, 225AF, HV, 100/5A, ...) named by a text column."""
    groups = [t.every_sql(folded, p, tag) for p, tag in _VALUES]
    groups += [t.flag_sql(folded, p, tag) for p, tag in _FLAGS]
    groups += [t.flag_sql(f"coalesce({volt}, '')", p, tag) for p, tag in _VOLT_FLAGS if volt]
    groups.append(f"IF({folded} rlike 'MCB|ELB|LUG|MCCB', "
                  + t.every_sql(folded, r"(\d+)\s*A(?![A-Za-z])", "AF") + ", CAST(array() AS array<string>))")
    groups.append(t.every_sql(folded, r"(?i)PF=?(\d+)A", "A", "PF"))
    groups.append("transform(" + t.every_sql(folded, r"(?i)(\d+\.?\d*)kA")
                  + r", v -> concat(regexp_replace(v, r'\.0*$', ''), 'kA'))")
    return F.expr(f"array_sort(array_distinct(flatten(array({', '.join(groups)}))))")


def interval_of_name(name: Column) -> Column:
    """STRUCT<lo, hi> of a catalogue name like ``100/5A~200/5A``; NULL without one."""
    pattern = r"(\d+)/5A\s*[~〜\-]\s*(\d+)/5A"
    lo = t.first(name, pattern, 1)
    return F.when(lo.isNotNull(), F.struct(lo.try_cast("long").alias("lo"),
                                           t.first(name, pattern, 2).try_cast("long").alias("hi")))


def first_alias(form: str, names=None) -> str:
    """SQL for the part of the first alias that occurs; short aliases need a word boundary."""
    def hit(key):
        if len(key) > 2:
            return f"contains({form}, {t.sql(key)})"
        return f"{form} rlike {t.sql(f'(^|[^a-z]){key}([^a-z]|$)')}"
    return " ".join(f"WHEN {hit(t.squeeze_literal(alias))} THEN {t.sql(part)}"
                    for alias, part in (names if names is not None else rules.aliases()))


def detect_part(form: str) -> Column:
    """Part of an item from the matching form of its main text: breakers at the start, then
    transformers, then the dictionary."""
    return F.expr(rf"""CASE
        WHEN {form} rlike '^(mccb|mcb)' THEN 'MCB' WHEN {form} rlike '^(elcb|elb)' THEN 'ELB'
        WHEN {form} rlike '^lug' THEN 'LUG'
        WHEN ({form} rlike '^t:' OR ({form} rlike '[13]φ' AND {form} rlike r'\d+kva'
              AND NOT contains({form}, 'kvar')))
             AND NOT {form} rlike '(^|[^a-z])(sc|sr)([^a-z]|$)' THEN 'TR'
        {first_alias(form)} END""")


def feed_number(raw: Column) -> Column:
    """Feeder label in front of the text, such as 1L1 or 2EM2."""
    return t.first(F.coalesce(raw, F.lit("")), r"^[\s\x{3000}]*(\d+[A-Za-z]+\d+)")


def display_text(raw: Column, feed: Column, loads: Column) -> Column:
    """Body, feeder in angle brackets, loads in round brackets."""
    body = F.when(feed.isNotNull() & raw.startswith(feed),
                  t.trim_all(F.substring(raw, F.length(feed) + 1, F.length(raw)))).otherwise(raw)
    named = F.when(feed.isNotNull(), F.concat(body, F.lit(" 〈"), feed, F.lit("〉"))).otherwise(body)
    listed = F.when(F.size(loads) > 0, F.concat(named, F.lit("("), F.array_join(loads, ", "), F.lit(")")))
    return t.trim_all(F.coalesce(listed, named))


def purchase_class(name: Column) -> Column:
    """supplied, space or bought."""
    return (F.when(name.contains("支給"), "supplied")
            .when(name.contains("スペース") | name.contains("SP"), "space").otherwise("bought"))


def high_voltage_capacity(part: Column, form: Column, spaced: Column, capacitor_panel: Column) -> Column:
    """Is a transformer, capacitor or reactor on the high-voltage side?"""
    low = spaced.rlike(r"(^|[^.\d])(100|105|200|210|400|415)v(?![a-z])")
    high = spaced.rlike(r"\dkv(?![a-z])|6600v|3300v")
    unstated = (part == "TR") | ((part == "SC") & ~form.contains("kvar"))
    primary = form.rlike(r"6600v|66kv|3300v|33kv|72kv|702kv|\dkv/")
    return (F.when(part.isin("SR", "SC") & capacitor_panel, True)
            .when((part == "TR") & primary, True)
            .when(low, False).when(high, True).otherwise(unstated))


def panel_kind(panel_form: Column) -> Column:
    out = None
    for kind, words in rules.PANEL_KINDS:
        hit = t.contains_any(panel_form, words)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(rules.PANEL_KIND_DEFAULT)


def any_alias_pattern(names=None) -> str:
    """One pattern that finds any alias of the dictionary."""
    keys = [t.squeeze_literal(a) for a, _ in (names if names is not None else rules.aliases())]
    short = "|".join(re.escape(k) for k in keys if len(k) <= 2)
    return "|".join(re.escape(k) for k in keys if len(k) > 2) + f"|(^|[^a-z])({short})([^a-z]|$)"


def excluded(raw: Column, form: Column, cable_flag: Column) -> Column:
    """Rows that are not counted: cables, and fuses other than power fuses."""
    cable = F.coalesce(cable_flag, F.lit(False)) | (
        form.rlike(rules.CABLE_PATTERN) & ~form.rlike(any_alias_pattern()))
    fuse = F.lit(False)
    for pattern, on_raw, keep in rules.FUSE_RULES:
        hit = (raw if on_raw else form).rlike(pattern)
        fuse = fuse | (hit & ~form.rlike(keep) if keep else hit)
    return cable | fuse
