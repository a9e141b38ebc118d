"""Scored candidates of item texts: features of both sides, atoms, top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catamatch import rules
from catamatch.functions import extract as x
from catamatch.functions import text as t
from catamatch.operators.lookup import interval_join
from catamatch.operators.match import ranked_matches
from catamatch.operators.ordered import first_per_group
from catamatch.operators.stage import written

KEPT, SHOWN = 8, 5
_BANDS = ("HV", "400V", "200V", "100V", "")
_WEIGHTS = {"v": 18, "o": 5, "s": 4, "d": 4, "x": 3}
_NO_PART = "*"
_SET_MARK = "#"


def item_features(df: DataFrame, name: str = "cname", volt: str = "volt") -> DataFrame:
    """Everything the rules read from an item text, one column each."""
    df = df.withColumn("_q", x.split_quantity(F.regexp_replace(name, "(?i)vgb", "VCB")))
    df = df.withColumns({"qname": F.col("_q.text"), "qty_in_text": F.col("_q.qty")}).drop("_q")
    df = df.withColumn("fold", t.nfkc(F.col("qname")))
    df = df.withColumns({"form": t.squeeze(F.col("fold")), "_spaced": t.compact(F.col("fold"))})
    df = x.with_options(df, "fold", "form")
    fold, form = F.col("fold"), F.col("form")
    return df.withColumns({
        "part": x.detect_part("main_form"),
        "band": x.band_of_text(F.col(volt), form, F.col("_spaced")),
        "kw_text": x.power_kw(fold), "kva": x.capacity_kva(fold),
        "ratio": x.ratio(form).try_cast("long"), "vals": x.attribute_values("fold")}).drop("_spaced")


def first_alike(cat: DataFrame, k: int = KEPT) -> DataFrame:
    """The first ``k`` catalogue rows of each name and voltage: no other row can be a candidate.

    Rows alike in both score the same for every item, so only these can be among its first ``k``.
    """
    return first_per_group(cat, ["name", "volt"], ["ord"], k, "_r").drop("_r")


def catalogue_features(cat: DataFrame) -> DataFrame:
    """The same for catalogue rows, once per row."""
    df = cat.withColumn("fold", t.nfkc(F.col("name"))).withColumn("form", t.squeeze(F.col("fold")))
    known = [(p, t.squeeze_literal(p), prefix) for p, _, prefix in rules.parts()]
    known.append(("LUG", "lug", True))
    cases = ", ".join(f"IF({'startswith' if prefix else 'contains'}(form, {t.sql(k)}), {t.sql(p)}, NULL)"
                      for p, k, prefix in known)
    named = F.expr(f"array_compact(array({cases}))")
    return df.select("*", x.band_of_catalogue(F.col("volt")).alias("band"), named.alias("parts"),
                     x.attribute_values("fold", "volt").alias("vals"),
                     x.interval_of_name(F.col("name")).alias("interval"))


def _tag(tag: str, words: Column) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit(tag + ":"), w))


def _present(form: Column, words) -> Column:
    forms = dict.fromkeys(t.squeeze_literal(w) for w in words)
    return F.filter(t.strings(forms), lambda w: form.contains(w))


def option_atoms(opts: Column) -> Column:
    """``o:<n>:<form>`` for the n-th time an option form is named: each time counts."""
    forms = F.filter(F.transform(opts, t.squeeze), lambda o: o != "")
    def nth(form, i):
        return F.size(F.filter(F.slice(forms, 1, i + 1), lambda o: o == form))
    return F.array_sort(F.transform(forms, lambda o, i: F.concat(F.lit("o:"), nth(o, i).cast("string"), F.lit(":"), o)))


def _option_of(atom: Column) -> Column:
    return F.regexp_replace(atom, r"^o:\d+:", "")


def options_in_names(options: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (form, opt) where the name contains the option text.

    Both sides meet on the option's first characters against the grams of the name, then the
    full containment is checked, so options are never compared with every name.
    """
    n = 6
    size = F.length("form")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))),
                        lambda i: F.array(*[F.substring(F.col("form"), i, F.lit(g)) for g in range(1, n + 1)]))
    starts = names.select("form").distinct().withColumn(
        "gram", F.explode(F.array_distinct(F.flatten(grams))))
    asked = options.distinct().withColumn("gram", F.substring("opt", 1, n))
    return (asked.join(starts, "gram").where(F.col("form").contains(F.col("opt")))
            .select("form", "opt").distinct())


def _gain(shared: Column, ratios: Column) -> Column:
    """Score of the shared atoms; a ratio inside the row's interval counts as explained."""
    def weight(a):
        tag = F.substring(a, 1, 1)
        return F.coalesce(F.when(a == "s:sp", 8).otherwise(t.text_map(_WEIGHTS)[tag].cast("int")), F.lit(0))
    met = F.size(F.filter(shared, lambda a: a.startswith("v:") & a.endswith("/5A")))
    inside = F.exists(shared, lambda a: a.startswith("i:"))
    waived = F.when(inside & (ratios > met), 10 + 8 * (ratios - met)).otherwise(0)
    return F.aggregate(shared, F.lit(0), lambda acc, a: acc + weight(a)) + waived


def _own_score(form: Column, name: Column) -> Column:
    own = F.lit(0)
    for w in rules.SPECIAL_WORDS:
        own = own - F.when(form.contains(t.squeeze_literal(w)), 4).otherwise(0)
    return own - F.when(t.contains_any(name, rules.EXTRA_WORDS), 3).otherwise(0)


def with_intervals(items: DataFrame, cats: DataFrame) -> DataFrame:
    """Items with ``within``: the distinct catalogue intervals that hold one of their ratios."""
    ranges = cats.where("interval is not null").select("interval.lo", "interval.hi").distinct()
    asked = items.select(F.explode(F.filter("vals", lambda v: v.endswith("/5A"))).alias("rv")).distinct(
        ).withColumn("r", F.regexp_extract("rv", r"^(\d+)", 1).try_cast("long"))
    held = interval_join(asked, ranges, [], "r", "lo", "hi").groupBy("rv").agg(
        F.collect_set(F.concat_ws(":", F.lit("i"), "lo", "hi")).alias("iv"))
    per_set = (items.select("vals", F.explode(F.filter("vals", lambda v: v.endswith("/5A"))).alias("rv"))
               .distinct().join(held, "rv").groupBy("vals")
               .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("iv")))).alias("within")))
    return items.join(per_set, "vals", "left").withColumn(
        "within", F.coalesce("within", t.empty_strings()))


def _set_block() -> Column:
    """Block of an option set inside a block."""
    return F.concat("block", F.lit(_SET_MARK), F.array_join("asked", "\x02"))


def candidates(items: DataFrame, cats: DataFrame, k: int = KEPT) -> DataFrame:
    """Top k catalogue rows of each distinct (part, band, form, vals, opts) of the items.

    items need part, band, form, vals, opts.  Adds cands
    ARRAY<STRUCT<rn, ord, score, code, name, volt>>, NULL when nothing is left.
    """
    ids = ["part", "band", "form", "vals", "opts"]
    wanted = with_intervals(items.select(*ids).distinct(), cats)
    plain = ~t.contains_any(F.col("form"), [t.squeeze_literal(w) for w in rules.SPECIAL_IN_DRAWING])
    wanted = wanted.withColumn("asked", option_atoms(F.col("opts")))
    wanted = wanted.select(
        *ids, F.concat(F.coalesce("part", F.lit(_NO_PART)), F.lit("|"), "band").alias("block"), "asked",
        F.array_sort(F.concat(
            _tag("v", F.col("vals")), "asked",
            _tag("s", _present(F.col("form"), rules.SPECIAL_WORDS)),
            F.when(plain, F.array(*[F.lit("d:" + t.squeeze_literal(w)) for w in rules.DEFAULT_WORDS]))
            .otherwise(t.empty_strings()),
            F.when(F.size("opts") > 0, F.array(F.lit("x"))).otherwise(t.empty_strings()),
            F.col("within"))).alias("atoms"),
        F.size(F.filter("vals", lambda v: v.endswith("/5A"))).alias("extra"))
    wanted = written(wanted)

    iv = F.when(F.col("interval").isNotNull(), F.array(F.concat_ws(
        ":", F.lit("i"), "interval.lo", "interval.hi"))).otherwise(t.empty_strings())
    bands = F.when(F.col("band") == "", F.array(*[F.lit(b) for b in _BANDS])).otherwise(
        F.array(F.col("band"), F.lit("")))
    rows = (cats.select(
        "ord", "form", "band", F.explode(F.concat("parts", F.array(F.lit(_NO_PART)))).alias("p"),
        bands.alias("bands"), _own_score(F.col("form"), F.col("name")).alias("base"),
        F.array_sort(F.concat(
            _tag("v", F.col("vals")),
            _tag("s", _present(F.col("form"), rules.SPECIAL_WORDS)),
            _tag("d", _present(F.col("form"), rules.DEFAULT_WORDS)),
            F.when(t.contains_any(F.col("name"), rules.EXTRA_WORDS), F.array(F.lit("x")))
            .otherwise(t.empty_strings()), iv)).alias("atoms"))
        .withColumn("b", F.explode("bands"))
        .select("ord", "form", F.concat("p", F.lit("|"), "b").alias("block"), "atoms",
                (F.col("base") + F.when((F.col("b") == F.col("band")) & (F.col("b") != ""), 6)
                 .otherwise(0)).alias("own")))

    # Options count only for the items that name them: a row that holds an option of some item's
    # option set stands once more in the block of that set, with those options and no others.  An
    # item looks into its plain block and into the block of its set.
    rows = written(rows)
    named_sets = wanted.where(F.size("asked") > 0).select("block", "asked").distinct()
    named_sets = named_sets.withColumn("own_block", _set_block())
    asks = named_sets.select("block", "own_block", F.explode("asked").alias("atom")).withColumn("opt", _option_of(F.col("atom")))
    held = options_in_names(asks.select("opt"), cats)
    special = (asks.join(held, "opt").groupBy("block", "own_block", "form").agg(F.collect_set("atom").alias("more"))
               .join(rows, ["block", "form"])
               .select("ord", F.col("own_block").alias("block"), F.array_sort(F.concat("atoms", "more")).alias("atoms"), "own"))
    lookups = wanted.select("block", "atoms", "extra", "asked").distinct().withColumn("own_block", _set_block())
    both = lookups.select("block", "atoms", "extra").distinct().unionByName(
        lookups.where(F.size("asked") > 0).select(F.col("own_block").alias("block"), "atoms", "extra").distinct())
    found = ranked_matches(both, rows.drop("form").unionByName(special), _gain, k)
    found = found.withColumn("h", F.explode("hits")).withColumn("block", F.split("block", _SET_MARK)[0])
    # a row met in both blocks has its full score in the block of the set
    found = found.groupBy("block", "atoms", "extra", F.col("h.ord").alias("ord")).agg(F.max("h.score").alias("score"))
    order = W.partitionBy("block", "atoms", "extra").orderBy(F.desc("score"), "ord")
    best = found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    named = (best.join(cats.select("ord", "code", "name", "volt"), "ord")
             .groupBy("block", "atoms", "extra").agg(F.array_sort(F.collect_list(
                 F.struct("rn", "ord", "score", "code", "name", "volt"))).alias("cands")))
    base = 10 - 8 * F.size("vals")
    return (wanted.join(named, ["block", "atoms", "extra"], "left").select(
        *ids, F.transform("cands", lambda c: c.withField("score", c["score"] + base)).alias("cands")))


def residual(vals: Column, top_name: Column, top_vals: Column) -> Column:
    """STRUCT<matched, missing>: item values the top row shows and those left unexplained."""
    matched, missing = F.array_intersect(vals, top_vals), F.array_except(vals, top_vals)
    iv = x.interval_of_name(top_name)
    inside = F.exists(F.filter(vals, lambda v: v.endswith("/5A")), lambda v: F.regexp_extract(
        v, r"^(\d+)", 1).try_cast("long").between(iv["lo"], iv["hi"]))
    no_poles = ~top_name.rlike("[234]P")
    sized = (F.exists(matched, lambda v: v.endswith("φ")) & F.exists(matched, lambda v: v.endswith("KVA")))
    left = F.filter(missing, lambda v: ~((v.endswith("/5A") & F.coalesce(inside, F.lit(False)))
                                         | (v.endswith("P") & no_poles)
                                         | (v.endswith("V") & sized)))
    return F.struct(matched.alias("matched"), left.alias("missing"))
