"""Ordered decision rules: the first rule that fires settles an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catamatch import rules
from catamatch.functions import extract as x
from catamatch.functions import text as t
from catamatch.operators import lookup
from catamatch.operators.ruletable import with_ruling
from catamatch.operators.stage import written
from catamatch.operators.candidates import SHOWN, candidates, catalogue_features, first_alike, item_features, residual

CONTEXT = ["cname", "volt", "symbol", "kw", "grp", "panel_kind", "tb_control",
           "capacitor_panel", "after_main"]
_SERIES = ("TR", "SC", "SR")


# --- small pieces -------------------------------------------------------------------------

def known_codes(catalogue: DataFrame) -> Column:
    """The codes of the rule tables that the catalogue holds, as one scalar array.

    Its size is bounded by the rule tables, whatever the catalogue's.
    """
    return (catalogue.where(F.col("code").isin(rules.rule_codes()))
            .agg(F.collect_set("code").alias("codes")).scalar())


def known_names(catalogue: DataFrame) -> Column:
    """MAP<code, name> of the same codes, each with the name of its last catalogue row."""
    last = catalogue.where(F.col("code").isin(rules.rule_codes())).groupBy("code").agg(F.max_by("name", "ord").alias("name"))
    return last.agg(F.map_from_entries(F.collect_list(F.struct("code", "name"))).alias("names")).scalar()


def _result(rule: str, code, conf, note) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(rule).alias("rule"), lit(code).alias("code"), lit(conf).alias("conf"),
                    lit(note).alias("note"))


def series_of_item(df: DataFrame) -> DataFrame:
    """Adds high, class_label and series: which capacity ladder a TR/SC/SR item asks for."""
    form, spaced = F.col("cform"), F.col("cspaced")
    high = x.high_voltage_capacity(F.col("part"), form, spaced, F.col("capacitor_panel"))
    df = df.withColumn("high", high).withColumn("class_label", x.purchase_class(F.col("cname")))
    kind = (F.when(F.col("class_label") == "supplied", "S").when(F.col("class_label") == "space", "P")
            .when(F.col("high"), "S").otherwise("N"))
    volt = F.when(F.col("high"), "").otherwise(F.coalesce(t.first(form, "(200|400)v"), F.lit("")))
    phase = F.when(F.col("part") == "TR", F.concat(
        F.when(form.contains("3φ"), "3").otherwise(""), F.when(form.contains("1φ"), "1").otherwise("")
    )).otherwise("")
    share = F.when((F.col("part") == "SR") & F.col("high"),
                   F.coalesce(t.first(form, r"l=?(\d+)"), F.lit(""))).otherwise("")
    return df.withColumn("series", F.when(
        F.col("part").isin(*_SERIES) & F.col("kva").isNotNull(),
        F.concat_ws("|", "part", F.when(F.col("high"), "H").otherwise("L"), kind, volt, phase, share)))


def capacity_ladder(cats: DataFrame) -> DataFrame:
    """(series, cap, code): a catalogue row under every series it can serve."""
    name = F.col("name")
    supplied, space = name.contains("支給品"), name.contains("スペース") | name.contains("(SP)")
    kinds = F.array_compact(F.array(F.when(supplied, "S"), F.when(space, "P"),
                                    F.when(~supplied & ~space, "N")))
    high = F.col("code").startswith("45")
    volts = F.concat(F.array(F.lit("")), F.when(~F.col("high"), F.array_compact(F.array(
        F.when(name.contains("200V"), "200"), F.when(name.contains("400V"), "400"))))
        .otherwise(t.empty_strings()))
    three, one = name.contains("3φ3W"), name.contains("1φ3W")
    phases = F.concat(F.array(F.lit("")), F.array_compact(F.array(
        F.when(three, "3"), F.when(one, "1"), F.when(three & one, "31"))))
    shares = F.concat(F.array(F.lit("")), F.array_distinct(t.every(name, r"=(\d+)%")))
    grp = F.when(name.startswith("TR"), "TR").when(name.startswith("SC"), "SC").when(
        name.startswith("SR"), "SR")
    # a step takes the smallest code, so of rows alike in all else only that one counts
    cats = cats.where(grp.isNotNull()).groupBy("name", high.alias("high")).agg(F.min("code").alias("code"))
    df = cats.select(
        grp.alias("g"), "high", "code", F.explode(kinds).alias("k"), volts.alias("vs"),
        F.when(grp == "TR", phases).otherwise(F.array(F.lit(""))).alias("ps"),
        F.when((grp == "SR") & F.col("high"), shares).otherwise(F.array(F.lit(""))).alias("ls"),
        t.first(name, r"(?i)(\d+\.?\d*)\s*kvar?").cast("double").alias("cap"))
    df = (df.withColumn("v", F.explode("vs")).withColumn("p", F.explode("ps"))
          .withColumn("l", F.explode("ls")))
    return df.where("cap is not null").select(
        F.concat_ws("|", "g", F.when(F.col("high"), "H").otherwise("L"), "k", "v", "p", "l"
                    ).alias("series"), "cap", "code")


def branch_codes(kind: Column, af: Column, pole: Column, elb: Column) -> Column:
    """Branch breaker codes in order of preference."""
    digit = t.text_map({str(k): v for k, v in rules.FRAME_DIGIT.items()})[af.cast("string")]
    p = F.when(pole.isin("2", "4"), pole).otherwise("3")
    suffix = F.when(elb, t.text_map({k[0]: v for k, v in rules.BRANCH_SUFFIX.items() if k[1]})[p]
                    ).otherwise(t.text_map({k[0]: v for k, v in rules.BRANCH_SUFFIX.items() if not k[1]})[p])
    bases = F.when(kind == "control", t.strings(rules.BRANCH_BASES["control"])).otherwise(
        t.strings(rules.BRANCH_BASES["other"]))
    return F.when(digit.isNotNull(), F.transform(bases, lambda b: F.concat(b, digit, suffix))
                  ).otherwise(t.empty_strings())


def with_breaker_code(df: DataFrame, codes: Column) -> DataFrame:
    """Adds breaker: the code of a main or branch breaker by panel kind, frame and poles."""
    df = x.with_loose_frame(x.with_frame(df, "cform"), "cform")
    form, part = F.col("cform"), F.col("part")
    df = df.withColumns({
        "_main": F.col("cname").contains("主幹") | part.startswith("M)"),
        "_elb": form.contains("elb") | part.isin("ELB", "M)ELB", "B)ELB"),
        "_pole": x.poles(form), "_frame": x.standard_frame(F.col("af_any"), F.col("at_any"))})
    mains = t.text_map({f"{k}|{a}": c for (k, a), c in rules.main_codes().items()})
    df = df.withColumns({
        "_mc": mains[F.concat_ws("|", "panel_kind", F.col("_frame").cast("string"))],
        "_bc": F.get(F.array_intersect(branch_codes(
            F.col("panel_kind"), F.col("_frame"), F.col("_pole"), F.col("_elb")), codes), 0)})
    main = F.when(~F.col("_elb") & (F.col("_pole") == "3") & F.array_contains(codes, F.col("_mc")), F.col("_mc"))
    return df.withColumn("breaker", F.when(F.col("af_any").isNotNull(), F.when(
        F.col("_main"), main).otherwise(F.col("_bc")))).drop("_main", "_elb", "_pole", "_frame", "_mc", "_bc")


def with_motor_code(df: DataFrame) -> DataFrame:
    """Adds motor: the code of a direct starter or inverter set named by its text."""
    form, name = F.col("cform"), F.col("cname")
    kw = F.col("kw_text").cast("double")
    band = F.when(F.col("band") == "400V", "400V").otherwise("200V")
    direct = F.when(form.contains("ls") & form.contains("kw"),
                    _motor_code("direct", band, kw, F.lit(False)))
    inverter = F.when(name.contains("インバータ") | (form.contains("inv") & ~form.contains("mcb")
                                                & ~name.contains("盤")),
                      _motor_code("inverter", band, kw, name.contains("支給")))
    return df.withColumn("motor", F.coalesce(direct, inverter))


def _motor_code(kind: str, band: Column, kw: Column, supplied: Column) -> Column:
    table = t.text_map({f"{k}|{b}|{kw:g}|{s}".lower(): c for (k, b, kw, s), c in rules.motor_codes().items()})
    return table[F.lower(F.concat_ws("|", F.lit(kind), band, t.number_text(kw), supplied.cast("string")))]


def _first_named(cands: Column, *parts: Column) -> Column:
    """Code of the first candidate whose name holds all parts."""
    hit = F.filter(cands, lambda c: F.forall(F.array(*parts), lambda p: c["name"].contains(p)))
    return F.get(hit, 0)["code"]


# --- symbol recipes -----------------------------------------------------------------------

def _recipes() -> str:
    """SQL map: symbol -> devices; supply-only symbols hold one device without a kind."""
    def device(kind, qty):
        return f"named_struct('kind', {t.sql(kind) if kind else 'CAST(NULL AS string)'}, 'qty', {qty})"
    return "map(" + ", ".join(f"'{s}', array({', '.join(device(*d) for d in devices)})"
                              for s, devices in rules.SYMBOL_RECIPES.items()) + ")"


def with_recipe(df: DataFrame, symbol: str, kw: Column, volt: Column, supplied: Column, known: str,
                out: str = "parts") -> DataFrame:
    """Adds ARRAY<STRUCT<code, qty, kind, step, clamped>>: the devices a main-circuit symbol
    stands for, each with the code of the next capacity step; NULL without a symbol.

    Beyond the largest step that step is taken and marked as clamped.
    """
    codes = {f"{k}|{b}|{kw:g}|{str(s).lower()}": c for (k, b, kw, s), c in rules.motor_codes().items()}
    ladders = "map(" + ", ".join(
        f"'{k}', array({', '.join(f'{float(v)}D' for v in steps)})" for k, steps in rules.MOTOR_SUFFIX.items()) + ")"
    df = df.withColumns({
        "_kw": kw.try_cast("double"), "_band": F.when(volt == "400V", "400V").otherwise("200V"),
        "_own": supplied.cast("string"), "_ladders": F.expr(ladders), "_codes": t.text_map(codes),
        "_devices": F.expr(f"""IF(coalesce({symbol}, '') = '', NULL, coalesce(
            try_element_at({_recipes()}, upper(trim({symbol}))),
            array(named_struct('kind', CAST(NULL AS string), 'qty', 1))))""")})
    df = df.withColumn("_steps", F.expr("""transform(_devices, d -> named_struct('kind', d.kind, 'qty', d.qty,
        'fit', array_min(filter(_ladders[d.kind], s -> s >= _kw)), 'top', array_max(_ladders[d.kind])))"""))
    df = df.withColumn("_steps", F.expr("""transform(_steps, d -> named_struct('kind', d.kind, 'qty', d.qty,
        'step', IF(_kw IS NULL, NULL, coalesce(d.fit, d.top)),
        'clamped', coalesce(_kw > d.top, false)))"""))
    number = r"regexp_replace(format_string('%.6f', d.step), r'\.?0+$', '')"
    df = df.withColumn("_steps", F.expr(f"""transform(_steps, d -> named_struct(
        'code', coalesce(_codes[concat_ws('|', d.kind, _band, {number}, _own)], ''),
        'qty', d.qty, 'kind', d.kind, 'step', d.step, 'clamped', d.clamped))"""))
    return df.withColumn(out, F.expr(f"""transform(_steps, d -> named_struct(
        'code', IF(array_contains({known}, d.code), d.code, ''),
        'qty', d.qty, 'kind', d.kind, 'step', d.step, 'clamped', d.clamped))""")).drop(
        "_kw", "_band", "_own", "_ladders", "_codes", "_devices", "_steps")


def with_part_notes(df: DataFrame, symbol: str, kw: Column, names: str, parts: str = "parts") -> DataFrame:
    """Adds name and note to every device of ``with_recipe``.

    name: the catalogue's name of its code, empty without one (names: column with MAP<code, name>).  note: the device
    and the step it was put in, what to check where it has no code, or why the symbol stands for none.
    """
    number = r"regexp_replace(format_string('%.6f', {}), r'\.?0+$', '')"
    labels = ", ".join(f"{t.sql(k)}, {t.sql(v)}" for k, v in rules.DEVICE_LABELS.items())
    known = ", ".join(t.sql(s) for s in rules.SYMBOL_RECIPES)
    df = df.withColumns({"_kw": kw.try_cast("double"), "_sign": F.upper(F.trim(F.coalesce(symbol, F.lit(""))))})
    return df.withColumn(parts, F.expr(f"""transform({parts}, (d, i) -> named_struct(
        'code', d.code, 'qty', d.qty, 'kind', d.kind, 'step', d.step, 'clamped', d.clamped,
        'name', coalesce(try_element_at({names}, d.code), ''),
        'note', CASE
          WHEN d.kind IS NULL AND _sign IN ({known}) THEN concat('symbol ', _sign, ': supply only')
          WHEN d.kind IS NULL THEN concat('symbol ', _sign, ' unknown, check')
          ELSE concat(map({labels})[d.kind], IF(i > 0, ' as bypass', ''),
            CASE WHEN _kw IS NULL THEN '' WHEN d.code = '' THEN concat(' ', {number.format('_kw')}, ' kW')
              WHEN size({parts}) = 1 THEN concat(' ', {number.format('_kw')}, ' -> ', {number.format('d.step')}, ' kW')
              ELSE concat(' ', {number.format('d.step')}, ' kW') END,
            IF(d.qty > 1, concat(' x', d.qty), ''), IF(d.code = '', ', check', '')) END))""")).drop("_kw", "_sign")


def recipe_grade(parts: Column) -> Column:
    head = F.get(parts, 0)
    clamped = F.exists(parts, lambda p: p["clamped"])
    return (F.when((head["code"] == "") | clamped, rules.CHECK)
            .when(F.size(parts) == 1, rules.SURE).otherwise(rules.NEARLY))


# --- the rules ------------------------------------------------------------------------

def with_decision(df: DataFrame, codes: Column, ruling=rules.DECISION_RULES) -> DataFrame:
    """Adds sel STRUCT<rule, code, conf, note>: the rule of ``ruling`` that settles the evidence columns.

    ruling: rows as in ``rules.DECISION_RULES`` or a DataFrame of them (see ``ruletable``).
    """
    c = F.col
    form, name, part, band, cands = (c(n) for n in ("cform", "cname", "part", "band", "cands"))
    has = lambda code: F.array_contains(codes, code)
    amp = x.amps(form)
    terminal = part == "TB"
    motor = c("motor")
    ct_high = lookup.bucket(c("ratio"), rules.CT_HV_BUCKETS)
    ct_low = t.text_map({str(k): v for k, v in rules.CT_LV.items()})[c("ratio").cast("string")]
    qform = c("form")
    ds_amp = F.concat(t.first(qform, r"(\d+)a(?![a-z])"), F.lit("A"))
    control = t.text_map({str(k): v for k, v in rules.TB_CONTROL.items()})[amp]
    general = t.text_map({str(k): v for k, v in rules.TB_GENERAL.items()})[amp]
    n = F.coalesce(F.size(cands), F.lit(0))
    top = F.get(cands, 0)
    res = c("res")
    df = df.withColumns({
        "_ds3": _first_named(cands, F.lit("3P"), ds_amp, F.lit("標準")),
        "_ds1": _first_named(cands, F.lit("1P"), ds_amp, F.lit("標準"))})
    any_pole = F.coalesce("_ds3", "_ds1")
    conditions = {
        "main_terminal": terminal & c("after_main"), "terminal": terminal, "control_panel": c("tb_control"),
        "control_code": has(control), "general_code": has(general),
        "surge_breaker": form.contains("spd用") & form.rlike("mcb|mccb"), "frame": c("af").isNotNull(),
        "breaker_part": part.isin(*rules.BREAKER_PARTS), "breaker_code": c("breaker").isNotNull(),
        "motor": motor.isNotNull(),
        "ct": (part == "CT") & c("ratio").isNotNull(), "high_band": band == "HV",
        "low_band": band.isin("200V", "400V", "100V"), "ct_high_code": has(ct_high), "ct_low_code": has(ct_low),
        "capacity": c("series").isNotNull(), "step_fits": c("fit").isNotNull(),
        "step_equal": F.abs(c("fit") - c("kva").cast("double")) < 1e-6, "largest_step": c("top_cap").isNotNull(),
        "part": part.isNotNull(),
        "disconnector": qform.rlike("(^|[^a-z])ds([^a-z]|$)"), "three_poles": qform.contains("3p"),
        "poles": qform.rlike("[123]p"), "three_pole_code": c("_ds3").isNotNull(), "any_pole_code": any_pole.isNotNull(),
        "leak_relay": form.rlike("(^|[^a-z])(lgr|lgry)([^a-z]|$)"), "two_stage": name.contains("2段") | name.contains("警報"),
        "plain_relay_code": has(F.lit(rules.LGR_PLAIN)), "two_stage_code": has(F.lit(rules.LGR_TWO_STAGE)),
        "candidates": n > 0, "vmc": form.rlike("(^|[^a-z])vmc([^a-z]|$)"), "one_candidate": n == 1,
        "explained": F.size(res["missing"]) == 0, "agreed": F.size(res["matched"]) > 0,
        "option_agreed": F.exists(c("opts"), lambda o: (t.squeeze(o) != "") & c("top_form").contains(t.squeeze(o))),
        "standard": t.contains_any(top["name"], rules.DEFAULT_WORDS),
    }
    results = {
        "control": control, "general": general, "breaker": c("breaker"), "motor": F.when(has(motor), motor),
        "ct_high": ct_high, "ct_low": ct_low, "step": c("fit_code"), "three_pole": c("_ds3"), "any_pole": any_pole,
        "plain_relay": F.lit(rules.LGR_PLAIN), "two_stage_relay": F.lit(rules.LGR_TWO_STAGE), "top": top["code"],
    }
    fields = {
        "place": F.when(name.contains("主幹") | part.startswith("M)"), "main").otherwise("branch"),
        "device": F.when(form.contains("elb"), "ELB").otherwise("MCB"),
        "step": t.number_text(c("fit")), "largest": t.number_text(c("top_cap")), "candidates": n.cast("string"),
        "missing": F.array_join(F.array_sort(res["missing"]), ", "),
    }
    return with_ruling(df, ruling, conditions, results, fields).drop("_ds3", "_ds1")


def missing_attributes(part: str, text: str, required: bool, spec=None) -> Column:
    """Attributes of the part's class whose pattern the text does not show."""
    spec = rules.attr_spec() if spec is None else spec
    cases = []
    for cls in dict.fromkeys(s[0] for s in spec):
        checks = ", ".join(f"IF({text} rlike {t.sql('(?i)' + p)}, NULL, {t.sql(a)})"
                           for c, a, p in ((c, a, p) for c, a, r, p in spec if c == cls and r == required))
        if checks:
            cases.append(f"WHEN {part} = {t.sql(cls)} THEN array_compact(array({checks}))")
    return F.expr(f"CASE {' '.join(cases)} ELSE CAST(array() AS array<string>) END")


def with_missing_attributes(df: DataFrame, part: str, text: str, spec: DataFrame) -> DataFrame:
    """Adds missing_attrs and missing_opt by a spec table (class, pos, attr, required, pattern) of any size.

    A part's class is its upper-case spelling, else its own; a part without a class, a null text and an attribute
    without a pattern miss nothing.  Distinct texts are checked once, sorted by pattern, so that a task compiles
    each of its patterns once.
    """
    asked = df.select(F.col(part).alias("_part"), F.col(text).alias("_text")).dropna().distinct()
    parts = asked.select("_part").distinct().withColumn("_keys", F.array_distinct(F.array(F.upper("_part"), "_part")))
    owned = lookup.first_existing(parts, ["_part"], "_keys", spec.select("class").distinct(), "class", "_class")
    checks = spec.where("pattern is not null").select(F.col("class").alias("_class"), "pos", "attr", "required", "pattern")
    each = asked.join(owned.select("_part", "_class"), "_part").join(checks, "_class").sortWithinPartitions("pattern")
    absent = F.regexp_instr("_text", F.concat(F.lit("(?i)"), "pattern")) == 0
    lacking = each.groupBy("_part", "_text").agg(F.array_sort(F.collect_list(
        F.when(absent, F.struct("pos", "attr", "required")))).alias("_lacking"))
    found = df.join(lacking, (F.col(part) == F.col("_part")) & (F.col(text) == F.col("_text")), "left")
    def names(required):
        kept = F.filter("_lacking", lambda a: a["required"] == F.lit(required))
        return F.coalesce(F.transform(kept, lambda a: a["attr"]), t.empty_strings())
    return found.withColumns({"missing_attrs": names(True), "missing_opt": names(False)}).drop(
        "_part", "_text", "_lacking")


def evidence(contexts: DataFrame, cats: DataFrame) -> DataFrame:
    """Joins every distinct context with what the rules need: features, candidates, capacity fit."""
    feats = item_features(contexts)
    feats = feats.withColumn("_own", t.nfkc(F.col("cname")))
    feats = feats.withColumns({"cform": t.squeeze(F.col("_own")), "cspaced": t.compact(F.col("_own"))})
    feats = written(series_of_item(feats.drop("_own")))
    best = written(candidates(feats, written(catalogue_features(first_alike(cats))))).alias("b")
    f = feats.alias("f")
    on = None
    for col in ("part", "band", "form", "vals", "opts"):
        eq = F.col(f"f.{col}").eqNullSafe(F.col(f"b.{col}"))
        on = eq if on is None else on & eq
    df = f.join(best, on, "left").select("f.*", "b.cands")
    df = df.withColumn("want", F.col("kva").cast("double"))
    fit = lookup.nearest_above(df.where("series is not null").select("series", "want"),
                               capacity_ladder(cats), ["series"], "want", "cap", "code")
    df = df.join(fit.withColumnRenamed("top", "top_cap"), ["series", "want"], "left")
    top = F.get("cands", 0)
    df = df.withColumns({"_top": top["name"], "_volt": top["volt"]}).withColumn("_fold", t.nfkc(F.col("_top")))
    df = df.withColumns({"top_vals": x.attribute_values("_fold", "_volt"),
                         "top_form": t.squeeze(F.col("_fold"))})
    return df.withColumn("res", residual(F.col("vals"), F.col("_top"), F.col("top_vals"))).drop(
        "_top", "_volt", "_fold")


def select_codes(contexts: DataFrame, cats: DataFrame, spec: DataFrame | None = None,
                 ruling=rules.DECISION_RULES) -> DataFrame:
    """Settles every distinct context: rule, code, conf, note, candidates, parts, missing attributes.

    cats is the written catalogue; spec replaces the built-in attribute spec, ruling the built-in decision rules.  A
    context that no rule settles has no code and is to be checked.
    """
    df = evidence(contexts, cats).withColumn("known", known_codes(cats))
    codes = F.col("known")
    # the conditions name these columns many times; written, they are evaluated once
    df = written(with_motor_code(with_breaker_code(df, codes)))
    by_symbol = F.coalesce(F.col("symbol"), F.lit("")) != ""
    kw = F.coalesce(F.nullif(F.col("kw"), F.lit("")), F.col("kw_text"))
    volt = F.coalesce(F.nullif(F.col("volt"), F.lit("")), F.lit("200V"))
    df = with_recipe(df, "symbol", kw, volt, F.col("cname").contains("支給"), "known")
    df = with_part_notes(df.withColumn("_names", known_names(cats)), "symbol", kw, "_names")
    head = F.get("parts", 0)
    df = df.withColumn("_grade", recipe_grade(F.col("parts")))
    df = with_decision(df, codes, ruling)
    df = df.withColumn("sel", F.when(by_symbol, _result("SYMBOL", head["code"], F.col("_grade"), "by main-circuit symbol"))
                       .otherwise(F.coalesce("sel", _result("", "", rules.CHECK, "no rule"))))
    df = df.select(*CONTEXT, "part", "cform", "parts", "sel.*", "cands", by_symbol.alias("by_symbol"))
    df = promote_group(df)
    if spec is None:
        df = df.withColumns({"missing_attrs": missing_attributes("part", "cname", True),
                             "missing_opt": missing_attributes("part", "cname", False)})
    else:
        df = with_missing_attributes(df, "part", "cname", spec)
    checked = ~F.col("by_symbol") & (F.col("code") != "")
    df = df.withColumns({c: F.when(checked, F.col(c)).otherwise(t.empty_strings()) for c in ("missing_attrs", "missing_opt")})
    lowered = (F.size("missing_attrs") > 0) & (F.col("conf") == rules.SURE)
    return df.withColumn("note", F.when(lowered, F.concat(
        F.lit("required values missing ("), F.array_join("missing_attrs", "/"), F.lit("): "), "note"))
        .otherwise(F.col("note"))).withColumn(
        "conf", F.when(lowered, rules.NEARLY).otherwise(F.col("conf"))).select(
        *CONTEXT, "part", "rule", "code", "conf", "note", "parts", "missing_attrs", "missing_opt",
        F.when(F.col("by_symbol"), None).otherwise(F.slice("cands", 1, SHOWN)).alias("candidates"))


def promote_group(df: DataFrame) -> DataFrame:
    """A doubtful accessory of a named relay group counts as nearly sure."""
    grp = F.coalesce(F.col("grp"), F.lit(""))
    own = F.coalesce(t.squeeze(F.col("part")), F.col("cform"))
    lifted = (~F.col("by_symbol") & (grp != "") & (F.coalesce(F.size("cands"), F.lit(0)) > 0)
              & (F.col("conf") == rules.CHECK) & (F.col("code") != "")
              & ~own.contains(t.squeeze(grp)))
    return df.withColumn("note", F.when(lifted, F.concat(F.lit("accessory of "), grp, F.lit(": "), "note"))
                         .otherwise(F.col("note"))).withColumn(
        "conf", F.when(lifted, rules.NEARLY).otherwise(F.col("conf")))


def check_answers(df: DataFrame, answer: str, catalogue: DataFrame) -> DataFrame:
    """Accepts an outside answer ``code,HIGH|LOW`` only if the catalogue has the code."""
    pattern = r"(?i)^\s*(\d+|none)\s*,?\s*(HIGH|LOW)?"
    asked = df.withColumns({"code": F.regexp_extract(answer, pattern, 1),
                            "_sure": F.upper(F.regexp_extract(answer, pattern, 2)) == "HIGH"})
    found = lookup.lookup(asked, catalogue.withColumn("_hit", F.lit(True)), "code")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return found.withColumns({
        "code": F.when(hit, F.col("code")).otherwise(""), "name": F.when(hit, F.col("name")).otherwise(""),
        "conf": F.when(hit & F.col("_sure"), rules.NEARLY).otherwise(rules.CHECK)}).drop("_hit", "_sure")
