"""Registered queries: every operator bound to the driver tables."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from catamatch import rules
from catamatch.functions import extract as x
from catamatch.functions import text as t
from catamatch.operators import candidates as cd
from catamatch.operators import context as ctx
from catamatch.operators import decide, lookup, ordered, report, scores
from catamatch.operators.dictionary import first_aliases
from catamatch.operators.match import contained_matches, token_matches
from catamatch.operators.pipeline import contexts_of, graded_and_details, graded_rows, marked_rows, select_items
from catamatch.operators.stage import shared_folder, written
from catamatch.plans import views
from catamatch.plans.views import table
from catamatch.sources import documents as docs
from catamatch.sources.versioned import VersionedTable, process_new, replace_documents

REGISTRY = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def _items(s, d):
    return views.items(s, d)


def _cat(s, d):
    return views.catalogue(s, d)


def _pairs(array) -> F.Column:
    return F.array_join(array, "|")


def _texts(s, d) -> DataFrame:
    """Distinct item texts with the number of items that have them."""
    return _items(s, d).groupBy(F.col("name").alias("cname"), "volt").agg(F.count("*").alias("n_items"))


def _text_features(s, d) -> DataFrame:
    return cd.item_features(_texts(s, d))


def _text_candidates(s, d) -> tuple[DataFrame, DataFrame]:
    """(texts with cands, features of the catalogue rows that can be candidates)."""
    feats = written(_text_features(s, d))
    cats = written(cd.catalogue_features(cd.first_alike(views.first_described(s, d, cd.KEPT))))
    best = cd.candidates(feats, cats)
    key = F.coalesce("part", F.lit(""))
    out = feats.withColumn("_p", key).join(
        best.withColumn("_p", key).drop("part"), ["_p", "band", "form", "vals", "opts"]).drop("_p")
    return out, cats


# --- sources and sinks ---------------------------------------------------------------------

@query
def catalog_scan(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part").select(F.concat_ws("|", "p_name", "p_brand").alias("code"),
                                      F.col("p_partkey").alias("ord"), F.col("p_type").alias("kind"),
                                      F.col("p_size").alias("spec"))
    return lookup.unique_by_key(part, "code", "ord")


@query
def attr_spec_long(s, d):
    part = table(s, d, "part").select("p_partkey", F.expr(
        """'{"' || p_type || '": {"required": ["size", "brand"], "optional": ["price"], "patterns": {"size": "'
           || CAST(p_size AS STRING) || 'A", "brand": "' || p_brand || '"}}}'""").alias("spec"))
    return docs.spec_rows(part, ["p_partkey"], "spec").drop("pos")


@query
def catalogue_arrays(s, d):
    """The parts of a brand as one catalogue array, every seventh without a code."""
    part = table(s, d, "part").select("p_brand", "p_partkey", F.expr(
        """CASE p_partkey % 7 WHEN 0 THEN '{"name": "' || p_name || '"}' WHEN 1 THEN 'null'
           ELSE '{"code": "' || CAST(p_partkey AS STRING) || '", "name": "' || p_name || '", "kind": "' || p_type || '"}' END""").alias("row"))
    arrays = part.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "row"))).alias("rows"))
    text = F.concat(F.lit("["), F.array_join("rows.row", ",\n"), F.lit("]"))
    return docs.catalogue_rows(arrays.select("p_brand", text.alias("json")), ["p_brand"], "json")


_DOC = """'{"panels":[{"panel":"' || event_type || '","items":[{"name":"' || event_type || ' ' || CAST(event_id AS STRING)
  || 'A","qty":"' || CAST(user_id AS STRING) || '"},{"name":"L-1 5kVA","load_detail":true}]},{"items":[{"qty":"7"}]}]}'"""


@query
def nested_flatten(s, d):
    raw = table(s, d, "events").select("event_id", F.expr(_DOC).alias("json"))
    return docs.flatten(raw, ["event_id"], "json").select(
        "event_id", "panel_idx", "panel", "item_idx", "name", "qty", "load_detail")


@query
def json_salvage(s, d):
    raw = table(s, d, "events").select("event_id", F.expr(
        """CASE event_id % 5 WHEN 1 THEN '```json\n' || props || '\n```' WHEN 2 THEN 'note: ' || props || ' end'
           WHEN 3 THEN '{"k": ' || CAST(event_id AS STRING) ELSE props END""").alias("raw"))
    return (raw.withColumn("json", docs.salvage(F.col("raw")))
            .select("event_id", F.col("json").isNotNull().alias("ok"),
                    F.from_json("json", "k BIGINT")["k"].alias("k")))


@query
def dead_letter_split(s, d):
    raw = table(s, d, "events").select("event_id", F.expr(
        f"CASE WHEN event_type = 'error' THEN '{{\"panels\": ' ELSE {_DOC} END").alias("raw"))
    rows = docs.read_documents(raw, ["event_id"], "raw", F.concat(F.lit("event-"), F.col("event_id").cast("string")))
    return rows.select("event_id", "panel_idx", "panel", "item_idx", "name", "unclear")


@query
def read_counts(s, d):
    """Files read and failed, panels (empty ones too) and items, as the reading pass counts them."""
    raw = table(s, d, "events").select("event_id", F.expr(
        f"""CASE event_type WHEN 'error' THEN '{{"panels": ' WHEN 'view' THEN '{{"panels":[{{"panel":"a","items":[]}},{{"panel":"b"}}]}}'
            WHEN 'click' THEN '{{"panels":[]}}' ELSE {_DOC} END""").alias("raw"))
    counts = Observation("read")
    docs.read_documents(raw, ["event_id"], "raw", F.col("event_id").cast("string"), counts)
    return s.createDataFrame([counts.get], "n_docs bigint, n_failed bigint, n_panels bigint, n_items bigint")


@query
def path_filter(s, d):
    return table(s, d, "pages").where(docs.accepted(F.col("url"), (".html", ".htm"))).select("page_id", "url")


@query
def content_dedup(s, d):
    def process(distinct):
        return distinct.select("hash", F.length(t.squeeze(t.nfkc(F.col("text")))).alias("n_form"))
    return docs.process_once(table(s, d, "documents").select("doc_id", "text"), "text", process)


@query
def stored_results(s, d):
    """Documents of two runs over one results table: the second one processes only what is new."""
    def process(new):
        return new.select("hash", F.length(t.squeeze(t.nfkc(F.col("content")))).alias("n_form"))
    results = VersionedTable(s, f"{shared_folder(s)}/{uuid.uuid4().hex}", "hash string, n_form int")
    first = table(s, d, "benchmark").select("item_id", F.col("text").alias("content"))
    process_new(results, first, process)
    both = table(s, d, "documents").select("doc_id", F.col("text").alias("content")).unionByName(
        first.withColumnRenamed("item_id", "doc_id"))
    return process_new(results, both, process).select("doc_id", "n_form")


@query
def detail_sink(s, d):
    """Marked items as the sink holds them after a run and its rerun."""
    rows = ctx.mark_rows(_items(s, d)).select(*ctx.KEY, "panel", "name", "qty", "state")
    sink = VersionedTable(s, f"{shared_folder(s)}/{uuid.uuid4().hex}",
                          "doc_id bigint, panel_idx int, item_idx bigint, panel string, name string, qty string, state string")
    for _ in range(2):
        replace_documents(sink, rows, ctx.KEY)
    return sink.read()


@query
def provenance_label(s, d):
    return table(s, d, "pages").select("page_id", docs.provenance(
        F.col("url"), F.regexp_extract("url", "^https?://([^/]+)", 1)).alias("label"))


@query
def ordered_text_assembly(s, d):
    placed = table(s, d, "conversations").select(
        "conv_id", "text", (F.col("turn") % 2).alias("x"), (-F.floor(F.col("turn") / 2)).alias("y"))
    return docs.assemble(placed, "conv_id", "x", "y", "text")


@query
def ordered_lines(s, d):
    """Events as placed text: a user is a document, the value the height, the day the place in a line."""
    placed = table(s, d, "events").select(
        F.col("user_id").alias("doc_id"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("text"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("x"), F.floor(F.col("value")).cast("long").alias("y"))
    return docs.ordered_lines(placed, "doc_id", "x", "y", "text")


@query
def report_detail(s, d):
    return report.detail(select_items(_items(s, d), _cat(s, d), wide=False))


@query
def report_summary(s, d):
    graded, details = graded_and_details(_items(s, d), _cat(s, d))
    return report.summary_lines(report.summary(graded), details)


# --- expressions ---------------------------------------------------------------------------

@query
def text_normalize(s, d):
    return table(s, d, "documents").select("doc_id", t.squeeze(t.nfkc(F.col("text"))).alias("form"))


@query
def qty_split(s, d):
    df = _items(s, d).withColumn("_q", x.split_quantity(F.col("name")))
    return df.select("item_idx", F.col("_q.text").alias("text"), F.coalesce("_q.qty", "qty").alias("qty"))


@query
def main_option_split(s, d):
    return _text_features(s, d).select("cname", "volt", "main_text", _pairs("opts").alias("opts"))


@query
def band_classify(s, d):
    item = _text_features(s, d).select(F.lit("item").alias("side"), F.concat_ws("|", "cname", "volt").alias("key"), "band")
    row = _cat(s, d).select(F.lit("catalogue").alias("side"), F.col("code").alias("key"),
                            x.band_of_catalogue(F.col("volt")).alias("band"))
    return item.unionByName(row)


@query
def unit_numbers(s, d):
    return _text_features(s, d).select(
        "cname", "volt", F.col("kw_text").alias("kw"), "kva", x.amps(F.col("form")).alias("amp"),
        x.poles(F.col("form")).alias("pole"), "ratio")


@query
def frame_trip_parse(s, d):
    return x.with_frame(_text_features(s, d), "form").select("cname", "volt", "af", "at")


@query
def attr_value_set(s, d):
    item = _text_features(s, d).select(F.lit("item").alias("side"), F.concat_ws("|", "cname", "volt").alias("key"),
                                       _pairs("vals").alias("vals"))
    row = cd.catalogue_features(_cat(s, d)).select(F.lit("catalogue").alias("side"), F.col("code").alias("key"),
                                                   _pairs("vals").alias("vals"))
    return item.unionByName(row)


@query
def category_fallback(s, d):
    df = _text_features(s, d).withColumns({
        "cform": F.col("form"), "cspaced": t.compact(F.col("fold")), "capacitor_panel": F.lit(False)})
    return decide.series_of_item(df).select(
        "cname", "volt", "class_label", "high",
        F.when(F.col("series").isNotNull(), F.split("series", r"\|")[2]).alias("ladder"))


@query
def alias_classify(s, d):
    return _text_features(s, d).groupBy("part").agg(F.count("*").alias("n_texts"), F.sum("n_items").alias("n_items"))


@query
def dictionary_parts(s, d):
    """Item texts by a dictionary of the rule table's aliases and, after them, the first words of all catalogue names."""
    rule = [(t.squeeze_literal(a), p, i) for i, (a, p) in enumerate(rules.aliases())]
    words = _cat(s, d).groupBy(t.squeeze(t.nfkc(F.element_at(F.split("name", " "), 1))).alias("alias")).agg(
        (F.min("ord") + len(rule)).alias("priority")).select("alias", F.col("alias").alias("part"), "priority")
    named = s.createDataFrame(rule, "alias string, part string, priority bigint").unionByName(words)
    texts = _items(s, d).select(t.squeeze(t.nfkc(F.col("name"))).alias("form")).distinct()
    return first_aliases(texts, named).select("form", "alias", "part")


@query
def display_compose(s, d):
    marked = marked_rows(_items(s, d))
    loads = ctx.loads_per_parent(ctx.detail_rows(marked))
    df = marked.where("state = 'kept'").join(loads, ctx.KEY, "left")
    feed = x.feed_number(F.col("name"))
    return df.select("item_idx", F.coalesce(feed, F.lit("")).alias("feed"), x.display_text(
        F.col("name"), feed, F.coalesce("loads", t.empty_strings())).alias("display"))


# --- filters -------------------------------------------------------------------------------

@query
def exclude_patterns(s, d):
    return ctx.mark_rows(_items(s, d)).select("item_idx", "state")


@query
def grade_filter(s, d):
    return report.of_grade(select_items(_items(s, d), _cat(s, d), wide=False), rules.NEARLY).select("item_idx", "code", "conf")


# --- joins ---------------------------------------------------------------------------------

def _sold(s, d):
    """Line items combined per order before any lookup; most order numbers are no part number."""
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("ord")).agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


def _parts(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("ord"), "p_name", "p_brand")


@query
def code_lookup(s, d):
    return lookup.lookup(_sold(s, d), _parts(s, d), "ord")


@query
def code_exists_semi(s, d):
    return lookup.existing(_sold(s, d), _parts(s, d), "ord")


@query
def code_missing_anti(s, d):
    return lookup.missing(_sold(s, d), _parts(s, d), "ord")


def _wants(s, d):
    part = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    want = F.floor(F.col("l_extendedprice") / 100) / 10
    sold = table(s, d, "lineitem").groupBy("l_partkey", want.alias("want")).agg(F.count("*").alias("n"))
    return sold.join(part, "l_partkey").groupBy("p_brand", "want").agg(F.sum("n").alias("n"))


def _steps(s, d):
    return table(s, d, "part").select(
        "p_brand", F.col("p_size").cast("double").alias("cap"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("code"))


def _nearest(s, d, operator):
    wants = _wants(s, d)
    fit = operator(wants, _steps(s, d), ["p_brand"], "want", "cap", "code")
    return wants.join(fit, ["p_brand", "want"], "left").select(
        "p_brand", "want", "n", "fit", "fit_code", "top",
        F.when(F.col("fit") == F.col("want"), rules.SURE).when(F.col("fit").isNotNull(), rules.NEARLY)
        .otherwise(rules.CHECK).alias("conf"))


@query
def nearest_above_join(s, d):
    return _nearest(s, d, lookup.nearest_above)


@query
def nearest_above_window(s, d):
    return _nearest(s, d, lookup.nearest_above_window)


@query
def ladder_round_clamp(s, d):
    df = table(s, d, "lineitem").select(
        F.col("l_quantity").alias("value"), F.floor(F.col("l_extendedprice") / 30).cast("long").alias("af"),
        (F.col("l_quantity") * 10).cast("long").alias("at"))
    df = df.groupBy("value", "af", "at").agg(F.count("*").alias("n"))
    df = df.withColumns({k: lookup.round_up(F.col("value"), rules.MOTOR_SUFFIX[k]) for k in ("direct", "inverter")})
    return df.groupBy("value", F.col("direct.step").alias("direct"), F.col("direct.clamped").alias("clamped"),
                      F.col("inverter.step").alias("inverter"),
                      x.standard_frame(F.col("af"), F.col("at")).alias("frame")).agg(F.sum("n").alias("n"))


_BANDS = ((0.0, 50000.0, "low"), (50000.0, 200000.0, "middle"), (200000.0, 450000.0, "high"))


@query
def bucket_range_join(s, d):
    bands = lookup.rule_table(s, _BANDS, "lo double, hi double, label string")
    orders = table(s, d, "orders").select("o_orderkey", "o_totalprice")
    return lookup.bucket_join(orders, bands, "o_totalprice").groupBy("label").agg(
        F.count("*").alias("n"), F.max("o_totalprice").alias("top"))


def _frames(s, d):
    """Items with panel kind and standard frame, NULL where the text names none."""
    df = x.with_frame(ctx.mark_rows(_items(s, d)), "form")
    df = df.withColumns({"kind": x.panel_kind(F.col("panel_form")),
                         "frame": x.standard_frame(F.col("af"), F.col("at")),
                         "pole": x.poles(F.col("form")), "elb": F.col("form").contains("elb")})
    return df.select("item_idx", "kind", "frame", "pole", "elb")


@query
def decision_table_join(s, d):
    rows = [(k, a, c) for (k, a), c in rules.main_codes().items()]
    main = lookup.rule_table(s, rows, "kind string, frame bigint, code string")
    return lookup.lookup(_frames(s, d), main, ["kind", "frame"]).select("item_idx", "kind", "frame", "code")


@query
def first_existing_key(s, d):
    # a handful of attribute values decides the key, so each combination is tried once
    df = written(_frames(s, d))
    ids = ["kind", "frame", "pole", "elb"]
    tried = df.select(*ids).distinct().withColumn("keys", decide.branch_codes(
        F.col("kind"), F.col("frame"), F.col("pole"), F.col("elb")))
    found = lookup.first_existing(tried, ids, "keys", _cat(s, d).select("code"), "code", "code")
    same = reduce(and_, [F.col(f"i.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ids])
    return df.alias("i").join(found.alias("f"), same).select("i.item_idx", "i.kind", "i.frame", "f.code")


@query
def interval_contains_join(s, d):
    points = _text_features(s, d).where("ratio is not null").groupBy("ratio").agg(F.sum("n_items").alias("n_items"))
    spans = _cat(s, d).select(x.interval_of_name(F.col("name")).alias("i")).where("i is not null").groupBy(
        "i.lo", "i.hi").agg(F.count("*").alias("n_codes"))
    return lookup.interval_join(points, spans, [], "ratio", "lo", "hi")


def _tokens(df, key, text):
    return df.select(F.col(key), F.explode(F.array_distinct(F.transform(
        F.split(text, r"[\s　()（）]"), lambda w: F.lower(w)))).alias("token")).where(F.length("token") >= 2)


@query
def token_overlap_topk(s, d):
    items = _tokens(table(s, d, "benchmark"), "item_id", "text")
    rows = _tokens(table(s, d, "documents").withColumnRenamed("doc_id", "ord"), "ord", "text")
    return token_matches(items, rows, "item_id", 25)


@query
def token_contains_topk(s, d):
    """Item texts against catalogue names: a name is a hit if it contains a token of the text."""
    named = _items(s, d).select(F.col("name").alias("cname")).distinct()
    tokens = named.select("cname", F.explode(F.filter(F.split("cname", r"[\s　()（）]"), lambda w: F.length(w) >= 2)).alias("w"))
    tokens = tokens.select("cname", t.squeeze(t.nfkc(F.col("w"))).alias("token"))
    rows = ordered.first_per_group(_cat(s, d).select("ord", "name"), ["name"], ["ord"], 25, "_r").select(
        "ord", t.squeeze(t.nfkc(F.col("name"))).alias("form"))
    return contained_matches(tokens, rows, "cname", 25)


@query
def closed_world_check(s, d):
    asked = table(s, d, "orders").select("o_orderkey", F.expr(
        """CASE o_orderstatus WHEN 'F' THEN ' ' || CAST(o_orderkey AS STRING) || ', HIGH'
           WHEN 'O' THEN CAST(o_orderkey AS STRING) || ',low' ELSE 'NONE' END""").alias("answer"))
    known = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"))
    return decide.check_answers(asked, "answer", known).select("o_orderkey", "code", "name", "conf")


@query
def required_attrs(s, d):
    return _text_features(s, d).select(
        "cname", "volt", "part", _pairs(decide.missing_attributes("part", "cname", True)).alias("required"),
        _pairs(decide.missing_attributes("part", "cname", False)).alias("optional"))


@query
def required_attrs_table(s, d):
    """Order lines checked by a spec of one class a part type, read from its JSON form."""
    part = table(s, d, "part")
    spec = part.groupBy("p_type").agg(F.min("p_size").alias("size"), F.min("p_brand").alias("brand")).select(F.expr(
        """'{"' || p_type || '": {"required": ["size", "brand"], "optional": ["mode", "none"], "patterns": {"size": "(^| )'
           || CAST(size AS STRING) || 'A", "brand": "' || lower(brand) || '", "mode": "[ar]$"}}}'""").alias("spec"))
    lines = table(s, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "p_type", F.concat_ws(
            " ", "p_brand", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("A")), "l_returnflag").alias("text"))
    found = decide.with_missing_attributes(lines, "p_type", "text", docs.spec_rows(spec, [], "spec"))
    return found.select("l_orderkey", "l_linenumber", _pairs(F.col("missing_attrs")).alias("required"),
                        _pairs(F.col("missing_opt")).alias("optional"))


@query
def recipe_expand(s, d):
    df = _items(s, d).where("symbol <> ''").groupBy("name", "symbol", "kw", "volt").agg(F.count("*").alias("n"))
    df = df.withColumn("known", decide.known_codes(_cat(s, d)))
    kw = F.coalesce(F.nullif(F.col("kw"), F.lit("")), x.power_kw(F.col("name")))
    df = decide.with_recipe(df, "symbol", kw, F.col("volt"), F.col("name").contains("支給"), "known")
    df = decide.with_part_notes(df.withColumn("names", decide.known_names(_cat(s, d))), "symbol", kw, "names")
    return df.select("name", "symbol", F.col("kw").alias("given"), "volt", "n", F.posexplode("parts").alias("seq", "p")).select(
        "name", "symbol", "given", "volt", "n", "seq", "p.code", "p.qty", "p.step", "p.clamped",
        F.col("p.name").alias("part_name"), F.col("p.note").alias("part_note"))


@query
def group_promotion(s, d):
    rows = contexts_of(marked_rows(_items(s, d)))
    settled = decide.select_codes(rows.where("grp <> ''").select(*decide.CONTEXT).distinct(),
                                  written(_cat(s, d)))
    return settled.select("cname", "volt", "symbol", "kw", "grp", "panel_kind", "tb_control", "capacitor_panel",
                          "after_main", "rule", "code", "conf")


# --- candidates and scores -----------------------------------------------------------------

@query
def candidate_topk(s, d):
    df, _ = _text_candidates(s, d)
    return df.select("cname", "volt", "n_items", F.explode("cands").alias("c")).select(
        "cname", "volt", "n_items", "c.rn", "c.ord", "c.code", "c.score")


def _scored(s, d):
    df, cats = _text_candidates(s, d)
    rows = cats.select("ord", F.col("form").alias("row_form"), F.col("vals").alias("row_vals"), "interval")
    return df.select("cname", "volt", "form", "vals", "opts", F.explode("cands").alias("c")).select(
        "*", "c.rn", "c.ord").join(rows, "ord")


@query
def attr_score(s, d):
    return _scored(s, d).select("cname", "volt", "rn", scores.value_score(
        F.col("vals"), F.col("row_vals"), F.col("interval")).alias("score"))


@query
def option_bonus(s, d):
    return _scored(s, d).select("cname", "volt", "rn", scores.option_bonus(
        F.col("opts"), F.col("form"), F.col("row_form")).alias("bonus"))


@query
def residual_explain(s, d):
    df, cats = _text_candidates(s, d)
    top = df.select("cname", "volt", "vals", F.get("cands", 0)["ord"].alias("ord")).join(
        cats.select("ord", "code", "name", F.col("vals").alias("row_vals")), "ord")
    top = top.withColumn("r", cd.residual(F.col("vals"), F.col("name"), F.col("row_vals")))
    return top.select("cname", "volt", "code", F.size("r.matched").alias("n_matched"),
                      _pairs(F.array_sort("r.missing")).alias("missing"))


@query
def candidate_options(s, d):
    df, _ = _text_candidates(s, d)
    # as if the third candidate had been chosen
    chosen = F.coalesce(F.get("cands", 2), F.get("cands", 0))
    return df.select("cname", "volt", _pairs(F.transform(report.options(
        chosen["code"], chosen["name"], F.col("cands")), lambda o: o["label"])).alias("labels"))


@query
def first_match_in_ranked(s, d):
    df, _ = _text_candidates(s, d)
    hit = F.get(F.filter("cands", lambda c: c["name"].contains("標準") | c["name"].contains("静止型")), 0)
    return df.select("cname", "volt", hit["rn"].alias("rn"), hit["code"].alias("code"))


# --- decisions and reports -----------------------------------------------------------------

@query
def decision_list(s, d):
    return select_items(_items(s, d), _cat(s, d), wide=False).select(
        "doc_id", "panel_idx", "item_idx", "qty", "part", "rule", "code", "conf", "carried", "absorbed")


@query
def grade_summary(s, d):
    return report.summary(select_items(_items(s, d), _cat(s, d), wide=False))


@query
def input_counts(s, d):
    # distinct panels per document first, so no single task holds every panel
    panels = _items(s, d).groupBy("doc_id", "panel_idx").agg(F.count("*").alias("n"))
    per_doc = panels.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("p"))
    return per_doc.agg(F.sum("n").alias("n_items"), F.sum("p").alias("n_panels"), F.count("*").alias("n_docs"))


@query
def review_diff(s, d):
    df, _, settled = graded_rows(_items(s, d), _cat(s, d))
    # of the long columns only this one, once per decision; a carried row has no candidates
    df = df.join(settled.select("decision", F.get("candidates", 1)["code"].alias("_second")), "decision")
    second = F.coalesce(F.when(~F.col("carried"), F.col("_second")), F.lit(""))
    final = F.when(F.col("conf") == rules.CHECK, second).otherwise(F.col("code"))
    return df.groupBy("panel").agg(F.count("*").alias("n_rows"),
                                   F.count_if(report.changed(F.col("code"), final)).alias("n_changed"))


# --- context over the event stream of each user --------------------------------------------

def _events(s, d):
    """Events as document rows: user = document, day = panel, event_id = position."""
    return table(s, d, "events").select(
        F.col("user_id").alias("doc_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("panel_idx"),
        F.col("event_id").alias("item_idx"), "event_type", "value")


@query
def lag_flag(s, d):
    kept = _events(s, d).where("event_type <> 'view'")
    out = ordered.previous(kept, ctx.PANEL, ["item_idx"], F.col("event_type") == "error", "after_error")
    return out.select("item_idx", F.coalesce("after_error", F.lit(False)).alias("after_error"))


@query
def carry_forward(s, d):
    source = F.when(F.col("event_type") == "error", F.col("value"))
    out = ordered.last_before(_events(s, d), ["doc_id"], ["panel_idx", "item_idx"], source, "carried")
    return out.select("doc_id", "item_idx", "event_type", "carried")


@query
def attach_details(s, d):
    seen = F.when(F.col("event_type") != "view", F.col("item_idx"))
    df = ordered.last_before(_events(s, d), ctx.PANEL, ["item_idx"], seen, "parent_idx")
    details = df.where("event_type = 'view' and parent_idx is not null").select(
        *ctx.PANEL, "parent_idx", "item_idx", F.format_string("%.2f", "value").alias("load"))
    return ctx.loads_per_parent(details).select("item_idx", F.array_join("loads", ", ").alias("loads"), "n_loads")


@query
def group_suppress(s, d):
    """Clicks as stand-alone detectors, errors above 20 as the relay that contains them."""
    df = _events(s, d).select(
        *ctx.KEY, F.when(F.col("event_type") == "click", "zct").otherwise(F.col("event_type")).alias("form"),
        ((F.col("event_type") == "error") & (F.col("value") > 20)).alias("built_in"),
        *[F.lit(v).alias(c) for c, v in (("code", "x"), ("official", "x"), ("conf", rules.SURE), ("note", ""))])
    return ctx.absorb_detectors(df.withColumn("lone", ctx.form_facts(F.col("form"))["lone"])).select("item_idx", "absorbed", "conf")


@query
def row_numbering(s, d):
    kept = _events(s, d).where("event_type <> 'view'")
    return ordered.row_numbers(kept, ["doc_id"], ["panel_idx", "item_idx"], "gid").select("item_idx", "doc_id", "gid")
