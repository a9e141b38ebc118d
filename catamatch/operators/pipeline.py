"""From flat items and a catalogue to graded rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catamatch import rules
from catamatch.functions import extract as x
from catamatch.functions import text as t
from catamatch.operators import context as ctx
from catamatch.operators.ordered import large_groups
from catamatch.operators.stage import compilable, with_facts, written
from catamatch.operators.decide import CONTEXT, select_codes

ITEM_FIELDS = ["name", "qty", "volt", "symbol", "kw", "grp", "load_detail", "unclear", "cable"]


def marked_rows(items: DataFrame) -> DataFrame:
    """The items with state and parent (see ``context``), written once without the forms of their texts."""
    return written(ctx.with_parent(ctx.mark_rows(items).drop("form", "panel_form"), sizes=items).drop("main"))


def contexts_of(marked: DataFrame) -> DataFrame:
    """Kept rows with the columns a decision depends on and ``form_facts``."""
    kept = marked.where("state = 'kept'")
    df = with_facts(kept, "name", kept, lambda names: names.withColumn("_q", x.split_quantity(F.col("name"))).select(
        "name", t.squeeze(t.nfkc(F.col("name"))).alias("_form"), F.col("_q.qty").alias("_qty"),
        F.when(F.col("_q.qty").isNotNull(), F.col("_q.text")).otherwise(F.col("name")).alias("cname")).withColumns(
        ctx.form_facts(F.col("_form"))).drop("_form"))
    df = with_facts(df, "panel", kept, lambda panels: panels.withColumn("_form", t.squeeze(t.nfkc(F.col("panel")))).select(
        "panel", x.panel_kind(F.col("_form")).alias("panel_kind"),
        t.contains_any(F.col("_form"), rules.TB_CONTROL_WORDS).alias("tb_control"),
        (F.col("panel").contains("高圧") & F.col("panel").contains("コンデンサ")).alias("capacitor_panel")))
    return df.withColumns({
        **{c: F.coalesce(c, F.lit("")) for c in ("volt", "symbol", "kw", "grp")},
        "qty": F.coalesce("_qty", "qty", F.lit("")),
    }).drop("_qty")


def select_items(items: DataFrame, catalogue: DataFrame, wide: bool = True, spec: DataFrame | None = None,
                 ruling=rules.DECISION_RULES) -> DataFrame:
    """Graded rows of all kept items (see ``graded_rows``); ``wide`` adds loads, display, candidates,
    parts and missing attributes at the end."""
    df, marked, settled = graded_rows(items, catalogue, spec, ruling)
    return with_details(df, marked, settled) if wide else df.drop("decision")


def graded_and_details(items: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graded rows and load details, from one pass over the items."""
    df, marked, _ = graded_rows(items, catalogue)
    return df.drop("decision"), ctx.detail_rows(marked)


def graded_rows(items: DataFrame, catalogue: DataFrame, spec: DataFrame | None = None,
                ruling=rules.DECISION_RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graded rows with their decision, the marked items and the settled decisions.

    items: doc_id, panel_idx, panel, item_idx and ITEM_FIELDS; catalogue: ord, code, name,
    volt, kind, spec with unique codes; spec: class, pos, attr, required, pattern in place of the built-in
    attribute spec; ruling: decision rules in place of the built-in ones.  Equal contexts are settled once and joined back.
    Rows travel through the context rules with their short columns only, and once: they lie together by document
    unless a document is too large for a window partition.
    """
    compilable(items.sparkSession)
    marked = marked_rows(items)
    rows = contexts_of(marked)
    cats = written(catalogue)
    # written: a condition on its code would inline all rules
    settled = written(select_codes(rows.select(*CONTEXT).distinct(), cats, spec, ruling))
    settled = written(ctx.with_code_facts(settled, cats).withColumn(
        "decision", F.monotonically_increasing_id()))
    short = settled.select(*CONTEXT, "decision", "part", "rule", "code", "official", "conf", "note",
                           "is_meter", "built_in")
    df = rows.join(short, CONTEXT).select(
        *ctx.KEY, "panel", "name", "qty", "unclear", "decision", "part", "rule", "code", "official", "conf", "note",
        "is_meter", "built_in", "no_meter", "meter_text", "lone")
    large = large_groups(marked, ["doc_id"])
    df = ctx.carry_meter(df, large)
    # the flag of a panel in a large document is joined back, which reads the rows twice
    df = df if large is None else written(df)
    unclear = F.coalesce("unclear", F.lit(False)) & (F.col("conf") != rules.CHECK)
    df = df.withColumns({
        "note": F.when(unclear, F.concat(F.lit("drawing hard to read: "), "note")).otherwise(F.col("note")),
        "conf": F.when(unclear, rules.CHECK).otherwise(F.col("conf"))})
    return ctx.absorb_detectors(df, small=large is None).drop("unclear"), marked, settled


def with_details(df: DataFrame, marked: DataFrame, settled: DataFrame) -> DataFrame:
    """Adds the long columns: loads and display of a row, candidates and parts of its decision."""
    loads = ctx.loads_per_parent(ctx.detail_rows(marked))
    df = df.join(loads, ctx.KEY, "left")
    long = settled.select("decision", "candidates", "parts", "missing_attrs", "missing_opt")
    df = df.join(long, "decision")
    feed = x.feed_number(F.col("name"))
    kept = ~F.col("carried")
    return df.withColumns({
        "feed": F.coalesce(feed, F.lit("")), "loads": F.coalesce("loads", t.empty_strings()),
        "n_loads": F.coalesce("n_loads", F.lit(0))}).withColumns({
            "display": x.display_text(F.col("name"), feed, F.col("loads")),
            "candidates": F.when(kept, F.col("candidates")), "parts": F.when(kept, F.col("parts"))}).drop("decision")


def attached_details(items: DataFrame) -> DataFrame:
    """Every load detail with its parent row (see ``context.detail_rows``)."""
    return ctx.detail_rows(ctx.with_parent(ctx.mark_rows(items)))
