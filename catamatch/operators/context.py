"""Row context inside panels and documents: exclusion, previous row, carry-forward, details."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catamatch import rules
from catamatch.functions import extract as x
from catamatch.functions import text as t
from catamatch.operators.lookup import existing, unique_by_key
from catamatch.operators.ordered import CHUNK_ROWS, last_before, last_before_beside
from catamatch.operators.stage import with_facts, written

PANEL = ["doc_id", "panel_idx"]
KEY = [*PANEL, "item_idx"]


def main_breaker(form: Column) -> Column:
    """Does the text name a main breaker?"""
    return form.rlike("m(mcb|lug)") & ~F.substring(form, 1, 3).contains("tb")


def load_name(raw: Column) -> Column:
    """First word of a load detail."""
    return F.regexp_extract(t.trim_all(raw), r"(?U)^(\S+)", 1)


def mark_rows(items: DataFrame) -> DataFrame:
    """Adds form, panel_form, main (a main breaker) and state: 'detail', 'excluded' or 'kept'; each distinct text is read once."""
    df = items.withColumns({c: F.coalesce(c, F.lit("")) for c in ("name", "panel")})
    texts = written(df.select("name", "panel").distinct())
    df = with_facts(df, "name", texts, lambda names: names.withColumn("_fold", t.nfkc(F.col("name"))).select(
        "name", t.squeeze(F.col("_fold")).alias("form")).withColumns({
            "_out": x.excluded(F.col("name"), F.col("form"), F.lit(False)), "main": main_breaker(F.col("form"))}))
    df = with_facts(df, "panel", texts, lambda panels: panels.withColumn("_fold", t.nfkc(F.col("panel"))).select(
        "panel", t.squeeze(F.col("_fold")).alias("panel_form")))
    out = F.coalesce("cable", F.lit(False)) | F.col("_out")
    return df.select(*items.columns, "form", "panel_form", "main", F.when(F.coalesce("load_detail", F.lit(False)), "detail")
                     .when(out, "excluded").otherwise("kept").alias("state"))


def with_parent(df: DataFrame, chunk_rows: int = CHUNK_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """One ordered scan per panel over kept and detail rows.

    Adds ``parent_idx`` (position of the kept row before) and ``after_main`` (is that row a
    main breaker).  sizes: see ``last_before``.
    """
    seen = F.when(F.col("state") == "kept", F.struct(
        F.col("item_idx").alias("idx"), "main"))
    out = last_before(df.where("state <> 'excluded'"), PANEL, ["item_idx"], seen, "_p", chunk_rows, sizes)
    return out.withColumn("parent_idx", F.col("_p.idx")).withColumn(
        "after_main", F.coalesce("_p.main", F.lit(False))).drop("_p")


def detail_rows(marked: DataFrame) -> DataFrame:
    """(doc_id, panel_idx, parent_idx, item_idx, load): details with the row they belong to.

    Details before the first kept row of a panel belong to none and are left out.
    """
    return (marked.where("state = 'detail' and parent_idx is not null")
            .select(*PANEL, "parent_idx", "item_idx", load_name(F.col("name")).alias("load")))


def loads_per_parent(details: DataFrame) -> DataFrame:
    """(doc_id, panel_idx, item_idx, loads, n_loads): all loads of a row in order.

    The cell is what the display of the row shows; ``detail_rows`` has the same as rows.
    """
    listed = details.groupBy(*PANEL, F.col("parent_idx").alias("item_idx")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("item_idx").alias("i"), "load"))).alias("_l"))
    return listed.select(*KEY, F.col("_l.load").alias("loads"), F.size("_l").cast("long").alias("n_loads"))


def with_code_facts(settled: DataFrame, cats: DataFrame) -> DataFrame:
    """Adds what the context rules need to know about a code, once per distinct decision:
    official (its name in the last catalogue row of the code), is_meter (a multi-meter) and built_in (a relay with its detector)."""
    named = existing(cats, settled.select("code").distinct(), "code")
    facts = unique_by_key(named.select("code", "ord", F.col("name").alias("official"), "spec"), "code", "ord").drop("ord")
    df = settled.join(facts, "code", "left")
    name, spec = F.coalesce("official", F.lit("")), F.coalesce("spec", F.lit(""))
    built_in = t.contains_any(F.concat(name, spec), rules.ABSORBING_WORDS) | name.contains(rules.ABSORBING_NAME)
    meter = F.col("code").startswith(rules.METER_SOURCE_PREFIX) & name.contains(rules.METER_SOURCE_NAME)
    return df.withColumns({"is_meter": meter, "built_in": (F.col("code") != "") & built_in}).drop("spec")


def form_facts(form: Column) -> dict[str, Column]:
    """What the context rules read from a text: no_meter (a device that never takes a meter's type), meter_text,
    lone (a stand-alone detector)."""
    lone = form.rlike(rules.STANDALONE_DETECTOR) & ~form.rlike(rules.STANDALONE_GUARD)
    return {"no_meter": form.rlike(rules.METER_GUARD), "meter_text": form.rlike(rules.METER_TEXT), "lone": lone}


def carry_meter(df: DataFrame, large: DataFrame | None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Meters that follow a multi-meter in the document take its code and become doubtful.

    df has no_meter and meter_text of ``form_facts``; large: the ``large_groups`` of its documents.
    """
    facts = ["code", "official", "built_in"]
    df = last_before_beside(df, ["doc_id"], ["panel_idx", "item_idx"],
                            F.when(F.col("is_meter"), F.struct(*facts)), "_m", large, chunk_rows)
    taken = (~F.col("is_meter") & F.col("_m").isNotNull() & ~F.col("no_meter")
             & (F.col("code").isin(rules.METER_CODES) | F.col("meter_text")))
    df = df.withColumn("carried", taken)
    gone = F.col("carried")
    return df.withColumns({
        "conf": F.when(gone | F.col("is_meter"), rules.CHECK).otherwise(F.col("conf")),
        "note": F.when(gone, "same type as the multi-meter above, check the type")
        .when(F.col("is_meter"), "multi-meter, check the type").otherwise(F.col("note")),
        **{c: F.when(gone, F.col(f"_m.{c}")).otherwise(F.col(c)) for c in facts}}).drop("_m", "is_meter", "no_meter", "meter_text")


def absorb_detectors(df: DataFrame, small: bool = False) -> DataFrame:
    """Stand-alone detectors (``lone``, see ``form_facts``) are not counted where their panel has a relay that contains one.

    The panel flag is a combined aggregate that is joined back.  small: every panel is known to fit into a window
    partition; then rows that already lie together by document stay where they are.
    """
    if small:
        named = reduce(and_, [F.col(c).isNotNull() for c in PANEL])
        df = df.withColumn("_abs", F.max(F.col("built_in") & named).over(W.partitionBy(*PANEL)))
    else:
        panels = df.where("built_in").select(*PANEL).distinct().withColumn("_abs", F.lit(True))
        df = df.join(panels, PANEL, "left")
    df = df.withColumn("absorbed", F.coalesce(F.col("_abs") & F.col("lone"), F.lit(False)))
    gone = F.col("absorbed")
    return df.withColumns({
        "code": F.when(gone, "").otherwise(F.col("code")), "official": F.when(gone, None).otherwise(F.col("official")),
        "conf": F.when(gone, rules.UNCOUNTED).otherwise(F.col("conf")),
        "note": F.when(gone, "contained in the relay of the panel").otherwise(F.col("note"))}).drop("_abs", "built_in", "lone")
