"""Reading extracted documents: lenient JSON, nested records, failures, paths, content reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from catamatch.functions import text as t
from catamatch.operators.ordered import range_numbers
from catamatch.operators.stage import written

ITEM = ("name STRING, qty STRING, volt STRING, symbol STRING, kw STRING, `group` STRING, "
        "load_detail STRING, parent STRING, unclear STRING, cable STRING")
DOCUMENT = f"panels ARRAY<STRUCT<panel: STRING, items: ARRAY<STRUCT<{ITEM.replace(' STRING', ': STRING')}>>>>"
SPEC = "MAP<STRING, STRUCT<required: ARRAY<STRING>, optional: ARRAY<STRING>, patterns: MAP<STRING, STRING>>>"

CATALOGUE_FIELDS = ("code", "name", "volt", "kind", "spec")
CATALOGUE = ", ".join(f"{c} STRING" for c in CATALOGUE_FIELDS)

# --- fixed values: accepted inputs and the name of a failed one ---------------------------
EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".dxf", ".zip")
FAILED = "[抽出失敗] "
# JSON values that count as no
FALSY = ("", "false", "null", "0", "0.0", "[]", "{}")


def salvage(text: Column) -> Column:
    """JSON text inside a model answer: fences are cut, else the outermost braces are tried."""
    bare = t.trim_all(F.regexp_replace(text, r"(?m)^```(json)?|```$", ""))
    braces = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    def valid(s):
        return F.try_parse_json(s).isNotNull() & (s != "")
    return F.when(valid(bare), bare).when(valid(braces), braces)


def truthy(flag: Column) -> Column:
    """A JSON flag of any type, read as text, as yes or no; missing is no."""
    return F.coalesce(~flag.isin(*FALSY), F.lit(False))


def readable(json: Column) -> Column:
    """An object whose panels, if there are any, are an array."""
    panels = F.get_json_object(json, "$.panels")
    return F.coalesce(json.startswith("{") & (panels.isNull() | panels.startswith("[")), F.lit(False))


def flatten(df: DataFrame, ids: list[str], json: str) -> DataFrame:
    """One row per item of panels[].items[] with its position; missing texts become ''."""
    return item_rows(df.select(*ids, F.from_json(F.col(json), DOCUMENT).alias("_doc")), ids, F.col("_doc"))


def item_rows(df: DataFrame, ids: list[str], doc: Column) -> DataFrame:
    """``flatten`` for documents that are parsed already."""
    panels = df.select(*ids, F.posexplode(doc["panels"]).alias("panel_idx", "_p"))
    items = panels.select(*ids, "panel_idx", F.coalesce("_p.panel", F.lit("")).alias("panel"),
                          F.posexplode("_p.items").alias("item_idx", "_i"))
    texts = [("name", "name"), ("qty", "qty"), ("volt", "volt"), ("symbol", "symbol"), ("kw", "kw"), ("group", "grp")]
    return items.select(
        *ids, "panel_idx", "panel", "item_idx",
        *[F.coalesce(F.col("_i")[a], F.lit("")).alias(b) for a, b in texts],
        *[truthy(F.col("_i")[a]).alias(a) for a in ("load_detail", "unclear", "cable")])


def read_documents(df: DataFrame, ids: list[str], text: str, source: Column,
                   counts: Observation | None = None) -> DataFrame:
    """Item rows of readable documents and one marked row per unreadable or wrongly shaped one.

    A text is validated and parsed once.  ``counts`` gathers in the same pass n_docs (readable ones), n_failed,
    n_panels (those without items too) and n_items.
    """
    parsed = df.select(*ids, source.alias("_source"), salvage(F.col(text)).alias("_json"))
    parsed = parsed.withColumn("_ok", readable(F.col("_json")))
    parsed = parsed.select(*ids, "_source", "_ok", F.when(F.col("_ok"), F.from_json("_json", DOCUMENT)).alias("_doc"))
    if counts is not None:
        panels = F.when(F.col("_ok"), F.greatest(F.size("_doc.panels"), F.lit(0)))
        items = F.aggregate(F.coalesce("_doc.panels", F.from_json(F.lit("[]"), DOCUMENT[7:])), F.lit(0),
                            lambda n, p: n + F.greatest(F.size(p["items"]), F.lit(0)))
        parsed = parsed.observe(counts, F.count_if("_ok").alias("n_docs"), F.count_if(~F.col("_ok")).alias("n_failed"),
                                F.coalesce(F.sum(panels), F.lit(0)).alias("n_panels"),
                                F.coalesce(F.sum(F.when(F.col("_ok"), items)), F.lit(0)).alias("n_items"))
    parsed = written(parsed)
    good = item_rows(parsed.where("_ok"), ids, F.col("_doc"))
    bad = parsed.where("not _ok").select(
        *ids, F.lit(0).alias("panel_idx"), F.concat(F.lit(FAILED), "_source").alias("panel"),
        F.lit(0).alias("item_idx"), F.lit("unreadable").alias("name"), F.lit(True).alias("unclear"))
    return good.unionByName(bad, allowMissingColumns=True)


def spec_rows(df: DataFrame, ids: list[str], json: str) -> DataFrame:
    """Long form of a map-shaped attribute spec: class, pos (place within the class), attr, required, pattern."""
    classes = df.select(*ids, F.explode(F.from_json(F.col(json), SPEC)).alias("class", "_s"))
    def side(name, required):
        return F.transform(F.coalesce(F.col("_s")[name], t.empty_strings()), lambda a: F.struct(
            a.alias("attr"), F.lit(required).alias("required"), F.col("_s.patterns")[a].alias("pattern")))
    return classes.select(*ids, "class", F.posexplode(F.concat(
        side("required", True), side("optional", False))).alias("pos", "_a")).select(*ids, "class", "pos", "_a.*")


def catalogue_rows(df: DataFrame, ids: list[str], json: str) -> DataFrame:
    """Rows of catalogue arrays with ord, their place in the array, and failed.

    An element that is no object with a code is kept as a failed row with its compact text as name; so is a text
    that is no array, with a null ord.  Missing texts become ''.
    """
    read = df.select(*ids, F.trim(json).alias("_json")).withColumn("_rows", F.when(
        F.col("_json").startswith("[") & F.try_parse_json("_json").isNotNull(), F.from_json("_json", "array<string>")))
    each = read.where("_rows is not null").select(*ids, F.posexplode("_rows").alias("ord", "_text"))
    broken = read.where("_rows is null").select(*ids, F.lit(None).cast("int").alias("ord"), F.col("_json").alias("_text"))
    rows = each.unionByName(broken).withColumn("_row", F.from_json("_text", CATALOGUE))
    failed = F.col("ord").isNull() | F.coalesce(~F.startswith("_text", F.lit("{")), F.lit(True)) | (
        F.coalesce("_row.code", F.lit("")) == "")
    return rows.withColumn("failed", failed).select(
        *ids, "ord", "failed", *[F.when(~F.col("failed"), F.coalesce(f"_row.{c}", F.lit(""))).otherwise(
            F.coalesce("_text", F.lit("")) if c == "name" else "").alias(c) for c in CATALOGUE_FIELDS])


def accepted(path: Column, extensions=EXTENSIONS) -> Column:
    """Inputs by extension, without archive metadata and hidden files."""
    low = F.lower(path)
    known = F.exists(t.strings(list(extensions)), lambda e: low.endswith(e))
    return known & ~path.startswith("__MACOSX") & ~path.contains("/.") & ~path.endswith("/")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def provenance(path: Column, panel: Column) -> Column:
    return F.concat(base_name(path), F.lit(" / "), F.coalesce(panel, F.lit("")))


def process_once(df: DataFrame, content: str, process) -> DataFrame:
    """Runs ``process`` on one row per distinct content and joins the outcome back.

    process: DataFrame(hash, content) -> DataFrame(hash, ...).  NULL contents are one content.
    """
    keyed = df.withColumn("hash", F.sha2(F.col(content), 256))
    distinct = keyed.select("hash", content).dropDuplicates(["hash"])
    done = process(distinct).withColumnRenamed("hash", "_hash")
    return keyed.drop(content).join(done, F.col("hash").eqNullSafe(F.col("_hash")), "left").drop("_hash")


def ordered_lines(df: DataFrame, doc: str, x: str, y: str, text: str) -> DataFrame:
    """(doc, line_no, line): placed pieces from top to bottom, left to right, a row each.

    A document of any number of pieces is ordered and numbered by many tasks.
    """
    lines = df.select(doc, (-F.col(y)).alias("_a"), F.col(x).alias("_b"), F.col(text).alias("_c"),
                      F.concat(F.lit("("), F.col(x).cast("string"), F.lit(","), F.col(y).cast("string"),
                               F.lit(") "), F.col(text)).alias("line"))
    return range_numbers(lines, [doc], ["_a", "_b", "_c"], "line_no").select(doc, "line_no", "line")


def assemble(df: DataFrame, doc: str, x: str, y: str, text: str, limit: int | None = None) -> DataFrame:
    """Text of a document from its ordered lines, whole unless the caller's reader has a ``limit``."""
    out = ordered_lines(df, doc, x, y, text).groupBy(doc).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    whole = F.array_join("_l.line", "\n")
    return out.select(doc, (whole if limit is None else F.substring(whole, 1, limit)).alias("text"))
