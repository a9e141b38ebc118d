"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, langs=None, sources=None, ids=None):
    rows = []
    for i, t in enumerate(texts):
        rows.append((i if ids is None else ids[i], t, langs[i] if langs else "en",
                     sources[i] if sources else f"s{i % 3}", None if t is None else len(t)))
    return spark.createDataFrame(rows, SCHEMA)


def clashing(docs):
    """The same documents with columns that carry names the operators use inside."""
    from pyspark.sql import functions as F

    names = ("digest", "n", "chars", "inverse", "shard", "h1", "h2", "size", "rank", "length", "piece", "lost",
             "keep_id", "group_size", "kept", "start", "offset", "word", "host", "n_shingles", "component_id",
             "n_words", "n_removed", "held_out", "score", "taken", "target", "block", "fingerprint", "part")
    for c in names:
        docs = docs.withColumn(c, F.lit("x"))
    return docs


def rows(df, *cols):
    return sorted(((tuple(r[c] for c in cols)) for r in df.select(*cols).collect()), key=repr)
