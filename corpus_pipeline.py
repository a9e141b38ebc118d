"""From documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but
the last return the columns of documents.  ``run`` writes every stage's rows and reads them again.

Defined results: a null text, or one without a letter, goes in the first stage; a text that loses all its
lines goes on as the empty text, is never a near copy, and has no words for the mix, where it ends.  Rows
without a doc_id are judged by their text, and near copies that have no doc_id among them all stay.  Rows that
repeat a doc_id with other texts are documents of their own in every stage; rows equal in doc_id, text and
source become one in the mix.  A null source is a source.  Extra columns pass through up to the packing, whose
rows are pieces.  An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catamatch.llm import language, line_dedup, mixing, near_dedup, packing
from catamatch.llm.common import table
from catamatch.operators.stage import written

VOCABULARY = "word_bpe_49k.json"


def known_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no certain language, go."""
    return language.accepted(docs)


def without_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in one; n_chars follows the text."""
    cut = line_dedup.without_lines(docs, line_dedup.repeated_lines(docs))
    length = F.length("text").cast("long")
    return cut.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def without_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.kept_documents(docs, near_dedup.near_dedup(docs))


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, a row for each pass."""
    return mixing.mixed_documents(docs)


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences and places."""
    pieces = packing.token_pieces(docs, public_tokenizers.path(VOCABULARY))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("language ID", known_language), ("line dedup", without_repeated_lines),
          ("MinHash near-dedup", without_near_copies), ("mixing sources", mixed), ("best-fit packing", packed)]

#: Classifier, similarity components and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
