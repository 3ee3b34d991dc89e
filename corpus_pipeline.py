"""A corpus pipeline over ``documents``: quality rules, language ID, line dedup, near-dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of ``docs``, whatever columns it has beside those of
``documents``.  Texts are worked on whole, however long.  An empty table gives an empty
result.  ``run`` writes each stage's result to the shared work
folder, reads it back for the next one and deletes what no stage reads any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import language_id, line_dedup, packing, quality, simhash
from shelfmark.llm.common import discard, stored, workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the calibrated model keep.

    A null or empty text fails the base rules and goes.  Rows are judged by their text alone:
    repeated rows stay or go together, and a row without doc_id, lang, source or n_chars is
    judged like any other.  Labels are matched by doc_id; without labels of both kinds the
    base rules decide alone.  A probability of exactly 0.5 keeps.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_good_quality(docs, model)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and a language that the model is sure of.

    A text that is null or has no letter goes; without any labelled row all go.  Rows without
    doc_id are judged, never learned from; repeated rows stay or go together; of languages
    alike in probability the first in sorted order counts.
    """
    return language_id.with_known_language(docs, language_id.fit(docs))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that many documents share.

    All rows stay: a null text stays null, a text whose lines all go becomes empty, and a row
    without doc_id keeps its lines.  Rows that share a doc_id are one document; n_chars
    follows the text where lines go.
    """
    return line_dedup.without_repeated_lines(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id.

    Texts without a word are copies of each other.  Of rows that share that doc_id one stays,
    by the smallest text hash, then by the row itself; rows without doc_id all stay.
    """
    return simhash.without_near_duplicates(docs)


def power_of_two_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document.

    A null or empty text is its closing id alone; a row without doc_id and repeated rows are
    packed like any other.
    """
    return packing.pack(docs).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", known_language),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("packing", power_of_two_packing),
]

#: The quality and language models cannot be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path, before = workspace(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{path}/{name}")
        if before:
            discard(spark, f"{path}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
