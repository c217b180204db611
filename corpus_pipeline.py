"""The corpus pipeline: language ID, quality rules, near-dedup, packing, each over all that the one before kept.

The first three stages return rows of ``docs`` as they are, with all their columns,
whatever their names; a doc_id may be of any type that has an order. An empty table goes
through all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import language_id, packing, repetition_rules, simhash_dedup
from plumbline.llm.common import documents, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in a language that the labels teach. A null, empty or blank text goes; repeated rows stay or go together."""
    return language_id.known_languages(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text doesn't repeat itself. A null or empty text would stay; repeated rows stay or go together."""
    return repetition_rules.unrepetitive(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the least doc_id, and of its rows the one of least text.

    Rows of a null doc_id are a document for each text. A null or blank text is near to none.
    """
    return simhash_dedup.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a text in a window; a null or empty text has none, equal lengths are taken by doc_id."""
    return packing.pack(docs)


STAGES = [
    ("language ID", known_language),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("packing", pack),
]

#: The stages fit models and build suffix arrays, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table, each stage's rows written and read again before the next."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
