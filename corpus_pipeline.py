"""A corpus pipeline of five stages: drop poor documents, keep one of each group of near copies,
remove repeated passages and pack what is left into sequences.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``.
Each is written as Parquet to the shared folder and read again, so that a lost executor never
sends the work back further than one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowsentry.llm import quality_fm, quality_rules
from rowsentry.llm.jaccard_join import keep_first
from rowsentry.llm.packing import pack_documents
from rowsentry.llm.store import materialize, table
from rowsentry.llm.substring_dedup import remove_repeats


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, fitted on the labelled rows among ``docs``.

    A null or empty text fails the base rules and goes. Repeated rows and rows of equal ids are
    judged each by its own text; texts are read whole; an empty table stays empty.
    """
    return quality_rules.keep_documents(docs, table(spark, sf_dir, "labels"))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more.

    It is fitted on the whole table: the rules leave hardly a poor document among the labelled ones.
    Null and empty texts are scored as texts without words, repeated rows each by its own text; an
    empty table stays empty.
    """
    return quality_fm.keep_documents(docs, table(spark, sf_dir, "labels"), fit_on=table(spark, sf_dir, "documents"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id.

    A row without an id can't be named, so it stays; texts without words stand for themselves. Of
    rows that share id and text one stays, and unlike texts under one id are documents of their own.
    An empty table stays empty.
    """
    return keep_first(docs)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; those left without a word go.

    Null, empty and short texts stay as they are, repeated rows get the same text. Of equal ids with
    unlike texts the smaller hash of the text comes first, null ids come last.
    """
    return remove_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece with its place in a sequence of at most 2048 tokens.

    A null or empty text is one piece, its end alone; repeated rows are packed each; an empty table
    gives no rows.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("substring dedup", passages_stage),
    ("best-fit packing", packing_stage),
]
#: SQL can express neither the trained stages nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
