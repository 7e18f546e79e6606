"""A corpus pipeline: five operators in a row, each stage written as Parquet and read again as the next one's documents.

All stages but the last return the columns of documents. An empty table goes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanings.llm import exact_dedup, mixing, quality_rules, sentencepiece_codec, simhash
from gleanings.llm.common import staged
from gleanings.llm.registry import PIECES
from gleanings.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base conditions or the learned decision list reject go.

    Every row is judged by its own text, with a null, repeated or any other id; null texts count as empty, and go; the list is learned from
    the labelled documents of this stage's input.
    """
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space apart, the document with the smallest id stays; a null id is larger than any, and of equal rows one stays.

    Null and empty texts are equal.
    """
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts (five words a shingle, 0.8 and more) the document with the smallest id stays, null last; of equal rows one."""
    return simhash.dedup_similar(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them, null as a source of its own; rows with a null or repeated id each for
    themselves. Null and empty texts have no words, so they may stand in the mix any number of times up to two."""
    return mixing.mixed_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id (null where it is), ids, n_tokens and whether the ids decode to the text, one row for each row of the mixture."""
    return sentencepiece_codec.round_trip(docs, PIECES)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing", mixture), ("sentencepiece", encoding)]

#: The learned rules, the fingerprints and the codec have no SQL form; the tests hold each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs)
    return docs
