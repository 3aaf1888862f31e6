"""A corpus pipeline of five training-data operators.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. ``run``
applies them to the documents table, writing each result as Parquet to the shared checkpoint folder and
reading it back, so a lost executor costs no more than its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contactmill.llm import line_dedup, mixing, quality_classifier, sentencepiece_fst, simhash_dedup
from contactmill.llm.common import stored_texts, table
from contactmill.llm.queries import PIECES, tokenizer_file


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_classifier.accepted(spark, docs, table(spark, sf_dir, "labels"))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier; n_chars follows the text."""
    return line_dedup.without_repeated_chunks(spark, docs).select(*docs.columns)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: similarity of 0.8 or more of their 5-word shingles."""
    return simhash_dedup.without_similar(spark, docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of small sources up to twice."""
    return mixing.mixed(spark, docs).select(*docs.columns)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    return sentencepiece_fst.encoded(spark, docs, tokenizer_file(PIECES))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", unrepeated_lines),
    ("SimHash near-dedup", unlike_documents),
    ("mixing sources to target weights", mixed_sources),
    ("SentencePiece encoding and decoding", encoded_documents),
]

#: SQL cannot express the fit of the classifier, the XXH64 fingerprints and the transducer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored_texts(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
