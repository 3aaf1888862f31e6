"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.llm import (
    bpe_backtrack, embedding_dedup, lexical_search, line_dedup, mixing, quality_classifier, quality_rules, sentencepiece_fst, sharding,
    simhash_dedup, token_counts, toxicity, whitening,
)
from contactmill.llm.common import table

#: Files of the public tokenizers that the queries use.
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"


def tokenizer_file(name: str) -> bytes:
    """The content of a tokenizer file, read on the driver and sent with the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(spark, table(spark, folder, "documents"), tokenizer_file(BYTE_BPE))


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark, table(spark, folder, "embeddings"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(spark, table(spark, folder, "documents"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(spark, table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    clean = line_dedup.without_repeated_chunks(spark, table(spark, folder, "documents"))
    return clean.select("doc_id", "text", F.col("__removed_lines").alias("removed_lines"))


def op6_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.near_duplicates(spark, table(spark, folder, "documents"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.scored(spark, table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(spark, table(spark, folder, "documents"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    drawn = mixing.mixed(spark, table(spark, folder, "documents"))
    return drawn.select("doc_id", "source", F.col("__epoch").alias("epoch"), F.col("__block").alias("block"))


def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_fst.encoded(spark, table(spark, folder, "documents"), tokenizer_file(PIECES))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.ranked(spark, table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_bpe_backtrack(spark: SparkSession, folder: str) -> DataFrame:
    codes = bpe_backtrack.encoded(spark, table(spark, folder, "documents"), tokenizer_file(WORD_BPE))
    return codes.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(spark, table(spark, folder, "embeddings"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    each = (
        op1_token_counts, op2_embedding_dedup, op3_quality_rules, op4_toxicity, op5_line_dedup, op6_simhash_dedup,
        op7_quality_classifier, op8_sharding, op9_mixing, op10_sentencepiece,
        op11_lexical_search, op12_bpe_backtrack, op13_whitening,
    )
    return {f.__name__: f for f in each} | {"pipeline": corpus_pipeline.run}
