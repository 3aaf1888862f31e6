"""Token counts with a cache of content digests.

Texts are looked up by the SHA-256 of their content in a table of earlier counts that belong to the
same tokenizer version (the digest of the tokenizer's file and of the library's version). Only distinct
contents without a count are encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactmill.llm import common
from contactmill.session import scratch, stored

LIMIT = 1024
#: Texts of these characters are encoded by rank, all others by the tokenizer's own library.
COMMON = re.compile("[^\\x00-\u024f]")
#: The split pattern of byte-level tokenizers of this family, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = T.StructType([
    T.StructField("digest", T.BinaryType()),
    T.StructField("n_tokens", T.LongType()),
])


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the
    others shifted beyond the first 256 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts tokens of texts as the tokenizers library does.

    Where a vocabulary's ids are its merge ranks, as in plain byte-level BPE, encoding by rank gives the
    same tokens at a multiple of the speed; it is used for texts of common characters without special
    strings. The library counts everything else.
    """

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(content)
        model = json.loads(content)
        self.specials = [t["content"] for t in model.get("added_tokens") or ()]
        self.by_rank = self._by_rank(model)

    @staticmethod
    def _by_rank(model: dict):
        """An encoder by rank, or None where the model is not plain byte-level BPE."""
        pre, bpe = model.get("pre_tokenizer") or {}, model.get("model") or {}
        plain = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not model.get("normalizer") and not model.get("post_processor") and not model.get("truncation")
            and not model.get("padding") and bpe.get("type") == "BPE" and not bpe.get("dropout")
            and not bpe.get("unk_token") and not bpe.get("ignore_merges")
        )
        if not plain:
            return None
        added = {t["content"] for t in model.get("added_tokens") or ()}
        vocab = {t: i for t, i in bpe["vocab"].items() if t not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
        ids = [vocab.get(a + b, -1) for a, b in merges]
        if ids != sorted(ids) or len(set(ids)) != len(ids) or len(vocab) != 256 + len(ids) or min(ids, default=256) < 256:
            return None
        import tiktoken

        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str) -> int:
        if self.by_rank and not COMMON.search(text) and not any(s in text for s in self.specials):
            return len(self.by_rank.encode_ordinary(text))
        return len(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0])


_COUNTERS: dict[bytes, Counter] = {}


def counter(content: bytes) -> Counter:
    """The counter of a tokenizer file, one per worker process."""
    key = hashlib.sha256(content).digest()
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(content)
    return _COUNTERS[key]


def tokenizer_version(content: bytes) -> str:
    """Digest of the tokenizer's file and the version of the library that reads it."""
    import tokenizers

    return hashlib.sha256(content + b"\0" + tokenizers.__version__.encode()).hexdigest()


def _encoder(content: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tool = counter(content)
        for batch in batches:
            yield pd.DataFrame({"digest": batch["digest"], "n_tokens": [tool.count(t) for t in batch["content"]]})

    return run


def cached_counts(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows, one per digest; none where it has not been written yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(
    spark: SparkSession, docs: DataFrame, tokenizer: bytes, cache: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is the content of a tokenizer file, ``cache`` the folder that keeps counts between
    runs (a new one in the shared checkpoint folder by default). A null text counts as the empty one,
    with no tokens. Repeated rows and copies are encoded once and counted each. Null ids stay null.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    common.prepare(spark)
    folder = f"{cache or scratch(spark)}/tokenizer={tokenizer_version(tokenizer)}"
    text = common.text_or_empty()
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    narrow = stored(docs.select("doc_id", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")))
    known = cached_counts(spark, folder)
    misses = (
        narrow.groupBy("digest")
        .agg(F.min("doc_id").alias("first"))
        .join(known, "digest", "left_anti")
    )
    contents = (
        docs.select(F.col("doc_id").alias("id"), text.alias("content"), digest.alias("content_digest"))
        .join(
            misses.hint("shuffle_hash"),
            F.col("id").eqNullSafe(F.col("first")) & (F.col("content_digest") == F.col("digest")),
        )
        .select("digest", "content")
    )
    fresh = contents.mapInPandas(_encoder(tokenizer), CACHE)
    fresh.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).write.mode("append").parquet(folder)
    counts = stored(cached_counts(spark, folder))
    return narrow.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
