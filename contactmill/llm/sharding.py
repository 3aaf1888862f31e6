"""Shards of bounded size by extendible hashing, in DataFrame functions only.

A document's hash picks its shard by its first bits. The directory starts with one bucket; only a
bucket over the byte limit is split on one more bit, so small ones keep few bits. Sums per hash prefix
decide this in one pass for all depths that the size of the table makes likely, and further passes
look at buckets that are still too large alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.llm import common
from contactmill.session import stored

BITS = 60
#: Bits that a pass looks ahead of the expected depth.
AHEAD = 4
SHARD_BYTES = 1_000_000


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_bytes): 60 bits of the MD5 of id and text, and the bytes of the text."""
    text = common.text_or_empty()
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), text)
    return docs.select(
        "doc_id",
        F.conv(F.left(F.md5(key), F.lit(BITS // 4)), 16, 10).cast("long").alias("h"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def _prefix(column: str, depth: int) -> str:
    return f"shiftright({column}, {BITS - depth})"


def _directory(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Slots of ``high`` bits: (slot, depth), where depth is null if the bucket needs more bits than that.

    A bucket is final at the least depth from ``low`` on where it fits the limit or holds one hash only.
    """
    cells = rows.groupBy(F.expr(_prefix("h", high)).alias("slot")).agg(
        F.sum("n_bytes").alias("n_bytes"), F.min("h").alias("least"), F.max("h").alias("most")
    )
    buckets = stored(
        cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        .groupBy("depth", F.expr(f"shiftright(slot, {high} - depth)").alias("prefix"))
        .agg(F.sum("n_bytes").alias("n_bytes"), F.min("least").alias("least"), F.max("most").alias("most"))
        .select("depth", "prefix", F.expr(f"n_bytes <= {limit} or least = most").alias("fits"))
    )
    parents = buckets.where("not fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    below = buckets.withColumn("parent", F.expr("shiftright(prefix, 1)")).join(parents, ["depth", "parent"])
    final = buckets.where(f"fits and depth = {low}").select("depth", "prefix").union(
        below.where("fits").select("depth", "prefix")
    )
    slots = final.select(
        F.explode(
            F.expr(f"sequence(shiftleft(prefix, {high} - depth), shiftleft(prefix + 1, {high} - depth) - 1)")
        ).alias("slot"),
        "depth",
    )
    too_large = buckets.where(f"not fits and depth = {high}")
    return slots.union(too_large.select(F.col("prefix").alias("slot"), F.lit(None).cast("int").alias("depth")))


def shards(spark: SparkSession, docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, depth and shard (the first ``depth`` bits as text).

    The shards' bytes stay within the limit. Only rows with one and the same hash, which are equal in
    doc_id and text, cannot be told apart by more bits: they share a shard of their own even over the limit,
    as a single document over the limit does. Null texts have no bytes; null ids are hashed as empty.
    A table within the limit is one shard with the empty prefix, and an empty table gives no rows. Other
    columns are ignored.
    """
    common.prepare(spark)
    rows = stored(hashed(docs))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(total / limit, 1)))) + AHEAD)
    parts = []
    while True:
        slots = stored(_directory(rows, low, high, limit))
        placed = rows.withColumn("slot", F.expr(_prefix("h", high))).join(slots, "slot")
        parts.append(placed.where("depth is not null").select("doc_id", "n_bytes", "depth", "h"))
        if high == BITS or slots.where("depth is null").isEmpty():
            break
        rows = stored(placed.where("depth is null").select("doc_id", "h", "n_bytes"))
        low, high = high + 1, min(BITS, high + AHEAD)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    bits = F.lpad(F.bin("h"), BITS, "0")
    return out.select("doc_id", "n_bytes", "depth", bits.substr(F.lit(1), F.col("depth")).alias("shard"))


def write_shards(spark: SparkSession, docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Write the documents to one folder per shard, all columns kept.

    Rows are dealt by shard, so each shard is written by one task and its size is the limit at most. Ids
    must be unique; a shard's folder is named by its bits with a leading x.
    """
    placed = shards(spark, docs, limit).select(F.col("doc_id").alias("__id"), F.concat(F.lit("x"), "shard").alias("__shard"))
    (
        docs.join(placed.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")))
        .drop("__id")
        .repartition("__shard")
        .write.partitionBy("__shard")
        .parquet(path)
    )
