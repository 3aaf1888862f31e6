"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.session import configure, scratch
from contactmill.sources.buckets import Folder

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the session settings and let Python workers import this package.

    Where the package is not installed on the executors, their workers look for it in the folder the
    driver runs it from.
    """
    configure(spark)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join(p for p in [*paths, ROOT] if p)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def stored_texts(df: DataFrame) -> DataFrame:
    """As `session.stored`, for rows with whole texts: written with the denser compression."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links ``(a, b)`` of longs: rows ``(node, component)``.

    The component is the smallest node that can be reached. Large-star and small-star steps alternate
    until the links no longer change; each pair of steps is written to the shared checkpoint folder, so
    a lost executor costs a re-read. Nodes without a link to another node do not appear. Null ends,
    self-links and repeated links are ignored; no links give no rows.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    spark, path = edges.sparkSession, None
    seen, pairs = None, links.distinct()
    while True:
        before, path = path, scratch(spark)
        pairs.write.parquet(path)
        if before:  # superseded by the round just written
            Folder(spark, before).drop("")
        pairs = spark.read.schema("a long, b long").parquet(path)
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = mark
        pairs = _small_star(_large_star(pairs))


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    low = pairs.groupBy("a").agg(F.min("b").alias("m"))
    moved = pairs.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()
