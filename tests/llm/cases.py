"""Awkward documents that every operator of texts has to take."""

from __future__ import annotations

from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977} again" for i in range(40_000))
LINES = "\n".join(f"Line number {i} of a passage that many documents share." for i in range(12))
ROWS = [
    (1, "A plain text of a few words, with an end.", "en", "a", 41, 7),
    (2, None, None, None, None, None),
    (3, "", "en", "a", 0, 1),
    (4, " \t\n ", "en", "b", 4, 1),
    (5, LONG, "en", "a", len(LONG), 1),
    (6, "A plain text of a few words, with an end.", "en", "b", 41, 2),
    (6, "A plain text of a few words, with an end.", "en", "b", 41, 2),
    (None, "A text without an id.", "en", "a", 21, 3),
    (None, None, None, None, None, None),
    (7, f"First line.\n{LINES}\nLast line of seven.", "en", "a", 0, 4),
    (8, f"Another first line.\nAnd one more.\n{LINES}", "en", "c", 0, 5),
    (9, "日本語 🙂 Éà ▁x  y\x00 <|endoftext|> a<b>c", "ja", "c", 0, 6),
    (10, "word", "en", "a", 4, 6),
    (11, "A PLAIN text of a few words, with an end.", "en", "b", 41, 2),
]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.LongType()),
])
#: Names that operators use inside.
CLASHING = ("h", "r", "n", "e", "key", "id", "fp", "row", "tokens", "digest", "component", "kept", "copies", "epoch", "y")


def awkward(spark, rows=ROWS):
    """The documents with extra columns of clashing names."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.select("*", *[F.lit(f"extra {n}").alias(n) for n in CLASHING])


def empty(spark):
    return awkward(spark, [])


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def folder(name="sf0.01"):
    return f"/root/testdata/{name}"


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)
