"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (hashed into buckets), a text is the mean of
its words, and a linear softmax on top gives the class. Vectors and softmax are trained jointly. A
misspelling that was never seen shares most of its n-grams, and so most of its vector, with the word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactmill.llm import common
from contactmill.llm.quality_classifier import training_sample

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
WIDTH = 2
#: Labelled documents (clean, toxic) that the fit takes at most, the first by hash of their id.
TRAIN = (4_500, 2_000)
#: Passes over the sample: so many, or what gives so many mini-batches.
EPOCHS = 12
STEPS = 1_000
BATCH = 100
#: Zero words that the average of every text also has, so that a few words alone are weak evidence.
PADDING = 15
RATE = 0.5
#: Averages of hundreds of small vectors are small: a fixed gain brings them to the softmax's range.
GAIN = 20.0
#: Pull of vectors towards zero, so that n-grams without evidence say little.
DECAY = 1e-5
#: Words that are hashed at a time.
PART = 8_192
# Marks that part words: ASCII ones besides letters, digits and bytes of other scripts.
EDGES = bytes(c for c in range(128) if not chr(c).isalnum())
_SPACES = bytes.maketrans(EDGES, b" " * len(EDGES))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(size: int, known: dict[str, np.ndarray] = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of the hash's factor and of its inverse modulo 2^64."""
    if len(known.get("up", ())) < size:
        for name, factor in (("up", _FACTOR), ("down", _INVERSE)):
            powers = np.full(size + (1 << 16), factor, dtype=np.uint64)
            powers[0] = 1
            known[name] = np.multiply.accumulate(powers)
    return known["up"][:size], known["down"][:size]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(29))) * _MIX >> np.uint64(48)).astype(np.int64)


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the marked words, and of the whole words, with the number of the word."""
    joined = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)
    size = len(joined)
    up, down = _powers(size)
    ends = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up, out=ends[1:])
    space = joined == 32
    spaces = np.cumsum(space)
    buckets, owners = [], []
    for n in GRAMS:
        if size >= n:
            at = np.flatnonzero(spaces[n - 2 : size - 1] == spaces[: size - n + 1])
            buckets.append(_bucket((ends[at + n] - ends[at]) * down[at]))
            owners.append(spaces[at] - 1)
    edge = np.flatnonzero(space)
    buckets.append(_bucket((ends[edge[1:] + 1] - ends[edge[:-1]]) * down[edge[:-1]]))
    owners.append(np.arange(len(words)))
    return np.concatenate(buckets), np.concatenate(owners)


def bag(text: str | None) -> np.ndarray:
    """The weight of each bucket in the average of a text: all zero for one without words.

    Each word is the mean of its n-grams, each text the mean of its words and the padding.
    """
    words = (text or "").lower().encode().translate(_SPACES).split()
    weights = np.zeros(BUCKETS)
    for i in range(0, len(words), PART):
        part = words[i : i + PART]
        buckets, owners = _grams(part)
        share = 1 / (np.bincount(owners, minlength=len(part)) * (len(words) + PADDING))
        weights += np.bincount(buckets, weights=share[owners], minlength=BUCKETS)
    return weights


@dataclass(frozen=True)
class Model:
    """What each bucket adds to the log odds of toxic when it is the whole text, and the bias."""

    gains: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        words = (text or "").lower().encode().translate(_SPACES).split()
        total = 0.0
        for i in range(0, len(words), PART):
            part = words[i : i + PART]
            buckets, owners = _grams(part)
            sums = np.bincount(owners, weights=self.gains[buckets], minlength=len(part))
            total += float((sums / np.bincount(owners, minlength=len(part))).sum())
        odds = self.bias + total / (len(words) + PADDING)
        return float(1 / (1 + np.exp(-np.clip(odds, -500, 500))))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, log_prior: float = 0.0) -> Model:
    """Train vectors and softmax jointly by AdaGrad on the cross entropy of mini-batches.

    ``log_prior`` is added to the bias: the log odds of the classes in the corpus less those in the sample.
    """
    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    heads = rng.normal(0, 0.5, (WIDTH, 2))
    bias = np.zeros(2)
    seen = [np.full_like(x, 1e-6) for x in (vectors, heads, bias)]
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(len(bags), 1)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            picked = order[i : i + BATCH]
            keys = np.concatenate([bags[k][0] for k in picked])
            weights = np.concatenate([bags[k][1] for k in picked])
            owner = np.repeat(np.arange(len(picked)), [len(bags[k][0]) for k in picked])
            hidden = np.stack(
                [np.bincount(owner, vectors[keys, j] * weights, len(picked)) for j in range(WIDTH)], axis=1
            ) * GAIN
            logits = hidden @ heads + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(picked)), labels[picked]] -= 1
            p /= len(picked)
            back = GAIN * (p @ heads.T)
            step = np.stack([np.bincount(keys, back[owner, j] * weights, BUCKETS) for j in range(WIDTH)], axis=1)
            step += DECAY * vectors
            for x, past, g in zip((vectors, heads, bias), seen, (step, hidden.T @ p, p.sum(axis=0))):
                past += g * g
                x -= rate * g / np.sqrt(past)
    odds = heads[:, 1] - heads[:, 0]
    return Model(GAIN * (vectors @ odds), float(bias[1] - bias[0] + log_prior))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


_BAG = T.StructType([
    T.StructField("keys", T.BinaryType()),
    T.StructField("parts", T.BinaryType()),
    T.StructField("total", T.DoubleType()),
])


@F.pandas_udf(_BAG)
def bag_column(texts: pd.Series) -> pd.DataFrame:
    """Bags in few bytes: used buckets, their weights in proportion to the largest, the sum of the weights."""
    rows = []
    for text in texts:
        weights = bag(text)
        used = np.flatnonzero(weights)
        parts = weights[used] / weights.max() if len(used) else weights[used]
        rows.append((used.astype(np.uint16).tobytes(), parts.astype(np.float16).tobytes(), weights.sum()))
    return pd.DataFrame(rows, columns=["keys", "parts", "total"])


def unpacked(keys: bytes, parts: bytes, total: float) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a packed bag."""
    weights = np.frombuffer(parts, dtype=np.float16).astype(np.float32)
    return np.frombuffer(keys, dtype=np.uint16), weights * (total / max(float(weights.sum()), 1e-9))


def trained(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = TRAIN
) -> Model | None:
    """Fit on a sample of bounded size; None without rows of both classes."""
    common.prepare(spark)
    allowed = ~held_out()
    sample = training_sample(labels, "toxic", allowed, per_class)
    share = labels.where(F.col("toxic").isin(0, 1) & allowed).agg(F.avg("toxic")).first()[0]
    # The sample is at most sum(per_class) rows of an id and a label.
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), F.col("doc_id") == F.col("id"))
        .select("id", "y", bag_column(common.text_or_empty()).alias("b"))
        .dropDuplicates(["id"])
        .orderBy("id")
        .select("id", "y", "b.*")
        .toPandas()
    )
    y = rows["y"].to_numpy(dtype=int)
    if not len(rows) or y.min() == y.max():
        return None
    bags = [unpacked(*row) for row in rows[["keys", "parts", "total"]].itertuples(index=False)]
    odds = lambda p: np.log(p) - np.log(1 - p)
    return fit(bags, y, float(odds(float(share)) - odds(y.mean())))


def score_column(model: Model | None, text: Column) -> Column:
    """The probability of toxic. Without a model every text gets 0, so nothing is marked."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return score(text)


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    A null text counts as the empty text, whose score is that of the bias. Null ids are not held out.
    Without labels of both classes the score is 0. Repeated rows get equal scores. An empty table gives
    no rows. Other columns are ignored, and no column but the text takes part in the score.
    """
    model = trained(spark, docs, labels)
    return (
        docs.select("doc_id", held_out().alias("held_out"), score_column(model, common.text_or_empty()).alias("score"))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )
