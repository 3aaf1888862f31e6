"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class has a Gaussian over transformed counts of the text. Its covariance is shrunk towards the
pooled one and towards a multiple of the identity, and only its Cholesky factor is kept: a Mahalanobis
distance is one triangular solve, and the score is the logistic of the difference of log densities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactmill.llm import common, text_stats

THRESHOLD = 0.7
#: Labelled documents (bad, good) that the fit takes at most, the first by hash of their id.
TRAIN = (6_000, 6_000)
POOLED_SHARE = 0.1
IDENTITY_SHARE = 0.02


def features(text: str | None) -> np.ndarray:
    """Transformed statistics of a whole text; all finite, also for the empty one."""
    c = dict(zip(text_stats.FIELDS, text_stats.counts(text)))
    n, size = max(c["n_words"], 1), max(c["n_bytes"], 1)
    letters = max(c["n_upper"] + c["n_ascii_lower"], 1)
    root = lambda a, b: float(np.sqrt(a / b))
    mean = c["word_chars"] / n
    return np.array([
        np.log1p(c["n_words"]), np.log1p(mean), np.log1p(max(c["sum_sq_word_bytes"] / n - mean * mean, 0)),
        root(c["n_symbols"], n), root(c["n_dup_lines"], max(c["n_lines"], 1)), root(c["n_repeat_words"], n),
        np.log(max(c["n_distinct"], 1)) - np.log(n), root(c["n_same_as_last"], n), root(c["n_no_letter"], n),
        root(c["n_upper"], letters), root(c["n_exclaim"], n), root(c["n_stops"], n), root(c["n_digits"], size),
        np.log1p(n / max(c["n_lines"], 1)),
    ])


@dataclass(frozen=True)
class Discriminant:
    """Per class (bad, good): mean, Cholesky factor of the covariance, log prior minus half its log determinant."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The probability of good for rows of features."""
        z = (rows - self.centre) / self.scale
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            solved = np.linalg.solve(factor, (z - mean).T)
            logs.append(offset - 0.5 * (solved * solved).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def fit(rows: np.ndarray, labels: np.ndarray, prior_good: float) -> Discriminant | None:
    """Fit both classes; None where one of them has no row, as nothing can be told apart then."""
    if not len(rows) or labels.min() == labels.max():
        return None
    centre, scale = rows.mean(axis=0), rows.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (rows - centre) / scale
    groups = [z[labels == 0], z[labels == 1]]
    means = np.array([g.mean(axis=0) for g in groups])
    scatter = [(g - m).T @ (g - m) for g, m in zip(groups, means)]
    size = z.shape[1]
    pooled = sum(scatter) / len(z)
    factors, offsets = [], []
    for group, part, prior in zip(groups, scatter, (1 - prior_good, prior_good)):
        # The less rows a class has, the more it leans on what both have in common.
        own = len(group) / (len(group) + size + 1) * (1 - POOLED_SHARE)
        cov = own * part / len(group) + (1 - own) * pooled
        cov = (1 - IDENTITY_SHARE) * cov + IDENTITY_SHARE * max(np.trace(cov) / size, 1e-3) * np.eye(size)
        factor = np.linalg.cholesky(cov)
        factors.append(factor)
        offsets.append(np.log(max(prior, 1e-9)) - np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, means, np.array(factors), np.array(offsets))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features_column(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(labels: DataFrame, label: str, allowed: Column, per_class: tuple[int, int]) -> DataFrame:
    """At most ``per_class`` ids of labels 0 and 1, the first by hash of the id: (id, y).

    Rows with a null id, a null label or a label other than 0 and 1 are not used, nor ids with both
    labels. Repeated rows count once.
    """
    clean = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & allowed)
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.min(label).alias("y"), F.max(label).alias("top"))
        .where("y = top")
        .drop("top")
    )
    parts = [clean.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in enumerate(per_class)]
    return parts[0].union(parts[1])


def trained(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = TRAIN
) -> Discriminant | None:
    """Fit on a sample of bounded size; only its features reach the driver."""
    common.prepare(spark)
    allowed = ~held_out()
    sample = training_sample(labels, "quality", allowed, per_class)
    shares = labels.where(F.col("quality").isin(0, 1) & allowed).agg(F.avg("quality")).first()[0]
    # The sample is at most sum(per_class) rows of an id and a label.
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), F.col("doc_id") == F.col("id"))
        .select("id", "y", features_column(common.text_or_empty()).alias("x"))
        .dropDuplicates(["id"])
        .orderBy("id")
        .toPandas()
    )
    if not len(rows):
        return None
    return fit(np.array(rows["x"].tolist()), rows["y"].to_numpy(), float(shares))


def score_column(model: Discriminant | None, text: Column) -> Column:
    """The probability of good. Without a model every text gets 1, so nothing is rejected."""
    if model is None:
        return F.lit(1.0)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([features(t) for t in texts]))) if len(texts) else pd.Series([], dtype=float)

    return score(text)


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    A null text counts as the empty text, which gets a score like any other. Null ids are not held out.
    Without labels of both classes the score is 1. An empty table gives no rows. Other columns are
    ignored, and no column but the text takes part in the score.
    """
    model = trained(spark, docs, labels)
    return (
        docs.select("doc_id", held_out().alias("held_out"), score_column(model, common.text_or_empty()).alias("score"))
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    model = trained(spark, docs, labels)
    return docs.where(score_column(model, common.text_or_empty()) >= THRESHOLD)
