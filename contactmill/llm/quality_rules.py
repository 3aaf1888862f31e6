"""Quality by weak supervision: rules vote or abstain, and their accuracies are learnt without labels.

Every rule says good (+1), bad (-1) or abstains (0). Votes are counted per pattern over the whole corpus;
expectation-maximisation on these counts estimates how accurate each rule is: how often it votes which way on
good documents, and on bad ones of each kind. Bad documents are a mixture of kinds, one for each rule to start
from, as a rule that finds one kind says nothing about the others. A document is kept when its posterior
probability of being good is high enough, instead of when it passes every rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactmill.llm import common, text_stats
from contactmill.session import stored

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
KEEP = 0.5
#: How often a rule may vote bad on good documents.
MAX_FALSE = 0.005
ROUNDS = 200


@dataclass(frozen=True)
class Rule:
    """Good below ``good``, bad above ``bad``, abstains between; null measures abstain."""

    name: str
    measure: str
    good: float
    bad: float


#: Measures are SQL over the counts of text_stats; a division by zero gives null.
RULES = (
    Rule("symbols", "try_divide(n_symbols, n_words)", 0.05, 0.2),
    Rule("repeated words", "try_divide(n_repeat_words, n_words)", 0.45, 0.6),
    Rule("word after itself", "try_divide(n_same_as_last, n_words)", 0.05, 0.2),
    Rule("duplicate lines", "try_divide(n_dup_lines, n_lines)", 0.45, 0.6),
    Rule("words without letters", "try_divide(n_no_letter, n_words)", 0.08, 0.2),
    Rule("capitals", "try_divide(n_upper, n_upper + n_ascii_lower)", 0.2, 0.5),
    Rule("exclamations", "try_divide(n_exclaim, n_words)", 0.05, 0.2),
    Rule("word length", "abs(try_divide(word_chars, n_words) - 5.5)", 3.0, 6.0),
    Rule("digits", "try_divide(n_digits, n_bytes)", 0.08, 0.25),
)

_COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in text_stats.FIELDS])


@F.pandas_udf(_COUNTS)
def counts_column(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats.counts(t) for t in texts], columns=text_stats.FIELDS)


def vote(rule: Rule) -> Column:
    """1, 0 or -1."""
    measure = F.expr(rule.measure)
    return F.when(measure <= rule.good, 1).when(measure >= rule.bad, -1).otherwise(0).cast("byte")


@dataclass(frozen=True)
class LabelModel:
    """Class 0 is good, the others are kinds of bad documents.

    ``log_votes`` has log P(vote | class) per rule, class and vote (-1, 0, 1), ``log_shares`` the log shares.
    """

    log_votes: np.ndarray
    log_shares: np.ndarray

    def accuracies(self) -> np.ndarray:
        """Per rule: the share of right votes among its votes, on good and on bad documents."""
        votes, shares = np.exp(self.log_votes), np.exp(self.log_shares)
        bad = (votes[:, 1:] * shares[None, 1:, None]).sum(axis=1) / max(shares[1:].sum(), 1e-300)
        good = votes[:, 0]
        return np.stack([good[:, 2] / (good[:, 0] + good[:, 2]), bad[:, 0] / (bad[:, 0] + bad[:, 2])], axis=1)


def fit(patterns: np.ndarray, times: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation on distinct vote patterns and how often each occurs.

    Starts with documents without a bad vote as good, and others as the kinds of the rules that vote bad. A
    good document is seldom voted bad, at most with MAX_FALSE per rule. Add-one counts keep every
    probability off zero. Without patterns good and bad are equally likely and no vote changes that.
    """
    n_rules = patterns.shape[1]
    picked = np.stack([(patterns == v) for v in (-1, 0, 1)], axis=2).astype(float)
    bad = (patterns < 0).astype(float)
    clean = bad.sum(axis=1) == 0
    belongs = np.concatenate([clean[None, :].astype(float), (bad / np.maximum(bad.sum(axis=1, keepdims=True), 1)).T])
    shares = votes = None
    for _ in range(rounds):
        weight = belongs * times[None, :]
        total = weight.sum(axis=1)
        votes = (np.einsum("cp,prv->rcv", weight, picked) + 1) / (total[None, :, None] + 3)
        false = np.minimum(votes[:, 0, 0], MAX_FALSE) if len(times) else votes[:, 0, 0]
        votes[:, 0, 1:] *= ((1 - false) / (1 - votes[:, 0, 0]))[:, None]
        votes[:, 0, 0] = false
        shares = (total + np.array([n_rules, *[1] * n_rules])) / (total.sum() + 2 * n_rules)
        logs = np.log(shares)[:, None] + np.einsum("prv,rcv->cp", picked, np.log(votes))
        now = np.exp(logs - logs.max(axis=0, keepdims=True)) if len(times) else logs
        now /= now.sum(axis=0, keepdims=True)
        if len(times) and np.abs(now - belongs).max() < 1e-9:
            break
        belongs = now
    return LabelModel(np.log(votes), np.log(shares))


def posterior(model: LabelModel, votes: list[Column]) -> Column:
    """The probability of good as an expression over vote columns."""

    def odds(kind: int) -> Column:
        """Log odds of a kind of bad documents against good."""
        total = F.lit(float(model.log_shares[kind] - model.log_shares[0]))
        for column, rule in zip(votes, model.log_votes):
            bad, none, good = (float(x) for x in rule[kind] - rule[0])
            total = total + F.when(column > 0, good).when(column < 0, bad).otherwise(none)
        return total

    against = F.lit(0.0)
    for kind in range(1, len(model.log_shares)):
        against = against + F.exp(odds(kind))
    return F.lit(1.0) / (F.lit(1.0) + against)


def judged(
    spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: float = KEEP
) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, quality (posterior) and kept.

    Counts are of whole texts; a null or empty text has none, fails the base rules and is not kept. The
    patterns are at most 3 to the number of rules, whatever the size of the corpus, and only they and their
    counts reach the driver. Repeated rows count and are judged each. An empty table gives no rows.
    Other columns are ignored.
    """
    common.prepare(spark)
    measured = docs.select("doc_id", counts_column(common.text_or_empty()).alias("c")).select("doc_id", "c.*")
    names = [f"vote_{i}" for i in range(len(rules))]
    voted = stored(measured.select("doc_id", *BASE, *[vote(r).alias(n) for r, n in zip(rules, names)]))
    table = voted.where("n_words > 0").groupBy(*names).agg(F.count("*").alias("times")).orderBy(*names).toPandas()
    model = fit(table[names].to_numpy(dtype=int).reshape(-1, len(rules)), table["times"].to_numpy(dtype=float))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return voted.select(
        "doc_id", *BASE, failed.alias("base_failed"), posterior(model, [F.col(n) for n in names]).alias("quality")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep))
