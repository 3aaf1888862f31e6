import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactmill.llm import quality_classifier as qc
from contactmill.llm import quality_rules as qr
from contactmill.llm import text_stats
from tests.llm import cases


def naive_base(text):
    words = [w for w in (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] >= 2 for k in range(3)}
    lines, dup = (text or "").split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(line.strip(" \t\n\r\x0b\x0c")) and line in lines[:i]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered))


@pytest.mark.parametrize("text", [None, "", " \n", "a", "a a a a", "a b c a b c", "x\nx\n\n\nx", "a|b <c> é日\x1c#", "a b c d\na b c d"])
def test_base_counts(text):
    assert tuple(text_stats.counts(text)[:5]) == naive_base(text)


def test_many_different_words_count_alike():
    ids = np.array([0, 1, 2, 0, 1, 2, 3, 4, 5])
    assert text_stats.repeated_words(ids, 6) == text_stats.repeated_words(ids, 3_000_000) == 6


def test_rules_on_awkward_documents(spark):
    rows = qr.judged(spark, cases.awkward(spark)).collect()
    have = cases.ordered((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert have == cases.ordered((i, *naive_base(t)) for i, t, *_ in cases.ROWS)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)
    assert qr.judged(spark, cases.empty(spark)).collect() == []


def test_rules_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{cases.folder('sf0.1')}/documents.parquet")
    labels = spark.read.parquet(f"{cases.folder('sf0.1')}/labels.parquet")
    judged = qr.judged(spark, docs).withColumnRenamed("quality", "posterior")
    rows = judged.join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99
    assert np.mean(bad) < 0.05


def test_expectation_maximisation_finds_the_accuracies():
    """Two kinds of bad documents, each found by two of four rules."""
    rng = np.random.default_rng(1)
    n = 20_000
    kind = rng.choice(3, n, p=(0.85, 0.1, 0.05))
    hits = np.array([[0.002, 0.004, 0.003, 0.001], [0.9, 0.8, 0.004, 0.002], [0.003, 0.002, 0.95, 0.7]])
    votes = np.where(rng.random((n, 4)) < 0.05, 0, np.where(rng.random((n, 4)) < hits[kind], -1, 1))
    patterns, where, times = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = qr.fit(patterns, times.astype(float))
    assert np.abs(model.accuracies()[:, 0] - (1 - hits[0])).max() < 0.005
    assert abs(np.exp(model.log_shares[0]) - 0.85) < 0.02
    picked = np.stack([(patterns == v) for v in (-1, 0, 1)], axis=2)
    logs = model.log_shares[:, None] + np.einsum("prv,rcv->cp", picked, model.log_votes)
    good = 1 / np.exp(logs - logs[0]).sum(axis=0)
    assert np.mean((good[where.ravel()] >= 0.5) == (kind == 0)) > 0.98


def test_no_patterns_say_nothing(spark):
    model = qr.fit(np.zeros((0, 2), dtype=int), np.zeros(0))
    assert np.isclose(np.exp(model.log_shares[0]), 0.5)
    row = spark.range(1).select(qr.posterior(model, [F.lit(1), F.lit(-1)])).first()
    assert np.isclose(row[0], 0.5)


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{cases.folder('sf0.1')}/documents.parquet")
    labels = spark.read.parquet(f"{cases.folder('sf0.1')}/labels.parquet")
    scored = qc.scored(spark, docs, labels)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98


def test_held_out_labels_are_not_learnt(spark):
    docs = spark.read.parquet(f"{cases.folder()}/documents.parquet")
    labels = spark.read.parquet(f"{cases.folder()}/labels.parquet")
    turned = labels.withColumn("quality", F.when(qc.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = qc.trained(spark, docs, labels), qc.trained(spark, docs, turned)
    assert np.array_equal(first.factors, second.factors) and np.array_equal(first.means, second.means)


def test_classifier_on_awkward_documents(spark):
    docs = cases.awkward(spark)
    good = " ".join(f"word{i} of text{i * 7}," for i in range(60))
    training = [(100 + i, f"{good} number{i}" if i % 2 else "JUNK!! " * (30 + i), "en", "a", 0, 0) for i in range(40)]
    labels = cases.labels(spark, [(100 + i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (5, None, None), (101, 1, 0), (7, 3, 0)])
    both = docs.unionByName(cases.awkward(spark, training))
    rows = qc.scored(spark, both, labels).collect()
    assert len(rows) == len(cases.ROWS) + 40
    assert all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id and r.doc_id >= 100)
    assert all(r.score == 1.0 for r in qc.scored(spark, docs, cases.labels(spark)).collect())
    assert qc.scored(spark, cases.empty(spark), labels).collect() == []
    kept = qc.accepted(spark, both, labels)
    assert kept.columns == both.columns and 20 <= kept.count() < both.count()


def test_cholesky_scores_equal_plain_gaussians():
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (300, 3))])
    labels = np.repeat([0, 1], [200, 300])
    model = qc.fit(rows, labels, 0.6)
    z = (rows[:5] - model.centre) / model.scale
    logs = []
    for c, prior in ((0, 0.4), (1, 0.6)):
        cov = model.factors[c] @ model.factors[c].T
        d = z - model.means[c]
        logs.append(np.log(prior) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.scores(rows[:5]), 1 / (1 + np.exp(logs[0] - logs[1])))
