import zlib

import numpy as np
from pyspark.sql import functions as F

from contactmill.llm import toxicity as tox
from tests.llm import cases


def test_bag_is_the_mean_of_word_means():
    words = ["ab", "cde", "ab"]
    want = np.zeros(tox.BUCKETS)
    each = {}
    for word in set(words):
        buckets, owners = tox._grams([word.encode()])
        marked = f" {word} "
        n_grams = 1 + sum(max(len(marked) - n + 1, 0) for n in tox.GRAMS)
        assert len(buckets) == n_grams and not owners.any()
        each[word] = buckets
    for word in words:
        np.add.at(want, each[word], 1 / (len(each[word]) * (len(words) + tox.PADDING)))
    assert np.allclose(tox.bag("Ab, cde! AB"), want)
    assert not tox.bag(None).any() and not tox.bag(" .,").any()


def test_parts_of_long_texts_add_up(monkeypatch):
    text = " ".join(f"word{i}" for i in range(50))
    whole = tox.bag(text)
    model = tox.Model(np.arange(tox.BUCKETS) / tox.BUCKETS, 0.1)
    score = model.score(text)
    monkeypatch.setattr(tox, "PART", 7)
    assert np.allclose(tox.bag(text), whole) and np.isclose(model.score(text), score)
    assert np.isclose(np.log(score / (1 - score)), model.gains @ whole + 0.1)


def test_packed_bags_keep_their_weights():
    row = tox.bag_column.func(__import__("pandas").Series(["some words in a text", None])).iloc[0]
    keys, weights = tox.unpacked(*row)
    back = np.zeros(tox.BUCKETS)
    back[keys] = weights
    assert np.allclose(back, tox.bag("some words in a text"), rtol=2e-3)


def test_unseen_misspellings_share_vectors():
    rng = np.random.default_rng(5)
    plain = [f"w{i}ord" for i in range(300)]
    texts, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, 40))
        if i % 2:
            words[3:5] = ["horrible", "nastiness"]
        texts.append(" ".join(words))
        labels.append(i % 2)
    rows = []
    for t in texts:
        b = tox.bag(t)
        used = np.flatnonzero(b)
        rows.append((used, b[used]))
    model = tox.fit(rows, np.array(labels))
    clean = " ".join(plain[:40])
    assert model.score(clean) < 0.5 < model.score(clean + " horribble nastinesss")


def test_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{cases.folder('sf0.1')}/documents.parquet")
    labels = spark.read.parquet(f"{cases.folder('sf0.1')}/labels.parquet")
    scored = tox.scored(spark, docs, labels)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    toxic = np.array([r.score for r in rows if r.toxic])
    clean = np.array([r.score for r in rows if not r.toxic])
    assert np.mean(toxic[:, None] > clean[None, :]) > 0.95
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.93


def test_held_out_labels_are_not_learnt(spark):
    docs = spark.read.parquet(f"{cases.folder()}/documents.parquet")
    labels = spark.read.parquet(f"{cases.folder()}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(tox.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(tox.trained(spark, docs, labels).gains, tox.trained(spark, docs, turned).gains)


def test_awkward_documents(spark):
    docs = cases.awkward(spark)
    training = [(100 + i, "nasty horrible words" if i % 2 else f"plain text number {i}", "en", "a", 0, 0) for i in range(40)]
    labels = cases.labels(spark, [(100 + i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (5, None, None), (7, 1, 3)])
    rows = tox.scored(spark, docs.unionByName(cases.awkward(spark, training)), labels).collect()
    assert len(rows) == len(cases.ROWS) + 40
    assert all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert all(r.score == 0 for r in tox.scored(spark, docs, cases.labels(spark)).collect())
    assert tox.scored(spark, cases.empty(spark), labels).collect() == []
