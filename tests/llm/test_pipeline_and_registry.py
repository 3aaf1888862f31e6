import re

import corpus_pipeline
from contactmill.llm import queries
from contactmill.llm.common import components
from tests.llm import cases


def naive_shingles(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(fold))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def alike(x, y):
    if min(len(x), len(y)) < 0.8 * max(len(x), len(y)):
        return False
    both = len(x & y)
    return 10 * both >= 8 * (len(x) + len(y) - both)


def joined(order, links):
    """The smallest id of each one's component."""
    root = list(range(len(order)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    return [order[top(i)] for i in range(len(order))]


def test_each_operator_has_one_query():
    names = list(queries.registered())
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]


def test_stages_take_effect(spark):
    folder = cases.folder()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, folder)
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        if i < 4:
            assert out.columns == docs.columns
        known = {r.doc_id: r for r in before.collect()}
        if i == 0:
            lost = set(known) - set(ids)
            assert lost and not any(labels[d].quality for d in lost if d in labels)
            assert not any(labels[d].quality == 0 for d in ids if d in labels)
        elif i == 1:
            assert sorted(ids) == sorted(known)
            assert any(r.text != known[r.doc_id].text for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows)
        elif i == 2:
            # Brute force over all pairs: Jaccard similarity of 0.8 or more of the 5-word shingles, then components.
            order = sorted(known)
            sets = [naive_shingles(known[d].text) for d in order]
            links = [(i, j) for i in range(len(order)) for j in range(i) if alike(sets[i], sets[j])]
            assert any(sets[i] != sets[j] for i, j in links)
            assert sorted(ids) == sorted(set(joined(order, links)))
        elif i == 3:
            assert set(ids) == set(known) and len(ids) > len(known)
            assert max(ids.count(d) for d in set(ids)) == 2
        else:
            assert sorted(ids) == sorted(r.doc_id for r in before.collect())
            assert all(r.round_trip for r in rows)
        before = spark.createDataFrame(rows, out.schema)


def test_run_equals_its_stages(spark):
    folder = cases.folder("sf0.001")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert cases.ordered(corpus_pipeline.run(spark, folder).collect()) == cases.ordered(docs.collect())


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 5), (9, 8), (8, 7), (7, 6), (6, 10), (None, 1), (20, 21), (20, 21)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    want = {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 10: 6, 20: 20, 21: 20}
    assert {r.node: r.component for r in found.collect()} == want
    assert found.count() == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    chain = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in components(chain).collect()} == {0}
