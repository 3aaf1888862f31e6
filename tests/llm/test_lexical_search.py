import math
import random
import re

import numpy as np
import pytest

from contactmill.llm import lexical_search as search
from contactmill.llm import queries
from tests.llm import cases

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def naive_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def naive(docs, items, top=10):
    """Every document's score for every item, by the formula."""
    read = [(d, naive_terms(t)) for d, t in docs]
    n, total = sum(1 for _, t in read if t), sum(len(t) for _, t in read)
    out, df = [], search.Counter(t for _, w in read for t in set(w))
    for item_id, text in items:
        scored, wanted = [], naive_terms(text)
        for doc_id, words in read:
            if words:
                m = 100 - 75 + 75 * len(words) * n // total
                score = 0
                for t in wanted:
                    tf = words.count(t)
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
                if score > 0:
                    scored.append((-score, doc_id if doc_id is not None else math.inf))
        best = sorted(scored)[:top]
        out += [(item_id, i + 1, d if d != math.inf else None, -s) for i, (s, d) in enumerate(best)]
    return out


def corpus(rng, n, vocabulary, longest=30):
    words = [f"w{i}" for i in range(vocabulary)]
    return " ".join(rng.choices(words, [1 / (i + 1) for i in range(vocabulary)], k=rng.randint(0, longest)))


@pytest.mark.parametrize("seed", range(6))
def test_search_over_trees_equals_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = rng.choice([3, 12, 60])
    docs = [(i, corpus(rng, i, vocabulary)) for i in range(150)]
    docs += [(i + 150, rng.choice(docs)[1]) for i in range(60)]
    items = [(i, corpus(rng, i, vocabulary, 8)) for i in range(25)]
    block = search.Block([(i, search.Counter(search.terms(t))) for i, t in items if search.terms(t)])
    read = {d: search.Counter(search.terms(t)) for d, t in docs}
    n, total = sum(1 for c in read.values() if c), sum(sum(c.values()) for c in read.values())
    df = [sum(t in c for c in read.values()) for t in block.index]
    weights = np.array([search.weight(n, x) for x in df], dtype=np.int64)
    order = np.empty(len(df), dtype=np.int64)
    order[sorted(range(len(df)), key=lambda i: (-df[i], i))] = np.arange(len(df))
    tool = search.Searcher(block, weights, order, 10)
    rows = list(read.items())
    rng.shuffle(rows)
    step = rng.choice([1, 7, 300])
    for i in range(0, len(rows), step):
        ids, vectors, ms = [], [], []
        for d, c in rows[i : i + step]:
            at = [block.index[t] for t in c if t in block.index]
            if at:
                ids.append(d)
                vectors.append((np.array(at), np.array([c[t] for t in c if t in block.index])))
                ms.append(search.length_factor(sum(c.values()), n, total))
        if ids:
            tool.search(ids, vectors, ms)
    found = [
        (block.items[i][0], rank + 1, -d, s)
        for i, best in enumerate(tool.best)
        for rank, (s, d) in enumerate(sorted(best, reverse=True))
    ]
    assert sorted(found) == sorted(naive(docs, items))


def leaves(node):
    return len(node.docs) + sum(map(leaves, node.children))


def test_tree_shares_paths_and_bounds_subtrees():
    rows = [([0, 1, 2], [1, 5, 1], 30), ([0, 1, 3], [4, 1, 1], 20), ([0, 1], [1, 1], 90), ([2], [7], 25), ([0, 1, 2], [1, 1, 2], 50)]
    vectors = [(np.array(a), np.array(a), np.array(tf)) for a, tf, _ in rows]
    root = search.fp_tree(vectors, [m for *_, m in rows])
    assert leaves(root) == 5 and root.m == 20 and len(root.children) == 2
    assert dict(zip(*map(list, root.entries))) == {0: 4, 1: 5, 2: 7, 3: 1}
    shared = next(c for c in root.children if c.depth == 2)
    assert shared.docs == [2] and sorted(c.depth for c in shared.children) == [3, 3] and shared.m == 20
    assert sorted(len(c.docs) for c in shared.children) == [1, 2]


def test_bounds_drop_subtrees(monkeypatch):
    """A block of poor documents is not scored one by one once ten better ones are known."""
    rng = np.random.default_rng(1)
    good = [(np.array([0, 1, 2]), np.array([5, 5, 5]))] * 10
    poor = [(np.array([0, *sorted(rng.choice(np.arange(3, 40), 6, replace=False))]), np.ones(7, dtype=np.int64)) for _ in range(500)]
    names = [b"t%d" % i for i in range(40)]
    block = search.Block([(1, search.Counter(names[:3]))])
    tool = search.Searcher(block, np.full(40, 100), np.arange(40), 10)
    done = []
    monkeypatch.setattr(tool, "scores", lambda e, m, items, f=tool.scores: done.append(items) or f(e, m, items))
    tool.search(list(range(510)), good + poor, [50] * 510)
    assert sum(0 in items for items in done) < 60
    assert sorted(-d for _, d in tool.best[0]) == list(range(10))


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in cases.ROWS]
    items = [(1, "plain TEXT of words"), (2, None), (3, ""), (None, "日本語 line"), (4, "word again"), (4, "again id an"), (1, "plain TEXT of words"), (5, "nowhere")]
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as score", "3 as rank")
    got = search.ranked(spark, cases.awkward(spark), frame).collect()
    assert cases.ordered(got) == cases.ordered(naive(rows, list(dict.fromkeys(items))))
    assert search.ranked(spark, cases.empty(spark), frame).collect() == []
    assert search.ranked(spark, cases.awkward(spark), frame.limit(0)).collect() == []


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ITEMS", 15)
    folder = cases.folder("sf0.001")
    got = queries.op11_lexical_search(spark, folder).collect()
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet").select(c, "text").collect() for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert len(list(search.blocks(spark.read.parquet(f"{folder}/benchmark.parquet")))) == 3
    assert cases.ordered(got) == cases.ordered(naive([tuple(d) for d in docs], [tuple(i) for i in items]))
