"""Ranked lexical search by branch and bound over document FP-trees.

Items are taken in blocks of bounded size. For a block each document is reduced to the terms that its items
name, with their frequencies (a restricted vector), and written to the shared checkpoint folder with the
document's length. Counts of all documents and terms come from these rows.

A task then reads its share of the vectors in groups of bounded size. It writes each vector in the order of
falling document frequency and builds the group's FP-tree: vectors with a common beginning share a path, and
a path without branches is one node. A node keeps, for its whole subtree, the largest frequency of each term
and the smallest m. Both can only raise a score, so the score of that made-up document bounds those of
all documents below. The search goes depth first, the most promising child first, for all items together, but each
item leaves a subtree for itself as soon as its own bound there is below its tenth best score so far; a subtree
that every item has left is dropped. What is left of a path is scored document by document. Tasks return their best documents per item; these
are merged in two steps, first by parts of an item's rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactmill.llm import common
from contactmill.session import stored

TOP = 10
#: Items and term occurrences of a block. One item of more occurrences is a block of its own.
BLOCK_ITEMS = 512
BLOCK_TERMS = 100_000
#: Documents and vector entries of one tree.
TREE_DOCS = 8192
TREE_ENTRIES = 1 << 20
PARTS = 64

#: ASCII characters that are neither letters nor digits separate terms; capitals become small letters.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
FOUND = "idx int, item_id long, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return (text or "").encode().translate(FOLD).split()


def length_factor(n: int, documents: int, total: int) -> int:
    """m of a document of n terms, among so many documents with so many terms altogether."""
    return 100 - 75 + (75 * n * documents) // total


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Block:
    """Items and the terms that they name, numbered in the order of first use."""

    items: list[tuple[int | None, Counter]]

    def __post_init__(self):
        self.index = {t: i for i, t in enumerate(dict.fromkeys(t for _, c in self.items for t in c))}


def blocks(items: DataFrame) -> Iterator[Block]:
    """Blocks of the different items that have a term."""
    rows, size = [], 0
    each = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].alias("text")).distinct()
    for item_id, text in each.sort("item_id", "text").toLocalIterator():
        found = Counter(terms(text))
        if not found:
            continue
        if rows and (len(rows) == BLOCK_ITEMS or size + len(found) > BLOCK_TERMS):
            yield Block(rows)
            rows, size = [], 0
        rows.append((item_id, found))
        size += len(found)
    if rows:
        yield Block(rows)


def _restrict(index: dict[bytes, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, ids, tfs = [], [], []
            for text in batch["text"]:
                words = terms(text)
                found = {index[t]: tf for t, tf in Counter(words).items() if t in index}
                n.append(len(words))
                ids.append(list(found))
                tfs.append(list(found.values()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": n, "terms": ids, "tfs": tfs})

    return run


class Searcher:
    """The best documents of each item of a block, over trees that are given one after the other."""

    def __init__(self, block: Block, weights: np.ndarray, order: np.ndarray, top: int):
        self.weights, self.order, self.top = weights, order, top
        flat = [(block.index[t], k) for _, c in block.items for t, k in c.items()]
        sizes = [len(c) for _, c in block.items]
        self.term = np.array([t for t, _ in flat], dtype=np.int64)
        self.times = np.array([k for _, k in flat], dtype=np.int64)
        self.starts = np.cumsum([0, *sizes[:-1]])
        self.spans = [np.arange(a, a + n) for a, n in zip(self.starts, sizes)]
        self.gain = np.zeros(len(weights), dtype=np.int64)
        self.floor = np.ones(len(sizes), dtype=np.int64)  # what a document must score at least
        self.best: list[list[tuple[int, float]]] = [[] for _ in sizes]

    def scores(self, entries: tuple[np.ndarray, np.ndarray], m: int, items: np.ndarray) -> np.ndarray:
        """Scores of these items for a vector of terms and frequencies and a length factor."""
        at, tf = entries
        self.gain[at] = self.weights[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        if 4 * len(items) > len(self.spans):
            out = np.add.reduceat(self.gain[self.term] * self.times, self.starts)[items]
        else:
            here = [self.spans[i] for i in items]
            flat = np.concatenate(here)
            starts = np.cumsum([0, *map(len, here[:-1])])
            out = np.add.reduceat(self.gain[self.term[flat]] * self.times[flat], starts)
        self.gain[at] = 0
        return out

    def keep(self, item: int, score: int, doc_id: float) -> None:
        """Take a document among an item's best; of equal scores the smaller id is better."""
        best = self.best[item]
        if len(best) < self.top:
            heapq.heappush(best, (score, -doc_id))
        else:
            heapq.heappushpop(best, (score, -doc_id))
        if len(best) == self.top:
            self.floor[item] = max(best[0][0], 1)

    def search(self, ids: list, vectors: list[tuple[np.ndarray, np.ndarray]], ms: list[int]) -> None:
        """Search a group of documents."""
        root = fp_tree([(self.order[at], at, tf) for at, tf in vectors], ms)
        everything = np.arange(len(self.spans))
        todo = [(root, everything, self.scores(root.entries, root.m, everything))]
        while todo:
            node, items, bounds = todo.pop()
            left = bounds >= self.floor[items]
            if not left.any():
                continue
            items, bounds = items[left], bounds[left]
            for doc in node.docs:
                found = self.scores(vectors[doc], ms[doc], items)
                good = np.flatnonzero(found >= self.floor[items])
                for item, score in zip(items[good].tolist(), found[good].tolist()):
                    self.keep(item, score, ids[doc])
            below = [(child, items, self.scores(child.entries, child.m, items)) for child in node.children]
            # The child comes first, thus is put last, that promises most to the items on the whole.
            todo += sorted(below, key=lambda x: float((x[2] / bounds).sum()))


class Node:
    """A node of the tree: its documents, its children, and the entries and m that bound its subtree."""

    __slots__ = ("docs", "children", "entries", "m", "depth")

    def __init__(self, depth: int):
        self.depth, self.docs, self.children = depth, [], []

    def close(self, vectors, ms, width: int) -> None:
        """Work out the bounds from the documents and the closed children."""
        all_ = [vectors[d][1:] for d in self.docs] + [c.entries for c in self.children]
        self.m = min([ms[d] for d in self.docs] + [c.m for c in self.children])
        if len(all_) == 1:
            self.entries = all_[0]
            return
        at, tf = (np.concatenate(x) for x in zip(*all_))
        most = np.zeros(width, dtype=np.int64)
        np.maximum.at(most, at, tf)
        at = np.flatnonzero(most)
        self.entries = at, most[at]


def fp_tree(vectors: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ms: list[int]) -> Node:
    """The tree of vectors ``(places in the order of frequency, terms, frequencies)``.

    Sorted vectors with a common beginning are neighbours, so the paths are found with one stack of open nodes.
    """
    width = 1 + max(int(at.max()) for _, at, _ in vectors)
    keys = [np.sort(places).astype(">u4").tobytes() for places, _, _ in vectors]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    open_, before = [Node(0)], b""
    for doc in order:
        key = keys[doc]
        shared = _common(before, key)
        last = None
        while open_[-1].depth > shared:
            last = open_.pop()
            last.close(vectors, ms, width)
            if open_[-1].depth >= shared:
                open_[-1].children.append(last)
                last = None
        if last is not None:  # the paths part within the way to the node just closed
            fork = Node(shared)
            fork.children.append(last)
            open_.append(fork)
        if open_[-1].depth < len(key) // 4:
            open_.append(Node(len(key) // 4))
        open_[-1].docs.append(doc)
        before = key
    while len(open_) > 1:
        last = open_.pop()
        last.close(vectors, ms, width)
        open_[-1].children.append(last)
    open_[0].close(vectors, ms, width)
    return open_[0]


def _common(a: bytes, b: bytes) -> int:
    """How many leading places two keys share."""
    n = min(len(a), len(b)) // 4
    differ = np.flatnonzero(np.frombuffer(a, ">u4", n) != np.frombuffer(b, ">u4", n))
    return int(differ[0]) if len(differ) else n


def _search(block: Block, documents: int, total: int, df: dict[int, int], top: int):
    weights = np.array([weight(documents, df.get(i, 0)) for i in range(len(block.index))], dtype=np.int64)
    order = np.empty(len(weights), dtype=np.int64)
    order[sorted(range(len(weights)), key=lambda i: (-df.get(i, 0), i))] = np.arange(len(weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Searcher(block, weights, order, top)
        ids, vectors, ms, size = [], [], [], 0
        for batch in batches:
            for doc_id, n, at, tf in zip(batch["doc_id"], batch["n"], batch["terms"], batch["tfs"]):
                # Documents without an id come after all others.
                ids.append(math.inf if pd.isna(doc_id) else int(doc_id))
                vectors.append((np.asarray(at, dtype=np.int64), np.asarray(tf, dtype=np.int64)))
                ms.append(length_factor(int(n), documents, total))
                size += len(at)
                if len(ids) == TREE_DOCS or size >= TREE_ENTRIES:
                    search.search(ids, vectors, ms)
                    ids, vectors, ms, size = [], [], [], 0
        if ids:
            search.search(ids, vectors, ms)
        rows = [
            (i, block.items[i][0], None if doc == -math.inf else int(-doc), score)
            for i, best in enumerate(search.best)
            for score, doc in best
        ]
        frame = pd.DataFrame(rows, columns=["idx", "item_id", "doc_id", "score"])
        yield frame.astype({"idx": "int32", "item_id": "Int64", "doc_id": "Int64", "score": "int64"})

    return run


def ranked(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The best documents of each item: item_id, rank, doc_id, score.

    Whole texts count; a null or empty text has no terms, and documents or items without one are never ranked.
    Equal scores are ranked by doc_id, a null one last. Repeated document rows are documents of their own;
    repeated item rows are ranked once, and different texts with one item_id each. Ties beyond the last
    rank are decided by doc_id. Empty tables give no rows. Other columns are ignored, whatever their names.
    """
    common.prepare(spark)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks(items):
        vectors = stored(texts.mapInPandas(_restrict(block.index), "doc_id long, n long, terms array<int>, tfs array<int>"))
        documents, total = vectors.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            return out
        named = vectors.where("size(terms) > 0")
        # One row per term of the block.
        df = {t: n for t, n in named.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
        found = named.mapInPandas(_search(block, documents, total, df, top), FOUND)
        best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
        for by in (Window.partitionBy("idx", part), Window.partitionBy("idx")):
            found = found.withColumn("rank", F.row_number().over(by.orderBy(*best))).where(F.col("rank") <= top)
        out = out.union(stored(found.select("item_id", "rank", "doc_id", "score")))
    return out
