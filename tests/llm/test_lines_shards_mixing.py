import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from contactmill.llm import line_dedup, mixing, sharding
from contactmill.session import stored
from tests.llm import cases


def test_repeated_passages_go_and_their_first_stays(spark):
    rows = line_dedup.without_repeated_chunks(spark, cases.awkward(spark))
    assert rows.columns == [*cases.awkward(spark).columns, "__removed_lines"]
    have = rows.collect()
    assert len(have) == len(cases.ROWS)
    texts = {r.doc_id: r for r in have}
    before = {r[0]: r for r in cases.ROWS}
    assert texts[7].text == before[7][1] and texts[7]["__removed_lines"] == 0
    assert texts[8]["__removed_lines"] == 12
    assert texts[8].n_chars == len(texts[8].text)
    assert texts[8].text == "Another first line.\nAnd one more."
    for i in (1, 2, 3, 4, 5, 6, 9, 10):
        assert texts[i].text == before[i][1] and texts[i].n_chars == before[i][4]
    assert line_dedup.without_repeated_chunks(spark, cases.empty(spark)).collect() == []


def test_copies_are_emptied_and_repeated_rows_agree(spark):
    rows = [(i, cases.LINES, "en", "a", len(cases.LINES), 0) for i in (3, 1, 2)] * 2
    have = line_dedup.without_repeated_chunks(spark, cases.awkward(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in have) == {(1, cases.LINES): 2, (2, ""): 2, (3, ""): 2}


def test_equal_digests_of_different_bytes_stay(spark, monkeypatch):
    """The byte comparison spares the first place of each text behind one digest."""
    rows = [(1, "a\nb"), (2, "c\nd"), (3, "c\nd")]
    docs = spark.createDataFrame(rows, "id long, __text string").withColumn("key", F.xxhash64("__text"))
    mark = F.struct(F.lit(0).alias("pos"), F.lit(2).alias("n"), F.lit(7).alias("digest"), (F.col("id") > 1).alias("again"))
    spared = line_dedup._spared(stored(docs.withColumn("__marks", F.array(mark))))
    assert sorted((r.spared_id, [p.pos for p in r.spared]) for r in spared.collect()) == [(1, [0]), (2, [0])]
    # With one digest for all places, the result is that of the bytes.
    texts = planted(6, 3)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "_HASHES", "transform(__lines, l -> 0L)")
    assert rests(line_dedup.without_repeated_chunks(spark, docs)) == by_hand(texts)


def planted(n, lines, words=20):
    """Passages that stand in two documents each, between lines of their own."""
    rng = random.Random(lines)

    def some(k):
        return ["_".join(str(rng.randrange(10**6)) for _ in range(2)) + " " + " ".join(str(rng.randrange(10**4)) for _ in range(words - 1)) for _ in range(k)]

    texts = []
    for i in range(n):
        passage = some(lines)
        texts += [(2 * i + j, "\n".join([*some(rng.randrange(1, 6)), *passage, *some(rng.randrange(1, 6))])) for j in range(2)]
    return texts


def by_hand(texts):
    """What is left of each text by plain loops: pairs of lines and long lines seen before, in chunks of 20 words."""
    seen, out = set(), {}
    for i, text in sorted(texts, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        counts = [len(re.findall("[^\x20\x09-\x0d]+", line)) for line in lines]
        covered = set()
        for k in range(len(lines)):
            for piece, under in ((tuple(lines[k : k + 2]), {k, k + 1}), ((lines[k],), {k})):
                if len(piece) != len(under) or (len(piece) == 1 and counts[k] <= 50):
                    continue
                if piece in seen:
                    covered |= under
                seen.add(piece)
        gone, k = set(), 0
        while k < len(lines):
            end = k
            while end in covered:
                end += 1
            if sum(counts[k:end]) >= 20:
                gone |= set(range(k, end))
            k = max(end, k + 1)
        out[i] = "\n".join(line for k, line in enumerate(lines) if k not in gone) if gone else text
    return out


def rests(rows):
    return {r.doc_id: r.text for r in rows.collect()}


@pytest.mark.parametrize("lines", [2, 3, 4, 5, 8])
def test_short_passages_go_in_any_surroundings(spark, lines):
    texts = planted(60, lines)
    have = rests(line_dedup.without_repeated_chunks(spark, spark.createDataFrame(texts, "doc_id long, text string")))
    assert have == by_hand(texts)
    for i, text in texts:
        left = have[i].count("\n") + 1
        assert left == text.count("\n") + 1 - (lines if i % 2 else 0)


def test_awkward_passages_equal_plain_loops(spark):
    long = " ".join(["w"] * 51)
    texts = [
        (1, f"{long}\nx"), (2, f"y\n{long}"), (3, long), (4, "a\nb\nc"), (5, "z\na\nb\nc"), (6, "\n\n\n\n"), (7, "\n\n\n"),
        (8, "\n".join([f"{'s ' * 9}t"] * 6)), (9, "\n".join([f"{'s ' * 9}t"] * 5) + "\nend"), (10, ""), (11, None), (12, " ".join(["w"] * 50)),
        (13, " ".join(["w"] * 50)), (14, f"{'q ' * 10}\r\n{'q ' * 10}\n{'k ' * 11}"), (15, f"{'q ' * 10}\r\n{'q ' * 10}\nno"),
    ]
    have = rests(line_dedup.without_repeated_chunks(spark, spark.createDataFrame(texts, "doc_id long, text string")))
    assert have == by_hand(texts)
    assert have[2] == "y" and have[3] == "" and have[5] == "z\na\nb\nc" and have[15] == "no"


def test_a_shared_line_of_many_documents_is_not_joined_in_one_task(spark):
    texts = [(i, f"own {i}\n{'f ' * 15}\n{'g ' * 15}\nother {i}") for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    have = rests(line_dedup.without_repeated_chunks(spark, docs))
    assert have == by_hand(texts) and have[299] == "own 299\nother 299"


@pytest.mark.parametrize("limit", [200, 5_000, 10**9])
def test_shards_fit_and_split_only_when_needed(spark, limit):
    docs = spark.read.parquet(f"{cases.folder('sf0.001')}/documents.parquet")
    rows = sharding.shards(spark, docs, limit).collect()
    assert len(rows) == docs.count()
    size, members = Counter(), defaultdict(list)
    for r in rows:
        assert len(r.shard) == r.depth
        size[r.shard] += r.n_bytes
        members[r.shard].append(r.doc_id)
    assert all(n <= limit or len(members[s]) == 1 for s, n in size.items())
    assert not any(a != b and b.startswith(a) for a in size for b in size)
    for shard in size:
        if shard:
            # The parent held too much.
            assert sum(n for s, n in size.items() if s.startswith(shard[:-1])) > limit


def test_shards_of_awkward_documents(spark):
    rows = sharding.shards(spark, cases.awkward(spark), 100).collect()
    assert len(rows) == len(cases.ROWS)
    assert len({r.shard for r in rows if r.doc_id == 6}) == 1
    assert {r.n_bytes for r in rows if r.doc_id in (2, 3)} == {0}
    assert sharding.shards(spark, cases.empty(spark), 100).collect() == []


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = spark.read.parquet(f"{cases.folder('sf0.001')}/documents.parquet")
    sharding.write_shards(spark, docs, f"{tmp_path}/shards", 50_000)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert cases.ordered(back.select(docs.columns).collect()) == cases.ordered(docs.collect())


def counted(spark, sources):
    rows = [(i, " ".join(["w"] * n), "en", s, 0, 0) for i, (s, n) in enumerate(sources)]
    return cases.awkward(spark, rows)


def test_repetition_limit_holds_every_source_once(spark):
    docs = counted(spark, [("big", 10)] * 60 + [("mid", 10)] * 20 + [("small", 10)] * 5)
    drawn = mixing.mixed(spark, docs, mixing.Target(max_repetition=3.0))
    assert drawn.columns == [*docs.columns, "__epoch", "__block"]
    times = Counter(r.doc_id for r in drawn.collect())
    assert set(times) == set(range(85))
    by = defaultdict(int)
    for r in drawn.collect():
        by[r.source] += 10
    assert by["big"] == 600 and by["small"] == 150
    alpha = 1 - math.log(3) / math.log(12)
    assert abs(by["mid"] - 600 * (200 / 600) ** alpha) <= 10


def test_target_entropy_is_met(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10), ("d", 0)], "source string, tokens long")
    for goal in (0.5, 0.8, 1.05):
        alpha = mixing.exponent(totals, mixing.Target(entropy=goal))
        q = [n**alpha for n in (1000, 100, 10)]
        entropy = -sum(x / sum(q) * math.log(x / sum(q)) for x in q)
        assert abs(entropy - goal) < 1e-6
        shares = [r.weight for r in mixing.weights(totals, alpha, 100).orderBy("source").collect()]
        assert abs(sum(shares) - 1) < 1e-9 and shares[3] == 0


def test_budget_cuts_whole_blocks_of_a_permutation(spark):
    docs = counted(spark, [("a", 1 + i % 9) for i in range(400)])
    drawn = mixing.mixed(spark, docs, mixing.Target(budget=700), block_tokens=100)
    n = drawn.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert 700 - 9 <= n <= 700
    blocks = {r["__block"] for r in drawn.collect()}
    assert blocks == set(range(len(blocks)))
    more = mixing.mixed(spark, docs, mixing.Target(budget=5000, max_repetition=10.0))
    assert {r["__epoch"] for r in more.collect()} == {0, 1, 2}


def test_salted_plan_draws_the_same(spark, monkeypatch):
    docs = counted(spark, [("a", 5)] * 50 + [("b", 5)] * 20 + [("c", 7)] * 10)
    first = cases.ordered(mixing.mixed(spark, docs).select("doc_id", "__epoch").collect())
    monkeypatch.setattr(mixing, "SMALL_PLAN", 0)
    assert cases.ordered(mixing.mixed(spark, docs).select("doc_id", "__epoch").collect()) == first


def test_mixing_awkward_documents(spark):
    docs = cases.awkward(spark)
    drawn = mixing.mixed(spark, docs, mixing.Target(max_repetition=2.0))
    times = Counter((r.doc_id, r.text) for r in drawn.collect())
    for row in cases.ROWS:
        assert times[row[:2]] >= 1
    assert mixing.mixed(spark, cases.empty(spark)).collect() == []
    nothing = cases.awkward(spark, [(1, "", "en", "a", 0, 0), (2, None, "en", None, 0, 0)])
    assert sorted(r.doc_id for r in mixing.mixed(spark, nothing).collect()) == [1, 2]


def test_native_plans_have_no_python(spark):
    docs = spark.read.parquet(f"{cases.folder('sf0.001')}/documents.parquet")
    for df in (line_dedup.without_repeated_chunks(spark, docs), sharding.shards(spark, docs), mixing.mixed(spark, docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
