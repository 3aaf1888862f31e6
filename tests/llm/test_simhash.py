import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from contactmill.llm import simhash_dedup as sim
from tests.llm import cases


def naive_print(text):
    words = [w for w in (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(ids, prints):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    groups = {}
    for i, x in enumerate(ids):
        if x is not None:
            groups[root(i)] = min(groups.get(root(i), x), x)
    return [groups.get(root(i)) for i in range(len(ids))]


def check(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = [naive_print(t) for _, t in rows]
    parts = naive_components([i for i, _ in rows], prints)
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, parts)]
    assert cases.ordered(sim.near_duplicates(spark, docs).collect()) == cases.ordered(want)


def test_whole_table_against_brute_force(spark):
    check(spark, spark.read.parquet(f"{cases.folder()}/documents.parquet"))


def test_awkward_documents(spark):
    check(spark, cases.awkward(spark))
    assert sim.near_duplicates(spark, cases.empty(spark)).collect() == []


def same_components(spark, prints, crowd):
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = [(r.a, r.b) for r in sim.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), crowd).collect()]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 2 for a, b in links)
    ids = list(range(len(prints)))
    root = {p: p for p in signed}
    for a, b in links:
        x, y = root[a], root[b]
        if x != y:
            root = {p: y if r == x else r for p, r in root.items()}
    parts = naive_components(ids, prints)
    for i in ids:
        for j in range(i):
            assert (root[signed[i]] == root[signed[j]]) == (parts[i] == parts[j])


def test_all_pairs_within_two_bits_are_linked(spark):
    rng = random.Random(3)
    prints = [0]
    for _ in range(60):
        x = rng.choice(prints)
        for _ in range(rng.choice((1, 2, 3))):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    for crowd in (0, 2, sim.CROWD):
        same_components(spark, prints, crowd)


def test_crowded_values_are_split_without_losing_links(spark):
    """Clusters that share a segment, next to values that are one bit from the crowded ones."""
    rng = random.Random(8)
    for _ in range(2):
        base = rng.getrandbits(64)
        prints = [base ^ (rng.getrandbits(6) << rng.choice((0, 32))) for _ in range(40)]
        prints += [rng.choice(prints) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)]
        prints += [rng.getrandbits(64) for _ in range(10)]
        for crowd in (1, 4, 12):
            same_components(spark, prints, crowd)


def test_no_link_is_left_out_in_a_crowd(spark):
    rng = random.Random(4)
    prints = sorted({rng.choice((0, 1 << 63)) ^ rng.getrandbits(7) ^ (rng.getrandbits(3) << 32) for _ in range(120)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = {(max(x, y), min(x, y)) for x in signed for y in signed if x != y and ((x ^ y) % (1 << 64)).bit_count() <= 2}
    for crowd in (0, 5, sim.CROWD):
        links = [(r.a, r.b) for r in sim.near_links(spark.createDataFrame([(p,) for p in signed * 2], "fp long"), crowd).collect()]
        assert len(links) == len(want) and set(links) == want


def test_verification_rejects_entries_of_the_same_segment(spark):
    low = 0x5EED
    far = [low | (x << 32) for x in (0, 0b111, 0b111000)]
    links = sim.near_links(spark.createDataFrame([(p,) for p in far], "fp long"))
    assert links.count() == 0


def test_a_crowd_of_close_fingerprints_makes_few_links(spark):
    crowd = [(1 << a) | (1 << b) for a in range(40) for b in range(a)]
    links = sim.near_links(spark.createDataFrame([(p,) for p in crowd], "fp long"))
    assert links.count() <= 65 * len(crowd)


def test_one_document_of_each_group_stays(spark):
    docs = cases.awkward(spark)
    kept = sim.without_near_duplicates(spark, docs)
    assert kept.columns == docs.columns
    groups = Counter(r.component_id for r in sim.near_duplicates(spark, docs).collect())
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in groups if i is not None)
    assert sim.without_near_duplicates(spark, cases.empty(spark)).collect() == []


def test_repeated_rows_leave_one(spark):
    docs = cases.awkward(spark, [r for r in cases.ROWS if r[0] == 6] * 3)
    assert sim.without_near_duplicates(spark, docs).count() == 1


def words(text):
    found = text.encode().lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(len(found) - 4, 1))}


def test_every_similar_pair_of_a_key_is_connected(spark):
    """Eight families of three texts under the same bands, under one fingerprint, and under fingerprints two bits apart."""
    rng = random.Random(6)
    rows, families = [], []
    for _ in range(8):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        families.append([" ".join(base[:-i] if i else base) for i in range(3)])
        rows += [(len(rows) + i, t) for i, t in enumerate(families[-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = docs.select(F.xxhash64("text").alias("id"), "doc_id", sim.sketch_column("text").alias("sketch")).select("id", "doc_id", "sketch.*")
    alone, shared = F.array(F.col("doc_id") + 100), F.array(F.lit(7).cast("long"))
    near = F.get(F.array(F.lit(0), F.lit(1), F.lit(1 << 40)), (F.col("doc_id") % 3).cast("int")).cast("long")
    for bands, fp in ((shared, F.expr("shiftleft(doc_id, 20) * 7")), (alone, F.lit(5).cast("long")), (alone, near)):
        classes = own.withColumn("bands", bands).withColumn("fp", fp).drop("doc_id").localCheckpoint()
        root = {r.id: r.id for r in classes.collect()}
        names = {r.id: r.doc_id for r in own.collect()}
        for r in sim.similar_links(docs, classes).collect():
            x, y = root[r.a], root[r.b]
            root = {i: y if c == x else c for i, c in root.items()}
        groups = {}
        for i, c in root.items():
            groups.setdefault(c, set()).add(names[i])
        assert sorted(map(sorted, groups.values())) == [[3 * k, 3 * k + 1, 3 * k + 2] for k in range(8)]


def test_near_copies_by_five_words_leave_one(spark):
    """Copies at a similarity of 0.8 to 0.95, many of them far beyond two bits, and pairs below 0.8 that stay."""
    import corpus_pipeline

    rng = random.Random(8)
    texts, beyond = [], 0
    for k in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        copy = list(base)
        # Each changed word breaks five shingles.
        for i in range(10, 190, 30 if k % 3 else (45 if k % 2 else 17)):
            copy[i] = "changed"
        texts += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        beyond += (naive_print(texts[-1][1]) ^ naive_print(texts[-2][1])).bit_count() > 2
    docs = cases.awkward(spark, [(i, t, "en", "a", 0, 0) for i, t in texts])
    like = {i: len(words(a) & words(b)) / len(words(a) | words(b)) for (_, a), (i, b) in zip(texts[::2], texts[1::2])}
    assert beyond > 30 and min(like.values()) < 0.8 < max(like.values())
    kept = {r.doc_id for r in corpus_pipeline.unlike_documents(spark, docs, "").collect()}
    assert kept == {i for i, _ in texts if like.get(i, 0) < 0.8}


def test_similar_awkward_documents(spark):
    docs = cases.awkward(spark)
    kept = sim.without_similar(spark, docs)
    assert kept.columns == docs.columns
    # Copies leave the smallest id, passages 7 and 8 are similar at 0.84, and empty texts are equal.
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "10", "2", "5", "7", "9", "None"]
    assert sim.without_similar(spark, cases.empty(spark)).collect() == []
    assert sim.without_similar(spark, cases.awkward(spark, [r for r in cases.ROWS if r[0] == 6] * 3)).count() == 1


def crowd_of_texts(spark, n=300):
    """Texts of one kind, of which each 2i is similar to 2i + 1 (i < 25) and to no other; their classes but for the keys."""
    rng = random.Random(9)
    base, texts = [f"w{i}" for i in range(120)], []
    for i in range(n):
        if i % 2 and i < 50:
            texts.append(texts[-1] + " end")
            continue
        text = list(base)
        for at in rng.sample(range(120), 5):
            text[at] = f"own{i}x{at}"
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = docs.select(F.xxhash64("text").alias("id"), "doc_id", sim.sketch_column("text").alias("sketch")).select("id", "doc_id", "sketch.*")
    sets = [words(t) for t in texts]
    like = {(i, j) for j in range(n) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert like == {(i, i + 1) for i in range(0, 50, 2)}
    return docs, own.localCheckpoint(), like


def linked(docs, own, classes):
    names = {r.id: r.doc_id for r in own.collect()}
    return {tuple(sorted((names[r.a], names[r.b]))) for r in sim.similar_links(docs, classes).collect()}


def test_a_crowd_that_is_not_similar_makes_no_square_of_rows(spark, monkeypatch):
    docs, own, like = crowd_of_texts(spark)
    sent, plain = [], sim._with

    def counted(pairs, *args, **kwargs):
        sent.append(pairs.count())
        return plain(pairs, *args, **kwargs)

    monkeypatch.setattr(sim, "_with", counted)
    alone = own.withColumn("fp", F.xxhash64("id")).withColumn("bands", F.array(F.lit(7).cast("long")))
    assert linked(docs, own, alone.drop("doc_id")) == like
    # The two ends of a key, then few blocks; all pairs are 44,850.
    assert max(sent) <= 3 * 300


def test_all_pairs_of_blocks_meet(spark, monkeypatch):
    """A key in many blocks, and two fingerprints two bits apart with uneven numbers of blocks."""
    docs, own, like = crowd_of_texts(spark, 90)
    monkeypatch.setattr(sim, "BLOCK", 7)
    alone, shared = F.array(F.col("doc_id") + 100), F.array(F.lit(7).cast("long"))
    near = F.when(F.col("doc_id") % 2 == 0, F.lit(0)).otherwise(F.lit(1 << 40)).cast("long")
    uneven = F.when((F.col("doc_id") % 2 == 0) | (F.col("doc_id") > 60), F.lit(0)).otherwise(F.lit(1 << 40)).cast("long")
    for bands, fp in ((shared, F.expr("shiftleft(doc_id, 20) * 7")), (alone, near), (alone, uneven)):
        assert linked(docs, own, own.withColumn("bands", bands).withColumn("fp", fp).drop("doc_id")) == like
    monkeypatch.setattr(sim, "BLOCK_SHINGLES", 50)
    assert linked(docs, own, own.withColumn("bands", shared).withColumn("fp", F.lit(5).cast("long")).drop("doc_id")) == like


def test_shared_elements_are_counted_in_slices(monkeypatch):
    monkeypatch.setattr(sim, "COLUMNS", 3)
    rng = random.Random(2)
    sets = [sorted(rng.sample(range(60), rng.randrange(1, 30))) for _ in range(25)] + [[1000]]
    both = sim._shared([sim.np.array(x, dtype="uint64") for x in sets])
    assert all(both[i][j] == len(set(sets[i]) & set(sets[j])) for i in range(26) for j in range(26) if i != j)
    assert sim._shared([sim.np.array([5], dtype="uint64")]).shape == (1, 1)
