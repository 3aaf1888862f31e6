"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has two segments of 32 bits and stands in one table per segment under its value there. Two
fingerprints that differ in at most two bits differ in at most one within some segment. So the small Hamming
ball (radius one, 33 values) around each segment's value is enumerated, the table entries under these values
are fetched, and the complete distance of each is verified.

A value may hold very many fingerprints when many documents are alike. Such crowded values and those one
bit from them are split by the other segment: keys are whole fingerprints, the ball of radius one around each
is enumerated in both segments, and two fingerprints differ in at most two bits exactly when they meet under a
key. At most 65 different fingerprints meet there, and all their pairs are links. Every other value
is probed by at most 33 times CROWD fingerprints and holds at most CROWD. A fingerprint has at most 2,080 others
within two bits, so links grow with the number of different fingerprints, never with its square; none is left out.

A pair of a given Jaccard similarity is a matter of other distances: at 0.8 about ten of 64 bits differ, and
a key that bears that many is so short that each holds a fixed share of all texts. `without_similar`
therefore adds the keys of minimum hashes in bands as candidates, and verifies every candidate by the exact
similarity of its shingles. The members of a key are first compared with two of them, which joins most groups of
copies; then, where a key still holds several components, with all its members. So every pair of a key is either
compared or known to be connected, and a group of copies costs no square of pairs. Very many texts that are alike but
not similar enough have to be compared with each other; this is done in blocks by matrix products, so that rows go to
blocks and only links come back, never a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactmill.llm import common
from contactmill.session import stored

SEED = 42
SHINGLE = 3
DISTANCE = 2
SEGMENT_BITS = 32
#: Different fingerprints that a segment value may hold before it is split by the other segment, and tasks over
#: which the fingerprints of one value are dealt while that is found out.
CROWD = 64
SALTS = 16
CHUNK = 1 << 15

#: Of `without_similar`: words of a shingle, the similarity of a link, and bands of so many minimum hashes. A pair
#: at the similarity itself shares a band with a chance of 1 - (1 - 0.8 ** 8) ** 40 = 0.9993.
WORDS = 5
SIMILARITY = 0.8
BANDS = 40
BAND = 8
#: The share of equal minimum hashes that a pair needs to be compared in full, and tasks that share a text's pairs.
AGREE = SIMILARITY - 6.2 * (SIMILARITY * (1 - SIMILARITY) / (BANDS * BAND)) ** 0.5
PARTS = 64
#: Texts and shingles in a block of a key's members, two of which are compared in a task, and columns of a product.
BLOCK = 2048
BLOCK_SHINGLES = 1 << 20
COLUMNS = 1 << 10


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text as an unsigned 64-bit number; 0 where it has no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        starts, ends = [0], [len(joined)]
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        after = np.cumsum(lengths + 1) - 1
        starts = (after - lengths)[: -(SHINGLE - 1)].tolist()
        ends = after[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), CHUNK):
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * votes > len(starts)))


@F.pandas_udf(T.LongType())
def fingerprint_column(texts: pd.Series) -> pd.Series:
    """The fingerprints of texts, as signed longs with the same bits."""
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def _ball(value: str, bits: int) -> Column:
    """A value and all that differ from it in one of the lowest bits."""
    return F.expr(f"concat(array({value}), transform(sequence(0, {bits - 1}), i -> {value} ^ shiftleft(1L, i)))")


def _tables(fingerprints: DataFrame, crowd: int) -> DataFrame:
    """Entries (fp, value, near, crowded): the tables of both segments, the second's values with one bit more.

    ``crowded`` values hold more than ``crowd`` different fingerprints, ``near`` ones are at most one bit from such.
    """
    low = F.expr(f"fp & {(1 << SEGMENT_BITS) - 1}L")
    high = F.expr(f"shiftrightunsigned(fp, {SEGMENT_BITS}) | {1 << SEGMENT_BITS}L")
    entries = fingerprints.where("fp is not null").select("fp").distinct().select(
        "fp", F.explode(F.array(low, high)).alias("value"), F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt")
    )
    entries = stored(entries)
    hot = entries.groupBy("value").count().where(F.col("count") > crowd)
    marks = hot.select(F.col("value").alias("at"), F.explode(_ball("value", SEGMENT_BITS)).alias("value"))
    marks = marks.groupBy("value").agg(F.max(F.col("at") == F.col("value")).alias("crowded"))
    marks = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    marked = entries.join(marks, ["value", "salt"], "left")
    return marked.select(
        "fp", "value", F.col("crowded").isNotNull().alias("near"), F.coalesce("crowded", F.lit(False)).alias("crowded")
    )


def _met(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs (fp, other) of entries of tables that are not crowded, each met by the balls of probes."""
    balls = probes.select("fp", F.explode(_ball("value", SEGMENT_BITS)).alias("value"))
    return balls.join(entries.select(F.col("fp").alias("other"), "value"), "value").select("fp", "other")


def _split(crowd: DataFrame) -> DataFrame:
    """Pairs (fp, other) of crowded fingerprints that meet under a whole-fingerprint key."""
    keyed = crowd.select("fp", F.explode(_ball("fp", 2 * SEGMENT_BITS)).alias("key"))
    others = keyed.select(F.col("fp").alias("other"), "key")
    return keyed.join(others, "key").where("fp > other").select("fp", "other")


def near_links(fingerprints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links ``(a, b)``, a > b, between different fingerprints ``fp`` at most two bits apart: all there are.

    Null fingerprints link with nothing, repeated ones count once, and no fingerprints give no links. ``crowd``
    changes the way taken, never a link.
    """
    tables = stored(_tables(fingerprints, crowd))
    # A fingerprint outside near values meets no crowded one; two inside them are both split.
    pairs = _met(tables.where("not near"), tables.where("not crowded"))
    pairs = pairs.union(_split(tables.where("near").select("fp").distinct()))
    return (
        pairs.where("fp <> other")
        .where(f"bit_count(fp ^ other) <= {DISTANCE}")
        .select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b"))
        .distinct()
    )


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest doc_id reachable over fingerprints at most two bits apart, itself
    included. Texts are whole; a null text counts as empty, and texts without a word share the
    fingerprint zero. Equal texts (ties, repeated rows) share a fingerprint and so a component. A null
    doc_id never becomes the smallest one unless the component has no other. An empty table gives no
    rows. Other columns are ignored.
    """
    common.prepare(spark)
    printed = stored(docs.select("doc_id", fingerprint_column(common.text_or_empty()).alias("fp")))
    classes = stored(printed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = common.components(near_links(classes))
    rooted = classes.join(found, classes.fp == found.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.join(smallest, "root").select("fp", "component_id"))
    return printed.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents with one left of each component: the one with the smallest doc_id.

    Of rows with that same doc_id in one component one stays, the first by fingerprint. Rows with a null
    doc_id stay only where their component has no other. All columns are returned, whatever their names.
    """
    each = near_duplicates(spark, docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = stored(
        each.groupBy("component_id", "doc_id", "fingerprint")
        .agg(F.count("*").alias("n"))
        .groupBy("component_id", "doc_id")
        .agg(F.min(F.struct("fingerprint", "n")).alias("pick"))
        .select(F.col("doc_id").alias("__id"), F.col("pick.fingerprint").alias("__fp"), F.col("pick.n").alias("__n"))
    )
    fp = F.lower(F.lpad(F.hex(fingerprint_column(common.text_or_empty())), 16, "0"))
    chosen = docs.withColumn("__print", fp).join(
        kept.select("__id", "__fp").hint("shuffle_hash"),
        F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__print") == F.col("__fp")),
        "left_semi",
    )
    if not kept.where("__n > 1").isEmpty():
        by = Window.partitionBy("doc_id", "__print").orderBy(F.xxhash64(common.text_or_empty()))
        chosen = chosen.withColumn("__row", F.row_number().over(by)).where("__row = 1").drop("__row")
    return chosen.drop("__print")


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes; a text with fewer words is one shingle."""
    found = (text or "").encode().lower().split()
    digest, n = xxhash.xxh64_intdigest, max(len(found) - words + 1, 1)
    return np.unique(np.array([digest(b" ".join(found[i : i + words]), SEED) for i in range(n)], dtype=np.uint64))


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """The Jaccard similarity of two sets of shingles."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


@F.pandas_udf(T.BinaryType())
def shingle_column(texts: pd.Series) -> pd.Series:
    """The shingles of texts, the bytes of their hashes one after another."""
    return pd.Series([shingles(t).tobytes() for t in texts])


SKETCH = T.StructType([
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("marks", T.BinaryType()), T.StructField("n", T.IntegerType()),
])


@F.pandas_udf(SKETCH)
def sketch_column(texts: pd.Series) -> pd.DataFrame:
    """Of a text: its keys, one per band of minimum hashes; a byte of each of these hashes; its number of shingles."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, size=(BANDS * BAND, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = []
    for text in texts:
        x = shingles(text)
        least = np.full(BANDS * BAND, np.iinfo(np.uint64).max)
        for i in range(0, len(x), 1 << 11):
            least = np.minimum(least, (factors * x[i : i + (1 << 11)]).min(axis=1))
        keys = [xxhash.xxh64_intdigest(band.tobytes()) for band in least.reshape(BANDS, BAND)]
        marks = (least >> np.uint64(24)).astype(np.uint8).tobytes()
        out.append((np.array(keys, dtype=np.uint64).view(np.int64), marks, len(x)))
    return pd.DataFrame(out, columns=["bands", "marks", "n"])


@F.pandas_udf(T.DoubleType())
def shared_marks(x: pd.Series, y: pd.Series) -> pd.Series:
    """The share of equal bytes of two texts' marks, an estimate of their similarity that errs upwards."""
    return pd.Series([float(np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8))) for a, b in zip(x, y)])


def _keys(classes: DataFrame) -> DataFrame:
    """The keys (band, key, id, n) of classes (id, fp, bands, n): their bands, and the fingerprint as band -1."""
    each = classes.select("id", "n", F.posexplode("bands").alias("band", "key"))
    prints = classes.select("id", "n", F.lit(-1).alias("band"), F.col("fp").alias("key"))
    return each.union(prints).select("band", "key", "id", "n")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (x, y) as different (a, b) with a < b."""
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _first_candidates(keys: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of a key with its smallest one and its largest by a hash.

    Bands take four different ones. Pairs grow with the classes, never with the square of a group.
    """
    high = F.max(F.struct(F.expr("xxhash64(id, pmod(band, 4))"), "id"))["id"].alias("high")
    ends = keys.groupBy("band", "key").agg(F.min("id").alias("low"), high, F.count("*").alias("n")).where("n > 1")
    met = keys.join(ends, ["band", "key"]).select(F.col("id").alias("x"), F.explode(F.array("low", "high")).alias("y"))
    return _ordered(met)


def _meetings(keys: DataFrame, close: DataFrame, links: DataFrame) -> DataFrame:
    """The members a of meetings b, in which all pairs of different components are to be compared: (a, b, root).

    Members meet that share a key or whose fingerprints are ``close``, where they are of different components (root) of
    ``links``. The members of a key are dealt to blocks and each two blocks meet: a member goes to as many meetings as
    there are blocks, about an eighth of the square root of the members. Two members of a key were compared as its ends.
    A meeting is named by a hash; two under one name would be compared together, which changes no link.
    """
    found = common.components(links)
    placed = stored(keys.join(found, keys.id == found.node, "left").select("band", "key", "id", "n", F.coalesce("component", "id").alias("root")))
    blocks = F.greatest(F.ceil(F.sqrt(F.count("*")) / 8), F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    groups = placed.groupBy("band", "key").agg(F.count("*").alias("m"), blocks.cast("int").alias("k"), F.min("root").alias("r"), F.max("root").alias("s"))
    mixed = groups.where("m > 2 and r <> s").select("band", "key", "k", F.col("key").alias("key_y"), F.lit(0).alias("k_y"))
    prints = groups.where("band = -1").drop("m")
    others = prints.select(*[F.col(c).alias(f"{c}_y") for c in ("key", "k", "r", "s")])
    apart = close.select(F.col("a").alias("key"), F.col("b").alias("key_y")).join(prints, "key").join(others, "key_y")
    apart = stored(apart.where("least(r, r_y) <> greatest(s, s_y)").select("band", "key", "k", "key_y", "k_y"))
    back = apart.select("band", F.col("key_y").alias("key"), F.col("k_y").alias("k"), F.col("key").alias("key_y"), F.col("k").alias("k_y"))
    # A key meets itself (k_y 0: each block meets the others, or stays alone) or the blocks of another key.
    at = F.expr("int(pmod(xxhash64(id), k))")
    to = F.expr("case when k_y > 0 then sequence(0, k_y - 1) when k = 1 then array(0) else array_remove(sequence(0, k - 1), at) end")
    ends = F.array_sort(F.array(F.struct("key", F.col("at").alias("block")), F.struct(F.col("key_y").alias("key"), F.col("to").alias("block"))))
    dealt = placed.join(mixed.union(apart).union(back), ["band", "key"]).withColumn("at", at).withColumn("to", F.explode(to))
    return dealt.select(F.col("id").alias("a"), F.xxhash64("band", ends).alias("b"), "root")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """The number of elements that each two of sets (sorted, without repeats) share; that of a set with itself is unspecified."""
    values = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(values)
    values, owners = values[order], owners[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    counts = np.diff(np.r_[starts, len(values)])
    # Elements of one set only are shared by none.
    owners, counts = owners[np.repeat(counts > 1, counts)], counts[counts > 1]
    both, ends = np.zeros((len(sets), len(sets)), dtype=np.int32), np.r_[0, np.cumsum(counts)]
    for i in range(0, len(counts), COLUMNS):
        j = min(i + COLUMNS, len(counts))
        holds = np.zeros((len(sets), j - i), dtype=np.float32)
        holds[owners[ends[i] : ends[j]], np.repeat(np.arange(j - i), counts[i:j])] = 1
        both += (holds @ holds.T).astype(np.int32)
    return both


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) of similar texts of a meeting that join all components with such a link: a forest, not every link."""
    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    sizes, ids, roots = np.array([len(x) for x in sets]), rows["a"].to_numpy(), rows["root"].to_numpy()
    both = _shared(sets)
    alike = np.array([both[i] / (sizes[i] + sizes - both[i]) >= SIMILARITY for i in range(len(sets))])
    found, left = [], np.full(len(sets), True)
    for start in range(len(sets)):
        reached = [start] if left[start] else []
        left[start] = False
        while reached:
            i = reached.pop()
            same = roots == roots[i]
            new = np.flatnonzero(left & (same | alike[i]))
            found += [(ids[i], ids[j]) for j in new if not same[j]]
            left[new] = False
            reached += new.tolist()
    return pd.DataFrame({"a": [min(x) for x in found], "b": [max(x) for x in found]}, dtype=np.int64)


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose texts are similar. Rows come sorted by ``a``, whose shingles are made once."""
    at, x = None, None
    for batch in batches:
        good = []
        for a, text, other in zip(batch["a"], batch["text"], batch["other"]):
            if a != at:
                at, x = a, shingles(text)
            good.append(similarity(x, shingles(other)) >= SIMILARITY)
        yield batch.loc[good, ["a", "b"]]


def _with(pairs: DataFrame, rows: DataFrame, end: str, **columns: str) -> DataFrame:
    """Add columns of ``rows`` (by id) to pairs for one of their ends.

    A text of very many pairs goes to up to PARTS tasks, once to each, and its pairs are dealt among them.
    """
    other = "b" if end == "a" else "a"
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64(other), F.lit(PARTS)))
    needed = dealt.select(F.col(end).alias("id"), "part").distinct()
    sent = needed.join(rows, "id").select(F.col("id").alias(end), "part", *[F.col(c).alias(new) for c, new in columns.items()])
    return dealt.join(sent, [end, "part"]).drop("part")


def similar_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between ids of texts whose shingles have the similarity asked for; all are verified.

    Classes that share a key or are at most two bits apart are linked, or connected by other links, if they
    are similar: see `_first_candidates` and `_meetings`.
    """
    keys = _keys(classes)
    links = stored(_similar(_first_candidates(keys), docs, classes))
    close = stored(near_links(classes.select("fp")))
    met = stored(_meetings(keys, close, links))
    sets = _texts(docs, met.select(F.col("a").alias("id"))).select("id", shingle_column("text").alias("shingles"))
    full = _with(met, sets, "a", shingles="shingles")
    return links.union(full.groupBy("b").applyInPandas(_joined, "a long, b long").distinct())


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts (id, text) of ids, once each."""
    text = common.text_or_empty()
    return common.stored_texts(
        docs.select(F.xxhash64(text).alias("id"), text.alias("text")).join(ids.distinct(), "id", "left_semi")
        .groupBy("id").agg(F.first("text").alias("text"))
    )


def _similar(candidates: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of candidate pairs (a, b) that have the similarity asked for.

    Before whole texts are sent for, pairs go whose numbers of shingles alone rule the similarity out, and those
    whose minimum hashes agree by six standard deviations less than they do at that similarity (a pair that
    has it is lost so with a chance of 3 in 10 billion).
    """
    size, agree = F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b"), shared_marks("marks_a", "marks_b") >= AGREE
    pairs = stored(candidates)
    pairs = _with(_with(pairs, classes, "b", marks="marks_b", n="n_b"), classes, "a", marks="marks_a", n="n_a")
    pairs = stored(pairs.where(size).where(agree).select("a", "b"))
    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    full = _with(_with(pairs, texts, "b", text="other"), texts, "a", text="text")
    return full.select("a", "b", "text", "other").sortWithinPartitions("a").mapInPandas(_verified, "a long, b long")


def without_similar(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents with one left of each component of similar ones: the one with the smallest doc_id.

    Two texts are similar at a Jaccard similarity of 0.8 or more of their 5-word shingles. Words are as in
    fingerprints: in lower case, whole texts; a null text counts as empty, and texts without a word are
    equal. Of rows with that same doc_id in one component one stays, the first by hash of the text. Rows with
    a null doc_id stay only where their component has no other. An empty table gives no rows. All columns are
    returned, whatever their names.
    """
    common.prepare(spark)
    text = common.text_or_empty()
    rows = stored(
        docs.select("doc_id", F.xxhash64(text).alias("id"), fingerprint_column(text).alias("fp"), sketch_column(text).alias("sketch"))
        .select("doc_id", "id", "fp", "sketch.*")
    )
    firsts = [F.first(c).alias(c) for c in ("fp", "bands", "marks", "n")]
    classes = stored(rows.groupBy("id").agg(F.min("doc_id").alias("least"), *firsts))
    found = common.components(stored(similar_links(docs, classes)))
    rooted = classes.join(found, classes.id == found.node, "left").select("id", "least", F.coalesce("component", "id").alias("root"))
    # Null comes after every number here: it stays only where there is no other.
    kept = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "id")).alias("pick"))
    kept = stored(kept.select(F.col("pick.least").alias("__id"), F.col("pick.id").alias("__text")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__print") == F.col("__text"))
    chosen = docs.withColumn("__print", F.xxhash64(text)).join(kept.hint("shuffle_hash"), same, "left_semi")
    twice = rows.withColumnRenamed("id", "__print").join(kept, same, "left_semi").groupBy("doc_id", "__print").count().where("count > 1")
    if not twice.isEmpty():
        by = Window.partitionBy("doc_id", "__print").orderBy("__print")
        chosen = chosen.withColumn("__row", F.row_number().over(by)).where("__row = 1").drop("__row")
    return chosen.drop("__print")
