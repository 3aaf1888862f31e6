"""Near-duplicate embeddings by NN-descent.

Every vector keeps a list of its nearest neighbours so far. A round sends each vector, with what its list
holds, to its neighbours; who meets at a neighbour is a neighbour's neighbour and is compared, and
lists take up what is nearer. The first lists come from cells of a random projection tree of fixed
depth. Rounds go on until few lists change and an audit against brute force on a bounded sample finds the
recall asked for; otherwise lists grow. A list full of links is saturated: it may hide more links, so all
vectors of its component are then compared in blocks, of which only counts of links come out.

Nearest neighbours of a saturated vector are all of its own group, so links to another saturated group never
come up in its list. Such vectors therefore get a longer list, of neighbours in other components only, by a
descent of its own: from new random trees, over the neighbours of neighbours of both lists. Components that turn
out to be linked become one, and this goes on until none are found.

Vectors that are equal up to their length are one class from the start, so copies cost nothing.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactmill.llm import common
from contactmill.session import stored

COSINE = 0.95
NEIGHBOURS = 12
TABLES = 6
CELL = 48
MAX_ROUNDS = 8
#: A round that changes fewer list entries than this share ends the descent.
CHANGE = 0.02
#: Vectors of the audit (a bounded sample, the first by hash), and the share of their links to be found.
AUDIT = 256
RECALL = 0.98
#: Below this recall, with the longest lists allowed, there is no result.
LEAST_RECALL = 0.9
BLOCK = 512
#: Rounds compare vectors at half precision; what may be a link at that is compared again in full.
SLACK = 0.004

_PAIRS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("other", T.LongType()), T.StructField("near", T.FloatType()),
])


def _units(vectors: pd.Series) -> list[np.ndarray | None]:
    """Vectors of length one in double precision; None for those that link with nothing."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None if v is None else np.asarray(v, dtype=np.float64)
        size = 0.0 if x is None or not len(x) or not np.isfinite(x).all() else float(np.abs(x).max())
        if not size:
            out.append(None)
            continue
        x = x / size
        out.append(x / np.sqrt((x * x).sum()))
    return out


@F.pandas_udf(T.BinaryType())
def unit_column(vectors: pd.Series) -> pd.Series:
    """Unit vectors as bytes of doubles; null for those that link with nothing."""
    return pd.Series([None if x is None else x.tobytes() for x in _units(vectors)], dtype=object)


@F.pandas_udf(T.BinaryType())
def half_column(units: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(u).astype(np.float16).tobytes() for u in units], dtype=object)


def _cells_column(bits: int, seed: int = 0):
    """Per table the cell of a vector: the signs of its projections on random directions, others for each seed."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def cells(units: pd.Series) -> pd.Series:
        out = []
        for u in units:
            x = np.frombuffer(u)
            rng = np.random.default_rng([len(x), seed] if seed else len(x))
            signs = rng.normal(size=(TABLES, bits, len(x))) @ x > 0
            out.append([int(s @ (1 << np.arange(bits))) for s in signs])
        return pd.Series(out)

    return cells


def _compared(keep: int):
    """Rows sorted by ``at``: compare all of different ``kin`` that meet at a place, give each its best new neighbours.

    Places with many rows are taken in blocks of consecutive ones, so memory stays bounded.
    """

    def flush(rows: list[tuple], out: list[tuple]) -> None:
        if len(rows) < 2:
            return
        ids = np.array([r[0] for r in rows])
        x = np.stack([np.frombuffer(r[1], dtype=np.float16) for r in rows]).astype(np.float32)
        near = x @ x.T
        floor = np.array([r[2] for r in rows], dtype=np.float32)
        kin = np.array([r[4] for r in rows])
        near[kin[:, None] == kin[None, :]] = -2
        for i, (_, _, _, known, _) in enumerate(rows):
            row = near[i]
            good = np.flatnonzero(row > floor[i])
            if len(good) > keep:
                good = good[np.argpartition(-row[good], keep - 1)[:keep]]
            seen = set(known)
            out.extend((ids[i], ids[j], round(float(row[j]), 4)) for j in good if ids[j] not in seen)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, rows, out = None, [], []
        for batch in batches:
            for at, i, half, floor, known, kin in batch[["at", "id", "half", "floor", "known", "kin"]].itertuples(index=False):
                if at != place or len(rows) >= 2 * CELL:
                    flush(rows, out)
                    place, rows = at, []
                rows.append((i, half, floor, known, kin))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["id", "other", "near"])
                out = []
        flush(rows, out)
        yield pd.DataFrame(out, columns=["id", "other", "near"])

    return run


def _meet(rows: DataFrame, keep: int) -> DataFrame:
    """Candidates (id, other, near) of rows (at, id, half, floor, known, kin); those of one kin are not compared."""
    return rows.repartition("at").sortWithinPartitions("at", F.xxhash64("id")).mapInPandas(_compared(keep), _PAIRS)


def _merged(lists: DataFrame | None, found: DataFrame, keep: int) -> DataFrame:
    """(id, known, near): the nearest of old lists and new candidates, best first."""
    pairs = found
    if lists is not None:
        old = lists.select("id", F.explode(F.arrays_zip("known", "near")).alias("x"))
        pairs = pairs.union(old.select("id", F.col("x.known").alias("other"), F.col("x.near").alias("near")))
    best = F.slice(F.sort_array(F.collect_list(F.struct("near", "other")), asc=False), 1, keep)
    return (
        pairs.repartition("id")
        .groupBy("id", "other")
        .agg(F.max("near").alias("near"))
        .groupBy("id")
        .agg(best.alias("best"))
        .select("id", F.col("best.other").alias("known"), F.col("best.near").alias("near"))
    )


def _first_lists(points: DataFrame, n: int, keep: int, seed: int = 0) -> DataFrame:
    """Lists of points (id, half, unit, kin) from the cells of a few random projection trees, deep enough for cells of about CELL / 2."""
    bits = min(40, max(0, int(np.ceil(np.log2(max(n / (CELL / 2), 1))))))
    width = F.octet_length("half").alias("width")
    cells = points.select("id", "half", "kin", width, F.posexplode(_cells_column(bits, seed)("unit")).alias("tree", "cell"))
    # Vectors of different widths never meet.
    keys = ["tree", "width", "cell"]
    sizes = cells.groupBy(*keys).agg(F.ceil(F.count("*") / (2 * CELL)).alias("parts")).where("parts > 1")
    # A crowded cell is dealt out by hash, so no place gathers much more than others.
    placed = cells.join(stored(sizes), keys, "left").select(
        F.xxhash64(*keys, F.expr("pmod(xxhash64(id, tree), coalesce(parts, 1))")).alias("at"),
        "id", "half", F.lit(-1.0).cast("float").alias("floor"), F.expr("cast(array() as array<bigint>)").alias("known"), "kin",
    )
    return _merged(None, _meet(placed, keep), keep)


def _round(points: DataFrame, lists: DataFrame, keep: int) -> DataFrame:
    """Candidates from the neighbours of neighbours."""
    full = points.join(lists, "id", "left").select(
        "id", "half", F.coalesce("known", F.expr("cast(array() as array<bigint>)")).alias("known"),
        F.expr(f"case when size(known) >= {keep} then near[{keep - 1}] else cast(-1.0 as float) end").alias("floor"),
    )
    sent = full.select(F.explode(F.concat("known", F.array("id"))).alias("at"), "id", "half", "floor", "known", F.col("id").alias("kin"))
    return _meet(sent, keep)


def _descent(points: DataFrame, n: int, keep: int, lists: DataFrame | None) -> DataFrame:
    lists = stored(_first_lists(points.withColumn("kin", F.col("id")), n, keep) if lists is None else lists)
    for _ in range(MAX_ROUNDS):
        found = stored(_round(points, lists, keep))
        changed = found.count()
        lists = stored(_merged(lists, found, keep))
        if changed <= CHANGE * keep * n:
            break
    return lists


def _cosines():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = [float(np.frombuffer(a) @ np.frombuffer(b)) if len(a) == len(b) else -1.0 for a, b in zip(batch["u"], batch["v"])]
            yield batch.assign(cosine=near)[["a", "b", "cosine"]]

    return run


def _links(points: DataFrame, lists: DataFrame, cosine: float) -> DataFrame:
    """Links (a, b) with a < b that the lists hold, verified in double precision."""
    pairs = (
        lists.select("id", F.explode(F.arrays_zip("known", "near")).alias("x"))
        .where(F.col("x.near") >= cosine - SLACK)
        .select(F.least("id", "x.known").alias("a"), F.greatest("id", "x.known").alias("b"))
        .distinct()
    )
    units = points.select("id", "unit")
    full = pairs.join(units.select(F.col("id").alias("a"), F.col("unit").alias("u")), "a").join(
        units.select(F.col("id").alias("b"), F.col("unit").alias("v")), "b"
    )
    return full.mapInPandas(_cosines(), "a long, b long, cosine double").where(F.col("cosine") >= cosine).select("a", "b")


def _block_counts(cosine: float):
    """Per pair of blocks of a component: how many vectors of one block each vector of the other links with."""

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        left, right = pairs[pairs["side"] == 0], pairs[pairs["side"] == 1]
        same = not len(right)
        right = left if same else right
        x = np.stack([np.frombuffer(u) for u in left["unit"]])
        y = np.stack([np.frombuffer(u) for u in right["unit"]])
        near = x @ y.T >= cosine
        if same:
            np.fill_diagonal(near, False)
            return pd.DataFrame({"id": left["id"], "found": near @ left["size"].to_numpy()})
        return pd.concat([
            pd.DataFrame({"id": left["id"], "found": near @ right["size"].to_numpy()}),
            pd.DataFrame({"id": right["id"], "found": near.T @ left["size"].to_numpy()}),
        ])

    return run


def _crowded_counts(points: DataFrame, crowds: DataFrame, cosine: float) -> DataFrame:
    """(id, found): links of all vectors of the components with a saturated list, compared block by block.

    A component of m vectors is dealt into m / BLOCK blocks by hash, and each pair of blocks is one task's
    work. Only the count per vector and pair of blocks comes out.
    """
    sizes = stored(crowds.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    member = points.join(crowds, "id").join(sizes, "component")
    block = F.expr("cast(pmod(xxhash64(id), blocks) as int)")
    each = member.select("component", "id", "unit", "size", "blocks", block.alias("block")).withColumn(
        "with", F.explode(F.expr("sequence(0, blocks - 1)"))
    )
    return (
        each.select(
            "component", "id", "unit", "size", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"),
            F.expr("cast(block > with as int)").alias("side"),
        )
        .groupBy("component", "p", "q")
        .applyInPandas(_block_counts(cosine), "id long, found long")
        .groupBy("id")
        .agg(F.sum("found").alias("found"))
    )


def _foreign_links(points: DataFrame, crowds: DataFrame, lists: DataFrame, keep: int, cosine: float, seed: int) -> DataFrame:
    """Links (a, b) between saturated components, from lists of neighbours in other components only."""
    none = F.expr("cast(array() as array<bigint>)")
    members = stored(points.join(crowds, "id").select("id", "half", "unit", F.col("component").alias("kin")))
    n = members.count()
    own = stored(members.join(lists, "id", "left").select("id", "half", "kin", F.coalesce("known", none).alias("own")))
    foreign = stored(_first_lists(members, n, keep, seed))
    for _ in range(MAX_ROUNDS):
        full = own.join(foreign, "id", "left").withColumn("known", F.coalesce("known", none))
        floor = F.expr(f"case when size(known) >= {keep} then near[{keep - 1}] else cast(-1.0 as float) end").alias("floor")
        sent = full.select(F.explode(F.concat("known", "own", F.array("id"))).alias("at"), "id", "half", floor, "known", "kin")
        found = stored(_meet(sent, keep))
        changed = found.count()
        foreign = stored(_merged(foreign, found, keep))
        if changed <= CHANGE * keep * n:
            break
    return stored(_links(points, foreign, cosine))


def _crowds(groups: DataFrame, lists: DataFrame, keep: int, cosine: float) -> DataFrame:
    """(id, component) of the components with a saturated list: the last of a full one may be a link too."""
    saturated = lists.where(F.expr(f"size(known) >= {keep} and near[{keep - 1}] >= {cosine - SLACK}")).select("id")
    crowded = groups.join(saturated, "id", "left_semi").select("component").distinct()
    return stored(groups.join(crowded, "component", "left_semi"))


def _counted(points: DataFrame, lists: DataFrame, keep: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) links between classes and (id, found) numbers of linked vectors of other classes."""
    links, seed = stored(_links(points, lists, cosine)), 0
    while True:
        groups = stored(common.components(links).select(F.col("node").alias("id"), "component"))
        crowds = _crowds(groups, lists, keep, cosine)
        if crowds.select("component").distinct().limit(2).count() < 2:
            break
        seed += 1
        more = _foreign_links(points, crowds, lists, keep, cosine, seed)
        if more.isEmpty():
            break
        links = stored(links.union(more).distinct())
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    open_ = both.join(crowds.select(F.col("id").alias("a")), "a", "left_anti")
    plain = (
        open_.join(points.select(F.col("id").alias("b"), "size"), "b")
        .groupBy(F.col("a").alias("id"))
        .agg(F.sum("size").alias("found"))
    )
    return groups, stored(plain.union(_crowded_counts(points, crowds, cosine)))


def _audit(points: DataFrame, found: DataFrame, cosine: float) -> float:
    """The share of its links that a vector of a bounded sample was given, on average over its vectors with few links
    or over those with many, whichever is less; 1 where the sample has none.

    At most AUDIT vectors are compared with all others, in batches, on every executor.
    """
    sample = points.orderBy(F.xxhash64("id", F.lit("audit"))).limit(AUDIT).select("id", "unit").collect()
    if not sample:
        return 1.0
    ids = np.array([r.id for r in sample])
    units = [np.frombuffer(r.unit) for r in sample]

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            for width in {len(u) for u in batch["unit"]}:
                rows = batch[batch["unit"].str.len() == width]
                here = [k for k, u in enumerate(units) if 8 * len(u) == width]
                if here:
                    y = np.stack([np.frombuffer(u) for u in rows["unit"]])
                    near = np.stack([units[k] for k in here]) @ y.T >= cosine
                    near &= ids[here][:, None] != rows["id"].to_numpy()[None, :]
                    total[here] += near @ rows["size"].to_numpy()
        yield pd.DataFrame({"id": ids, "expected": total})

    true = points.select("id", "unit", "size").mapInPandas(compared, "id long, expected long").groupBy("id").agg(F.sum("expected").alias("expected"))
    share = F.least("expected", F.coalesce("found", F.lit(0))) / F.col("expected")
    rows = true.where("expected > 0").join(found, "id", "left").groupBy(F.col("expected") > NEIGHBOURS).agg(F.avg(share)).collect()
    return min((r[1] for r in rows), default=1.0)


def near_duplicates(
    spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, neighbours: int = NEIGHBOURS
) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Null, empty and zero vectors and such with null or non-finite components link with nothing, as do
    vectors of different widths with each other. Equal vectors link with each other and share all other
    links. Repeated rows are vectors of their own that share an id; rows with a null id keep a null
    component unless linked. An empty table gives no rows. Other columns are ignored.
    """
    common.prepare(spark)
    rows = stored(vectors.select("vec_id", unit_column("embedding").alias("unit")))
    classes = rows.where("unit is not null").groupBy("unit").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("size")
    )
    # A class is named by its smallest id; classes that share one, or have none, by a hash of the vector.
    numbered = classes.withColumn("n", F.count("*").over(Window.partitionBy("first")))
    points = stored(
        numbered.select(
            F.when((F.col("n") == 1) & F.col("first").isNotNull(), F.col("first")).otherwise(F.xxhash64("unit")).alias("id"),
            "first", "unit", "size", half_column("unit").alias("half"),
        )
    )
    n = points.count()
    keep, lists = neighbours, None
    while True:
        lists = _descent(points, n, keep, lists)
        groups, found = _counted(points, lists, keep, cosine)
        recall = _audit(points, found, cosine)
        if recall >= RECALL or keep >= n:
            break
        if keep >= 8 * neighbours:
            if recall < LEAST_RECALL:
                raise ArithmeticError(f"recall {recall:.3f} with lists of {keep} neighbours")
            warnings.warn(f"recall {recall:.3f} with lists of {keep} neighbours", stacklevel=2)
            break
        keep *= 2
    named = points.select("id", "first", "size", "unit").join(groups, "id", "left").join(found, "id", "left")
    named = named.withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    per_class = stored(
        named.join(least, "component").select("unit", "component_id", (F.coalesce("found", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    )
    return rows.join(per_class, "unit", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
