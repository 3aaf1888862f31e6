import numpy as np
from pyspark.sql import types as T

from contactmill.llm import embedding_dedup as emb
from tests.llm import cases

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("unit", T.StringType()),
])


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def naive(rows):
    units = []
    for _, v in rows:
        x = None if v is None or any(c is None for c in v) else np.array(v, dtype=np.float32).astype(float)
        good = x is not None and len(x) and np.isfinite(x).all() and np.abs(x).max() > 0
        units.append(x / np.linalg.norm(x) if good else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.95] for i in range(n)]
    part = list(range(n))
    for i in range(n):
        todo, seen = [i], {i}
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        part[i] = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
    return cases.ordered((rows[i][0], len(near[i]), part[i], rows[i][0] == part[i]) for i in range(n))


def check(spark, rows, **settings):
    have = emb.near_duplicates(spark, table(spark, rows), **settings).collect()
    assert cases.ordered(have) == naive(rows)


def floats(x):
    return [float(v) for v in np.asarray(x, dtype=np.float32)]


def test_awkward_vectors(spark):
    base = [1.0, 2.0, -1.0, 0.5]
    rows = [
        (1, base), (2, [2 * x for x in base]), (3, None), (4, [0.0] * 4), (5, [float("nan"), 1.0, 0.0, 0.0]),
        (6, [1.0, None, 0.0, 0.0]), (7, []), (8, [1.0, 2.0, -1.0]), (9, [1.0, 2.0, -1.0, 0.6]), (9, [1.0, 2.0, -1.0, 0.6]),
        (10, [-1.0, -2.0, 1.0, -0.5]), (11, [float("inf"), 1.0, 0.0, 0.0]), (None, [9.0, 0.0, 0.0, 0.0]), (None, None),
    ]
    check(spark, rows)
    assert emb.near_duplicates(spark, table(spark, [])).collect() == []
    check(spark, rows[2:7])


def test_crowds_pairs_and_strays(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 32))
    vectors = [rng.normal(size=32) for _ in range(400)]
    # One crowd beyond every list, one that is loose enough for links to miss pairs, small groups and copies.
    vectors += [centres[0] + 0.05 * rng.normal(size=32) for _ in range(300)]
    vectors += [centres[1] + 0.16 * rng.normal(size=32) for _ in range(60)]
    vectors += [centres[2] + 0.05 * rng.normal(size=32) for _ in range(3)]
    vectors += [centres[3]] * 50
    check(spark, [(1000 + 7 * i, floats(v)) for i, v in enumerate(vectors)])


def test_links_between_saturated_groups(spark):
    """Two groups far denser than the gap between them, which is within reach, and a third beyond it."""
    rng = np.random.default_rng(9)
    one, aside, beyond = np.linalg.qr(rng.normal(size=(32, 3)))[0].T
    centres = [one, 0.968 * one + np.sqrt(1 - 0.968**2) * aside, 0.9 * one - np.sqrt(1 - 0.9**2) * beyond]
    vectors = [c + 0.001 * rng.normal(size=32) for c in centres for _ in range(150)] + [rng.normal(size=32) for _ in range(200)]
    rows = [(5 * i, floats(v)) for i, v in enumerate(vectors)]
    want = naive(rows)
    assert sum(r[1] == 299 for r in want) == 300
    assert cases.ordered(emb.near_duplicates(spark, table(spark, rows)).collect()) == want


def test_whole_table(spark):
    rows = spark.read.parquet(f"{cases.folder()}/embeddings.parquet")
    want = naive([(r.vec_id, list(r.embedding)) for r in rows.collect()])
    assert cases.ordered(emb.near_duplicates(spark, rows).collect()) == want


def test_audit_sees_missing_links(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=16)
    rows = [(i, (v + 0.02 * rng.normal(size=16))) for i in range(20)]
    units = [(i, bytearray((x / np.linalg.norm(x)).tobytes()), 1) for i, x in rows]
    points = spark.createDataFrame(units, "id long, unit binary, size long")
    none = spark.createDataFrame([], "id long, found long")
    assert emb._audit(points, none, 0.95) == 0
    full = spark.createDataFrame([(i, 19) for i in range(20)], "id long, found long")
    assert emb._audit(points, full, 0.95) == 1
    # Lost pairs are seen beside a large group that is found whole.
    pairs = [100 + i for i in range(10)]
    lone = rng.normal(size=(5, 16)).repeat(2, axis=0) + 0.01 * rng.normal(size=(10, 16))
    units += [(i, bytearray((x / np.linalg.norm(x)).tobytes()), 1) for i, x in zip(pairs, lone)]
    points = spark.createDataFrame(units, "id long, unit binary, size long")
    assert emb._audit(points, full, 0.95) == 0
