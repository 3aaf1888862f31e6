import math

import numpy as np
import pytest

from contactmill.llm import queries, whitening
from tests.llm import cases


def naive(rows, components=4):
    """Every column by numpy's own decomposition of the exact covariance."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    x = np.zeros((len(good), width))
    for k, (_, v) in enumerate(good):
        x[k, : len(v)] = np.floor(256 * np.asarray(v, dtype=float))
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    cov = (fit - sums / n).T @ (fit - sums / n) / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    far = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in x]
    out = {}
    for k in range(components):
        if k < width and values[k] > 1e-12 * values[0] > 0:
            w = (x - sums / n) @ basis[:, k] / np.sqrt(values[k])
            for (i, _), one, deviation in zip(good, w, far):
                out.setdefault((i, k + 1), []).append((n, deviation, one, values[k] / values.sum()))
    return out


def compare(rows, want, closely=1e-9):
    got = {}
    for r in rows:
        assert r.identity_error < 1e-8
        got.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, r.whitened, r.explained))
    assert got.keys() == want.keys()
    signs = {}
    for key in sorted(want, key=repr):
        assert len(got[key]) == len(want[key])
        for a, b in zip(sorted(got[key], key=lambda r: (r[1], abs(r[2]))), sorted(want[key], key=lambda r: (r[1], abs(r[2])))):
            assert a[:2] == b[:2] and a[3] == pytest.approx(b[3], rel=1e-9)
            assert abs(a[2]) == pytest.approx(abs(b[2]), rel=closely, abs=closely)
            if abs(b[2]) > 1e-6:
                assert signs.setdefault(key[1], a[2] * b[2] > 0) == (a[2] * b[2] > 0)


@pytest.mark.parametrize("seed", range(40))
def test_updates_and_merges_equal_the_scatter(seed):
    rng = np.random.default_rng(seed)
    d, n = rng.integers(1, 12), rng.integers(1, 60)
    x = rng.integers(-300, 300, (n, d)).astype(float)
    if seed % 3 == 0:  # dependent directions and equal eigenvalues
        x = x @ rng.integers(-1, 2, (d, d))
    if seed % 5 == 0:
        x = np.concatenate([np.eye(d), -np.eye(d), np.eye(d)]) * 7
    if seed % 7 == 0:
        x[:, 0] = 3
    first, second = whitening.Spectrum.none(d), whitening.Spectrum.none(d)
    for i, row in enumerate(x):
        (second if i % 3 else first).add(row)
    first.merge(second)
    centred = x - x.mean(axis=0)
    want = centred.T @ centred
    top = max(np.abs(want).max(), 1)
    assert first.n == len(x) and np.allclose(first.mean, x.mean(axis=0))
    assert np.abs(first.basis.T @ first.basis - np.eye(d)).max() < 1e-10
    assert np.abs(first.basis @ np.diag(first.values) @ first.basis.T - want).max() < 1e-10 * top
    assert np.all(np.diff(first.values) >= 0)


def test_secular_roots_near_poles_keep_their_digits():
    d, u = np.array([0.0, 1.0, 1.0 + 1e-9, 5.0]), np.array([1e-9, 0.5, 1e-6, 2.0])
    gaps, offsets = whitening._secular(d, u)
    for k in range(4):
        assert offsets[k] > 0 and abs(1 + (u * u / -gaps[k]).sum()) < 1e-6 * (u * u / np.abs(gaps[k])).sum()
    assert (d + offsets).sum() == pytest.approx(d.sum() + (u * u).sum(), rel=1e-14)


def test_query_equals_numpy(spark):
    rows = queries.op13_whitening(spark, cases.folder("sf0.001")).collect()
    table = spark.read.parquet(cases.folder("sf0.001") + "/embeddings.parquet").collect()
    compare(rows, naive([(r.vec_id, r.embedding) for r in table]), closely=1e-8)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 0.5]), (2, [1.0, None, 0.5]), (3, None), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, [-0.0, 0.0, 0.0]),
        (7, []), (7, [1.0, 2.0, 0.5]), (7, [1.0, 2.0, 0.5]), (None, [-3.25, 0.1, 9.0]), (8, [1.0, 2.0]), (9, [4.0, -4.0, 0.25]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as x", "2 as n", "3 as component")
    want = naive([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows])
    compare(whitening.whitened(spark, frame).collect(), want)


def test_tables_without_variance_give_no_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]):
        assert whitening.whitened(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() == []


def test_deviations_beyond_a_long_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1e9, 3.0]), (2, [-1e9, 5.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceeds a long"):
        whitening.whitened(spark, rows).collect()
