"""Whitening of embeddings by an incremental eigendecomposition.

Entries become whole numbers, and each different vector is fitted once. Every partition of these keeps the mean,
the eigenvalues and the eigenvectors of its scatter and takes its vectors one by one: a vector's difference from
the mean is a rank-one update, whose new eigenvalues are the roots of the secular equation. Directions that the
update does not touch, and equal eigenvalues, are deflated first. Spectra are combined in groups, level by level,
each eigenpair of one being a rank-one update of the other, and the difference of the means one more. Last,
Rayleigh-Ritz steps: all partitions project the centred vectors on the basis found, the small matrix of their
second moments is diagonalised and the basis turned, until it stays as it is to double precision.

What a task holds or returns is one square matrix of the vectors' width, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.llm import common
from contactmill.session import stored

SCALE = 256
COMPONENTS = 4
#: Spectra that one task combines.
GROUP = 16
#: Relative size below which an update's part along a direction, or a gap of two eigenvalues, is none.
SMALL = 1e-14
#: Largest entry off the diagonal that a finished basis has, as a share of the largest eigenvalue.
TURNED = 1e-13
#: Share of a root by which the last step towards it may move; steps converge at least with the square.
SETTLED = 1e-9
#: Rayleigh-Ritz steps and steps towards a root that are allowed.
STEPS = 12
ROOT_STEPS = 80
SPECTRUM = "n long, mean array<double>, value array<double>, basis array<double>"


def updated(values: np.ndarray, basis: np.ndarray, weight: float, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``basis diag(values) basis' + weight step step'``; values ascend, as do the new ones."""
    z = basis.T @ step
    size = weight * float(z @ z)
    if size <= 0:
        return values, basis
    top = max(float(values[-1]), 0.0) + size
    z = z * np.sqrt(weight)
    # Equal eigenvalues: turn their directions so that the update touches one of them only.
    values, basis = values.copy(), basis.copy()
    touched = np.flatnonzero(np.abs(z) > SMALL * np.sqrt(top))
    for a, b in zip(touched[:-1], touched[1:]):
        if values[b] - values[a] <= SMALL * top:
            r = np.hypot(z[a], z[b])
            c, s = z[b] / r, z[a] / r
            basis[:, a], basis[:, b] = c * basis[:, a] - s * basis[:, b], s * basis[:, a] + c * basis[:, b]
            z[a], z[b] = 0.0, r
    live = np.flatnonzero(np.abs(z) > SMALL * np.sqrt(top))
    if not len(live):
        return values, basis
    d, u = values[live], z[live]
    gaps, offsets = _secular(d, u)
    # Weights for which the roots found are exact make the eigenvectors orthogonal.
    below = d[None, :] - d[:, None]
    np.fill_diagonal(below, 1.0)
    moved = gaps.T  # moved[i, k] = root k - d[i]
    ratio = np.abs(moved) / np.abs(np.where(np.eye(len(d), dtype=bool), 1.0, below))
    exact = np.sqrt(np.prod(ratio, axis=1)) * np.sign(u)
    vectors = exact[:, None] / -moved
    vectors /= np.linalg.norm(vectors, axis=0)
    basis[:, live] = basis[:, live] @ vectors
    values[live] = d + offsets
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


def _secular(d: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(u_i^2 / (d_i - x)) = 0``, root k between d_k and the next one (or the sum of squares above
    the last): rows of root k minus each d_i, and root k minus d_k, both without cancellation.

    Each root is measured from the nearer end of its interval, so that small distances keep their digits, and
    found by safeguarded steps that fit the two poles of the interval.
    """
    squares, n = u * u, len(d)
    ends = np.append(d[1:], d[-1] + squares.sum())
    width = ends - d
    middle = d + width / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        at_middle = 1 + (squares[None, :] / (d[None, :] - middle[:, None])).sum(axis=1)
        # The function rises from -inf to +inf between two poles: positive in the middle means a root in the left half.
        left = (at_middle >= 0) | (np.arange(n) == n - 1)
        origin = np.where(left, d, ends)
        low = np.where(left, 0.0, -width / 2)
        high = np.where(left, np.where(at_middle >= 0, width / 2, width), 0.0)
        low = np.where(left & (at_middle < 0), width / 2, low)
        from_origin = d[None, :] - origin[:, None]
        x = (low + high) / 2
        lower = np.tri(n, dtype=bool)  # poles up to d_k
        for turn in range(ROOT_STEPS):
            far = from_origin - x[:, None]
            terms = squares[None, :] / far
            value = 1 + terms.sum(axis=1)
            low, high = np.where(value < 0, x, low), np.where(value >= 0, x, high)
            slopes = terms / far
            # Fit a constant and the two poles next to the root, with the same slopes on either side.
            p, q = np.diagonal(far), np.append(np.diagonal(far, 1), ends[-1] - origin[-1] - x[-1])
            s, t = np.where(lower, slopes, 0).sum(axis=1), np.where(lower, 0, slopes).sum(axis=1)
            c = value - s * p - t * q
            # c + s p^2 / (p - e) + t q^2 / (q - e) = 0 in the step e.
            b = c * (p + q) + s * p * p + t * q * q
            free = value * p * q
            root = np.sqrt(np.maximum(b * b - 4 * c * free, 0))
            step = np.where(b > 0, 2 * free / (b + root), (b - root) / (2 * c))
            new = np.clip(x + step, low, high)
            # Where the edge is a pole, or a step leads nowhere, the bracket is halved.
            away = (new != x + step) & ((new == x) | (turn % 4 == 3))
            new = np.where((new == 0) | away | ~np.isfinite(new), (low + high) / 2, new)
            done = np.abs(new - x) <= SETTLED * np.abs(new)
            x = new
            if done.all() or (high - low <= 4e-16 * np.maximum(np.abs(low), np.abs(high))).all():
                break
    gaps = x[:, None] - from_origin
    return gaps, np.diagonal(gaps).copy()


class Spectrum:
    """The number, the mean and the eigenpairs of the scatter of some vectors."""

    def __init__(self, n: int, mean: np.ndarray, values: np.ndarray, basis: np.ndarray):
        self.n, self.mean, self.values, self.basis = n, mean, values, basis

    @classmethod
    def none(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width), np.zeros(width), np.eye(width))

    def add(self, x: np.ndarray) -> None:
        """Take one more vector."""
        step = x - self.mean
        self.n += 1
        self.values, self.basis = updated(self.values, self.basis, (self.n - 1) / self.n, step)
        self.mean = self.mean + step / self.n

    def merge(self, other: Spectrum) -> None:
        """Take the vectors of another spectrum."""
        if not other.n or not self.n:
            if other.n:
                self.__init__(other.n, other.mean, other.values, other.basis)
            return
        for value, vector in zip(other.values, other.basis.T):
            if value > 0:
                self.values, self.basis = updated(self.values, self.basis, value, vector)
        step, n = other.mean - self.mean, self.n + other.n
        self.values, self.basis = updated(self.values, self.basis, self.n * other.n / n, step)
        self.mean, self.n = self.mean + step * (other.n / n), n

    def row(self) -> pd.DataFrame:
        each = {"n": [self.n], "mean": [self.mean], "value": [self.values], "basis": [self.basis.ravel()]}
        return pd.DataFrame(each)

    @classmethod
    def of(cls, row) -> Spectrum:
        width = len(row.mean)
        return cls(int(row.n), np.array(row.mean), np.array(row.value), np.array(row.basis).reshape(width, width))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64).reshape(-1, width)


def spectrum(fit: DataFrame, width: int) -> Spectrum:
    """The spectrum of the vectors ``x``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Spectrum.none(width)
        for batch in batches:
            for x in _matrix(batch["x"], width).astype(np.float64):
                own.add(x)
        if own.n:
            yield own.row()

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        own = Spectrum.none(width)
        for row in rows.itertuples():
            own.merge(Spectrum.of(row))
        return own.row()

    parts = stored(fit.select("x").mapInPandas(each, SPECTRUM))
    left = parts.count()
    while left > 1:
        # Rows are dealt out evenly; which spectra meet does not matter.
        left = -(-left // GROUP)
        dealt = parts.select("*", (F.monotonically_increasing_id() % left + F.spark_partition_id() % left).alias("g"))
        dealt = dealt.withColumn("g", F.pmod("g", F.lit(left)))
        parts = stored(dealt.groupBy("g").applyInPandas(lambda rows: together(rows.drop(columns="g")), SPECTRUM))
        left = parts.count()
    return Spectrum.of(parts.first())


def moments(fit: DataFrame, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Mean products of the centred vectors' coordinates in a basis."""
    width, k = basis.shape

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for batch in batches:
            y = (_matrix(batch["x"], width) - mean) @ basis
            total += y.T @ y
        yield pd.DataFrame({"i": np.repeat(np.arange(k), k), "j": np.tile(np.arange(k), k), "s": total.ravel()})

    # A row per pair of directions, added up by tasks.
    sums = fit.select("x").mapInPandas(each, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((k, k))
    for i, j, s in sums.collect():
        out[i, j] = s
    return out


def refined(fit: DataFrame, n: int, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of the covariance, by Rayleigh-Ritz steps from a basis."""
    for _ in range(STEPS):
        basis = np.linalg.qr(basis)[0]
        small = moments(fit, mean, basis) / n
        small = (small + small.T) / 2
        values, turn = np.linalg.eigh(small)
        basis, values = (basis @ turn)[:, ::-1], values[::-1]
        off = np.abs(small - np.diag(np.diagonal(small))).max()
        if off <= TURNED * max(values[0], 0.0):
            return values, basis
    raise ArithmeticError(f"the basis still turns after {STEPS} steps: {off / values[0]}")


def whitened(spark: SparkSession, vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Each row's first whitened components: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are left out. Shorter vectors are read with zeros
    at their end, so all have the width of the longest. Repeated rows and ties are fitted once and returned
    each; null ids stay null. Components without variance (fewer different vectors, constant entries) cannot be
    whitened and give no rows, so a single vector gives none. An empty table gives no rows. Other columns are
    ignored. Eigenvectors of equal eigenvalues are any orthonormal ones. OverflowError where a deviation
    exceeds a long.
    """
    common.prepare(spark)
    raw = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("e"))
    good = raw.where("e is not null and forall(e, c -> c is not null and not isnan(c) and abs(c) < double('inf'))")
    rows = stored(good.select("vec_id", F.expr(f"transform(e, c -> floor({SCALE}D * double(c)))").alias("x")))
    none = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return spark.createDataFrame([], none)
    padded = f"concat(x, array_repeat(0L, {width} - size(x)))"
    fit = stored(rows.select(F.expr(padded).alias("x")).distinct())
    # One row per dimension.
    sums = fit.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(
        F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"), F.max(F.abs("x")).alias("most")
    ).sort("i").collect()
    n, exact, most = sums[0].n, [int(r.s) for r in sums], max(int(r.most) for r in sums)
    if (2 * n * most) ** 2 * width >= 1 << 63:
        # The bound of all deviations does not fit a long, so each is added up with all its digits.
        total = np.array(exact, dtype=object)
    else:
        total = np.array(exact, dtype=np.int64)
    mean = np.array([s / n for s in exact])
    values, basis = refined(fit, n, mean, spectrum(fit, width).basis)
    trace = float(np.clip(values, 0, None).sum())
    k = min(components, int((values > 1e-13 * max(values[0], 0.0)).sum()))
    if values[0] <= 0 or not k:
        return spark.createDataFrame([], none)
    axes = basis[:, :k] / np.sqrt(values[:k])
    centre = moments_mean(fit, mean, axes, n)
    error = float(np.abs(moments(fit, mean, axes) / n - np.outer(centre, centre) - np.eye(k)).max())
    share = values[:k] / trace

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.zeros((len(batch), width), dtype=np.int64)
            for i, entry in enumerate(batch["x"]):
                x[i, : len(entry)] = entry
            far = n * x.astype(total.dtype) - total
            deviation = (far * far).sum(axis=1)
            if len(deviation) and max(deviation) >= 1 << 63:
                raise OverflowError("a deviation exceeds a long")
            yield pd.DataFrame({
                "vec_id": batch["vec_id"].repeat(k).astype("Int64"), "component": np.tile(np.arange(1, k + 1), len(x)), "n": n,
                "deviation": np.repeat(deviation.astype(np.int64), k), "whitened": ((x - mean) @ axes).ravel(),
                "explained": np.tile(share, len(x)), "identity_error": error,
            })

    return rows.mapInPandas(each, none)


def moments_mean(fit: DataFrame, mean: np.ndarray, axes: np.ndarray, n: int) -> np.ndarray:
    """The mean of the whitened vectors."""
    width, k = axes.shape

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(k)
        for batch in batches:
            total += ((_matrix(batch["x"], width) - mean) @ axes).sum(axis=0)
        yield pd.DataFrame({"i": np.arange(k), "s": total})

    sums = fit.select("x").mapInPandas(each, "i int, s double").groupBy("i").agg(F.sum("s").alias("s"))
    found = dict(map(tuple, sums.collect()))
    return np.array([found.get(i, 0.0) / n for i in range(k)])
