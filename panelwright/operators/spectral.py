"""Eigenpairs and linear systems of the sample covariance, from the return panel itself.

With the centred returns X (dates by assets) the covariance is X'X / (T - 1). Nothing of the size
of the assets squared is built, and nothing of the size of the assets leaves the tasks: blocks of
vectors over the dates are multiplied by XX' in one pass over the assets' series, whose partial
sums have a row per date. The driver holds dates-by-vectors matrices, bounded by the calendar.

A panel with gaps has no such X: its pairwise-complete covariance is a table of pairs, and ``lanczos``
multiplies that with one vector over the assets at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.errors import DataError
from panelwright.functions.dist import attach_one, by_calendar
from panelwright.session import cut

BLOCK = 32  # vectors that one pass multiplies


def _series(column) -> np.ndarray:
    """A column of equally long arrays as a matrix, one row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class PanelGram:
    """The centred returns of complete dates: a row (ticker, x) per asset, x in the order of the dates."""

    def __init__(self, returns: DataFrame):
        cells = returns.where(F.col("r").isNotNull()).select("date", "ticker", F.col("r").cast("double").alias("r"))
        n = cells.agg(F.count_distinct("ticker").alias("_n"))
        per_date = attach_one(cells.groupBy("date").agg(F.count(F.lit(1)).alias("_c")), n).where("_c = _n").select("date")
        days = [row["date"] for row in per_date.orderBy("date").collect()]  # bounded by the calendar
        self.t = len(days)
        if self.t < 2:
            raise DataError("need at least 2 complete dates")
        whole = cells.join(by_calendar(per_date, ["date"]), "date")
        rows = whole.groupBy("ticker").agg(F.avg("r").alias("m"), F.sort_array(F.collect_list(F.struct("date", "r"))).alias("c"))
        self.rows = cut(rows.select("ticker", "m", F.transform("c", lambda v: v["r"] - F.col("m")).alias("x")))
        sums = self.rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("square")).first()
        self.n, self.trace = sums["n"], sums["square"] / (self.t - 1)

    def _summed(self, partial, columns: list[str]) -> np.ndarray:
        """Sum over the assets of ``partial(x, m)``, a matrix with a row per date for every batch of assets."""
        t = self.t
        names = ["t", *columns]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((t, len(columns)))
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    total += partial(_series(part.column("x")), part.column("m").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(t, dtype=np.int32)), *(pa.array(c) for c in total.T)], names=names)

        made = self.rows.select("x", "m").mapInArrow(run, "t int, " + ", ".join(f"{c} double" for c in columns))
        found = np.zeros((t, len(columns)))
        for row in made.groupBy("t").agg(*[F.sum(c).alias(c) for c in columns]).collect():
            found[row["t"]] = row[1:]
        return found

    def apply(self, w: np.ndarray) -> np.ndarray:
        """XX'w for a block of vectors over the dates."""
        shared = self.rows.sparkSession.sparkContext.broadcast(w)
        return self._summed(lambda x, m: x.T @ (x @ shared.value), [f"y{i}" for i in range(w.shape[1])])

    def means_and_ones(self) -> np.ndarray:
        """X times the assets' means, and X times ones."""
        return self._summed(lambda x, m: np.column_stack((x.T @ m, x.sum(axis=0))), ["mean", "one"])

    def loadings(self, u: np.ndarray) -> DataFrame:
        """(ticker, k, value): X'u, a row per asset and column of u."""
        shared = self.rows.sparkSession.sparkContext.broadcast(u)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    got = _series(part.column("x")) @ shared.value
                    k = got.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("ticker").take(pa.array(np.repeat(np.arange(len(got)), k))), pa.array(np.tile(np.arange(k, dtype=np.int32), len(got))), pa.array(got.ravel())],
                        names=["ticker", "k", "value"])

        return self.rows.select("ticker", "x").mapInArrow(run, "ticker string, k int, value double")


def _orthonormal(w: np.ndarray, basis: np.ndarray, scale: float) -> np.ndarray:
    """What of w is not in the span of the basis; directions that are lost in rounding go."""
    for _ in range(2):
        w = w - basis @ (basis.T @ w)
    u, s, _ = np.linalg.svd(w, full_matrices=False)
    u = u[:, s > 1e-11 * scale]
    u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


class Spectrum:
    """Leading eigenpairs by block iteration: ``values`` (falling) and vectors over the dates."""

    def __init__(self, gram: PanelGram, wanted=None, above: float | None = None, block: int = BLOCK, tolerance: float = 1e-10, max_passes: int = 200):
        """The first ``wanted`` pairs, or all whose value is above ``above``.

        Every pass multiplies a new block, orthogonal to all before. The space then found holds the
        best approximations (Ritz pairs); a pair is done when its residual is below ``tolerance`` times
        the largest value. No more blocks than dates are needed; a pair that is not done after
        ``max_passes`` raises ``DataError``.
        """
        t, scale = gram.t, gram.t - 1
        rng = np.random.default_rng(1)
        new = np.linalg.qr(rng.standard_normal((t, min(block, t))))[0]
        basis, image = np.zeros((t, 0)), np.zeros((t, 0))
        for _ in range(max_passes):
            got = gram.apply(new) / scale
            basis, image = np.hstack((basis, new)), np.hstack((image, got))
            values, turn = np.linalg.eigh(basis.T @ image)
            values, turn = values[::-1], turn[:, ::-1]
            pairs = basis @ turn
            residual = np.linalg.norm(image @ turn - pairs * values, axis=0)
            top = max(values[0], 0.0)
            # one below the limit must be done too, or a larger value might still be hidden
            k = int((values + residual > above).sum()) + 1 if above is not None else wanted
            k = min(k, len(values))
            new = _orthonormal(got, basis, top if top > 0 else 1.0)
            done = not new.shape[1] or (residual[:k] <= tolerance * top).all()
            if done:
                break
        else:
            raise DataError(f"{k} eigenpairs are not found after {max_passes} passes; largest residual {residual[:k].max():.2g}")
        k = int((values > above).sum()) if above is not None else min(wanted, len(values))
        self.values, self.vectors, self._gram = values[:k], pairs[:, :k], gram

    def asset_vectors(self, factors: np.ndarray | None = None) -> DataFrame:
        """(ticker, k, value): unit eigenvectors over the assets, each times its factor."""
        size = np.sqrt(np.maximum(self.values, 1e-300) * (self._gram.t - 1))
        return self._gram.loadings(self.vectors / size * (1.0 if factors is None else factors))


def inverse_products(gram: PanelGram, block: int = BLOCK, tolerance: float = 1e-11, max_passes: int = 200) -> dict[str, float]:
    """mm, m1, one: mu'C^-1 mu, mu'C^-1 1 and 1'C^-1 1 for the means mu and the covariance C.

    For y over the dates with X'y = b and y in the span of X, b'C^-1 b is (T - 1) y'y; y solves
    XX'y = Xb. Both right-hand sides are solved in the space of a growing orthonormal basis, one
    block and one pass over the panel at a time, until the residuals are below ``tolerance`` of the
    right-hand sides. Raises ``DataError`` after ``max_passes``, and when C is singular, as then no
    such y exists.
    """
    xs = gram.means_and_ones()
    row = gram.rows.agg(F.sum(F.col("m") * F.col("m")).alias("mm")).first()
    rng = np.random.default_rng(1)
    start = np.hstack((xs, gram.apply(rng.standard_normal((gram.t, min(block, gram.t))))))
    new = _orthonormal(start / np.maximum(np.linalg.norm(start, axis=0), 1e-300), np.zeros((gram.t, 0)), 1.0)
    basis, image = np.zeros((gram.t, 0)), np.zeros((gram.t, 0))
    for _ in range(max_passes):
        got = gram.apply(new)
        basis, image = np.hstack((basis, new)), np.hstack((image, got))
        try:
            y = basis @ np.linalg.solve(basis.T @ image, basis.T @ xs)
        except np.linalg.LinAlgError as e:
            raise DataError("the covariance is singular") from e
        left = xs - image @ (basis.T @ y)
        new = _orthonormal(got, basis, np.linalg.norm(got, 2))
        if not new.shape[1] or (np.linalg.norm(left, axis=0) <= tolerance * np.linalg.norm(xs, axis=0)).all():
            break
    else:
        raise DataError(f"the system is not solved after {max_passes} passes")
    # X'y must be the means and the ones themselves
    back = y * (xs - left)
    for j, size in ((0, row["mm"]), (1, float(gram.n))):
        if size - 2 * y[:, j] @ xs[:, j] + back[:, j].sum() > 1e-6 * size:
            raise DataError("the covariance is singular")
    products = y.T @ y * (gram.t - 1)
    return {"mm": products[0, 0], "m1": products[0, 1], "one": products[1, 1]}


def lanczos(cov: DataFrame, start: DataFrame, done, max_steps: int = 200) -> tuple[np.ndarray, float]:
    """(T, size): the pair table ``cov`` (asset_i, asset_j, cov) in an orthonormal basis of the powers of cov on ``start``, and the size of ``start``.

    ``start`` is (asset, x). T grows by one row and column and one pass over the pairs per step, until
    ``done(T, b)`` is true, b being the size of what the next vector adds, or nothing is added.
    Vectors over the assets stay tables, each made orthogonal to all before twice. Raises
    ``DataError`` after ``max_steps``.
    """
    size = float(start.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0])
    t = np.zeros((0, 0))
    if size == 0.0:
        return t, size
    basis = start.select("asset", F.array(F.col("x") / size).alias("q"))
    for k in range(max_steps):
        basis = cut(basis)
        last = basis.select(F.col("asset").alias("asset_j"), F.element_at("q", -1).alias("_x"))
        image = cov.join(last, "asset_j").groupBy(F.col("asset_i").alias("asset")).agg(F.sum(F.col("cov") * F.col("_x")).alias("y"))
        rows = cut(basis.join(image, "asset"))
        parts = [0.0] * (k + 1)
        for _ in range(2):
            found = rows.agg(*[F.sum(F.col("q")[i] * F.col("y")).alias(f"c{i}") for i in range(k + 1)], F.sum(F.col("y") * F.col("y")).alias("yy")).first()
            for i in range(k + 1):
                parts[i] += found[i]
            shadow = F.aggregate(F.zip_with("q", F.array(*[F.lit(float(found[i])) for i in range(k + 1)]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            rows = rows.withColumn("y", F.col("y") - shadow)
        b = float(np.sqrt(max(found["yy"] - sum(found[i] ** 2 for i in range(k + 1)), 0.0)))
        t = np.pad(t, (0, 1))
        t[k, k] = parts[k]
        if k:
            t[k, k - 1] = t[k - 1, k] = before
        if b <= 1e-12 * np.abs(t).max() or done(t, b):
            return t, size
        before = b
        basis = rows.select("asset", F.concat("q", F.array(F.col("y") / b)).alias("q"))
    raise DataError(f"the covariance is not resolved after {max_steps} steps")


def largest_eigenvalue(cov: DataFrame, tolerance: float = 1e-11) -> float:
    """Largest eigenvalue of a pair table, to ``tolerance`` of itself."""
    noise = F.pmod(F.xxhash64("asset"), F.lit(2_000_003)) / 1_000_001.0 - 1.0
    start = cov.select(F.col("asset_i").alias("asset")).distinct().withColumn("x", noise)

    def done(t: np.ndarray, b: float) -> bool:
        values, turn = np.linalg.eigh(t)
        return b * abs(turn[-1, -1]) <= tolerance * abs(values[-1])

    t, _ = lanczos(cov, start, done)
    return float(np.linalg.eigvalsh(t)[-1])


def inverse_product(cov: DataFrame, vector: DataFrame, tolerance: float = 1e-11) -> float:
    """b'C^-1 b for a pair table C and ``vector`` (asset, x); the system is solved to ``tolerance`` of b. Raises ``DataError`` where C is singular."""

    def solved(t: np.ndarray) -> np.ndarray:
        if np.linalg.cond(t) > 1e12:
            raise DataError("the covariance is singular")
        return np.linalg.solve(t, np.eye(len(t))[0])

    def done(t: np.ndarray, b: float) -> bool:
        return np.linalg.cond(t) < 1e12 and b * abs(solved(t)[-1]) <= tolerance

    t, size = lanczos(cov, vector, done)
    return size * size * float(solved(t)[0]) if len(t) else 0.0
