"""Weights without a solver: simple rules, scored candidate tables, robust scores, distances."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from panelwright.errors import ConfigurationError
from panelwright.functions.dist import attach_one, group_quantiles
from panelwright.functions.pairs import _matrix, asset_axis, blocked_pairs, pair_sums, pair_tasks, tiles, with_moments
from panelwright.operators.risk import MEASURES, portfolio_returns, risk_table
from panelwright.sources.panel import date_axis


def equal_weight(returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    names = returns.select(*keys, F.col("ticker").alias("asset")).distinct()
    n = names.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows = names.join(n, list(keys)) if keys else attach_one(names, n)
    return rows.select(*keys, "asset", (1.0 / F.col("n")).alias("w"))


def inverse_volatility(returns: DataFrame, keys: Sequence[str] = (), power: float = 1.0) -> DataFrame:
    """Weights proportional to sd^-power."""
    sd = returns.groupBy(*keys, F.col("ticker").alias("asset")).agg(F.stddev_samp("r").alias("sd"))
    inv = sd.withColumn("inv", F.pow(F.try_divide(F.lit(1.0), F.col("sd")), F.lit(float(power))))
    total = inv.groupBy(*keys).agg(F.sum("inv").alias("t"))
    rows = inv.join(total, list(keys)) if keys else attach_one(inv, total)
    return rows.select(*keys, "asset", (F.col("inv") / F.col("t")).alias("w"))


def candidates(assets: DataFrame, n: int, seed: int = 1, lower: float = 0.0, upper: float = 1.0) -> DataFrame:
    """(portfolio, asset, w): n seeded long-only weight vectors that sum to 1 inside the box.

    Raw draws are whole-number arithmetic of (portfolio, asset position, seed), so any
    engine repeats them. Portfolios that leave the box after scaling are dropped.
    """
    pos = asset_axis(assets.select(F.col("asset").alias("ticker")))
    rows = pos.select(F.col("ticker").alias("asset"), "pos", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("portfolio"))
    x = (F.col("portfolio").cast("long") * 7919 + F.col("pos") * 104729 + seed * 15485863) % 1000003
    raw = rows.select("portfolio", "asset", (((x * x) % 999983) % 1000 + 1).alias("raw"))
    total = raw.groupBy("portfolio").agg(F.sum("raw").alias("t"), F.max("raw").alias("hi"), F.min("raw").alias("lo"))
    inside = (F.col("hi") / F.col("t") <= upper) & (F.col("lo") / F.col("t") >= lower)
    return raw.join(total.where(inside), "portfolio").select("portfolio", "asset", (F.col("raw") / F.col("t")).alias("w"))


@dataclass(frozen=True)
class Objective:
    """min_risk, max_return, max_utility or max_ratio with costs, fees and penalties."""

    kind: str = "min_risk"
    measure: str = "variance"
    risk_aversion: float = 1.0
    risk_free: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    cost: float = 0.0
    fee: float = 0.0

    def __post_init__(self) -> None:
        if self.kind not in ("min_risk", "max_return", "max_utility", "max_ratio"):
            raise ConfigurationError(f"unknown objective {self.kind!r}")
        if self.measure not in MEASURES:
            raise ConfigurationError(f"unknown measure {self.measure!r}")


def score_candidates(
    returns: DataFrame,
    weights: DataFrame,
    objective: Objective,
    previous: DataFrame | None = None,
    exposures: DataFrame | None = None,
    bounds: dict[str, tuple[float, float]] | None = None,
    benchmark: DataFrame | None = None,
    max_tracking_error: float | None = None,
) -> DataFrame:
    """(portfolio, mean, risk, score) of the candidates that meet the bounds."""
    o = objective
    rows = portfolio_returns(returns, weights)
    risks = risk_table(rows).select("portfolio", "mean", F.col(o.measure).alias("risk"))
    shape = weights.groupBy("portfolio").agg(F.sum(F.abs("w")).alias("n1"), F.sum(F.col("w") * F.col("w")).alias("n2"))
    if previous is not None and o.cost:
        prev = previous.select("asset", F.col("w").alias("p"))
        held = prev.agg(F.sum(F.abs("p")).alias("all"))
        # |w - p| over held and new names: names outside the candidate pay their full previous weight.
        move = weights.join(prev, "asset", "left").groupBy("portfolio").agg(
            F.sum(F.abs(F.col("w") - F.coalesce("p", F.lit(0.0)))).alias("in"), F.sum(F.abs(F.coalesce("p", F.lit(0.0)))).alias("seen")
        )
        moved = attach_one(move, held).select("portfolio", (F.col("in") + F.col("all") - F.col("seen")).alias("moved"))
        shape = shape.join(moved, "portfolio")
    else:
        shape = shape.withColumn("moved", F.lit(0.0))
    t = risks.join(shape, "portfolio")
    net = F.col("mean") - o.cost * F.col("moved") - o.fee * F.col("n1")
    penalty = o.l1 * F.col("n1") + o.l2 * F.col("n2")
    score = {
        "min_risk": -F.col("risk"),
        "max_return": net,
        "max_utility": net - o.risk_aversion * F.col("risk"),
        "max_ratio": F.try_divide(net - o.risk_free, F.col("risk")),
    }[o.kind] - penalty
    t = t.select("portfolio", F.col("mean"), "risk", score.alias("score"))
    if exposures is not None and bounds:
        from panelwright.operators.alpha import exposure_check

        ok = exposure_check(exposures, bounds, weights).groupBy("portfolio").agg(F.bool_and("feasible").alias("ok")).where("ok")
        t = t.join(ok.select("portfolio"), "portfolio", "left_semi")
    if benchmark is not None and max_tracking_error is not None:
        te = tracking_errors(rows, benchmark).where(F.col("tracking_error") <= max_tracking_error)
        t = t.join(te.select("portfolio"), "portfolio", "left_semi")
    return t


def best_candidate(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights of the best score; the lowest portfolio number of equals."""
    best = scored.agg(F.max_by("portfolio", F.struct(F.round("score", 12).alias("s"), (-F.col("portfolio")).alias("p"))).alias("best"))
    return attach_one(weights, best).where(F.col("portfolio") == F.col("best")).select("portfolio", "asset", "w")


def frontier(scored: DataFrame, buckets: int = 10) -> DataFrame:
    """Lowest risk per bucket of equal width over the mean."""
    span = scored.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    rows = attach_one(scored, span)
    width = (F.col("hi") - F.col("lo")) / buckets
    bucket = F.least(F.lit(buckets - 1), F.floor(F.coalesce(F.try_divide(F.col("mean") - F.col("lo"), width), F.lit(0.0)))).cast("int")
    return rows.groupBy(bucket.alias("bucket")).agg(
        F.min_by(F.struct("portfolio", "mean", "risk"), F.struct(F.round("risk", 12).alias("r"), "portfolio")).alias("b")
    ).select("bucket", "b.portfolio", "b.mean", "b.risk")


def tracking_errors(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Deviation of portfolio minus benchmark return; ``benchmark`` is (date, b)."""
    return rows.join(benchmark, "date").groupBy("portfolio").agg(F.stddev_samp(F.col("r") - F.col("b")).alias("tracking_error"))


def best_tracker(returns: DataFrame, weights: DataFrame, benchmark: DataFrame) -> DataFrame:
    te = tracking_errors(portfolio_returns(returns, weights), benchmark)
    scored = te.select("portfolio", (-F.col("tracking_error")).alias("score"))
    return best_candidate(scored, weights)


def robust_scores(
    returns: DataFrame, weights: DataFrame, kappa: float = 1.645, epsilon: float = 0.001, beta: float = 0.95
) -> DataFrame:
    """Worst-case mean mu'w - kappa * sqrt(sum(w^2 var) / T) and worst-case CVaR + eps / (1 - beta) * |w|."""
    t = returns.agg(F.count_distinct("date").alias("t"))
    stats = returns.groupBy(F.col("ticker").alias("asset")).agg(F.avg("r").alias("mu"), F.var_samp("r").alias("var"))
    rows = attach_one(weights.join(stats, "asset"), t)
    means = rows.groupBy("portfolio").agg(
        (F.sum(F.col("w") * F.col("mu")) - kappa * F.sqrt(F.sum(F.col("w") * F.col("w") * F.col("var")) / F.max("t"))).alias("worst_mean"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
    )
    tails = risk_table(portfolio_returns(returns, weights), beta=beta).select("portfolio", "cvar")
    return means.join(tails, "portfolio").select(
        "portfolio", "worst_mean", (F.col("cvar") + epsilon / (1 - beta) * F.col("norm")).alias("worst_cvar")
    )


# Bootstrap


def bootstrap_counts(dates: DataFrame, replicates: int, block: int, seed: int = 1) -> DataFrame:
    """(replicate, idx, c): how often a stationary bootstrap resample of length T takes each date.

    Position t starts a new block when its hash falls in 1 of ``block``, at a hashed
    date; between starts the dates run on and wrap around. Whole-number arithmetic only.
    """
    size = dates.agg(F.max("idx").alias("t"))
    pos = attach_one(dates.select("idx"), size).select(
        F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"), (F.col("idx") - 1).alias("k"), "t"
    )
    h = lambda a, b: ((F.col("replicate").cast("long") * a + F.col("k") * b + seed * 15485863) % 1000003)
    mix = lambda x: (x * x) % 999983
    fresh = (F.col("k") == 0) | (mix(h(7919, 104729)) % block == 0)
    w = Window.partitionBy("replicate").orderBy("k")
    start = F.last(F.when(fresh, F.struct(F.col("k").alias("at"), (mix(h(6151, 49157)) % F.col("t")).alias("from"))), ignorenulls=True).over(w)
    rows = pos.withColumn("s", start)
    idx = (F.col("s.from") + F.col("k") - F.col("s.at")) % F.col("t") + 1
    return rows.groupBy("replicate", idx.alias("idx")).agg(F.count(F.lit(1)).alias("c"))


def bootstrap_distances(returns: DataFrame, replicates: int = 500, block: int = 21, seed: int = 1) -> DataFrame:
    """(replicate, distance): Frobenius distance of each resample's covariance to the sample covariance.

    A resample is a vector of date counts, so its covariance is a weighted product.
    Tasks take one pair of asset blocks and a group of replicates; their partial
    sums of squares are added. The panel must be complete.
    """
    axis = date_axis(returns)
    group = F.floor(F.col("replicate") / 50).cast("int")
    counts = (
        bootstrap_counts(axis, replicates, block, seed)
        .groupBy("replicate").agg(F.collect_list("idx").alias("i"), F.collect_list("c").alias("c"))
        .groupBy(group.alias("group")).agg(F.collect_list(F.struct("replicate", "i", "c")).alias("cs"))
    )
    counts = counts.select("group", F.col("cs.replicate").alias("replicate"), F.col("cs.i").alias("at"), F.col("cs.c").alias("c"))
    groups = F.sequence(F.lit(0), F.lit(replicates // 50))
    tasks = pair_tasks(returns, "r").withColumn("group", F.explode(groups)).join(counts, "group")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                width = int(np.max(row.t1)) + 1
                x1, _ = _matrix(row.a1, row.t1, row.v1, len(row.names1), 0, width)
                same = row.i == row.j
                x2 = x1 if same else _matrix(row.a2, row.t2, row.v2, len(row.names2), 0, width)[0]
                out = np.zeros(len(row.at))
                for a, b, diagonal in tiles(len(x1), len(x2), same):
                    base = _weighted_cov(x1[a], x2[b], np.ones(width))
                    for k, (at, c) in enumerate(zip(row.at, row.c)):
                        w = np.zeros(width)
                        w[np.asarray(at) - 1] = c
                        gap = _weighted_cov(x1[a], x2[b], w) - base
                        out[k] += float((gap * gap).sum()) * (1.0 if diagonal else 2.0)
                yield pd.DataFrame({"replicate": np.asarray(row.replicate), "sq": out})

    parts = tasks.mapInPandas(run, "replicate long, sq double")
    return parts.groupBy("replicate").agg(F.sqrt(F.sum("sq")).alias("distance"))


def _weighted_cov(x1: np.ndarray, x2: np.ndarray, w: np.ndarray) -> np.ndarray:
    n = w.sum()
    m1, m2 = x1 @ w / n, x2 @ w / n
    return ((x1 * w) @ x2.T - n * np.outer(m1, m2)) / (n - 1)


def bootstrap_radius(returns: DataFrame, replicates: int = 500, block: int = 21, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """One row: the (1 - alpha) quantile of the bootstrap distances."""
    d = bootstrap_distances(returns, replicates, block, seed)
    return group_quantiles(d.withColumn("k", F.lit(1)), ["k"], "distance", {"delta": 1 - alpha}).select("delta")


# Distances


def _kendall_kernel(x1, m1, x2, m2):
    s12 = np.zeros((len(x1), len(x2)))
    n1, n2 = np.zeros_like(s12), np.zeros_like(s12)
    for t in range(x1.shape[1] - 1):
        both1 = m1[:, t : t + 1] * m1[:, t + 1 :]
        both2 = m2[:, t : t + 1] * m2[:, t + 1 :]
        a = np.sign(x1[:, t + 1 :] - x1[:, t : t + 1]) * both1
        b = np.sign(x2[:, t + 1 :] - x2[:, t : t + 1]) * both2
        s12 += a @ b.T
        n1 += np.abs(a) @ both2.T
        n2 += both1 @ np.abs(b).T
    with np.errstate(invalid="ignore", divide="ignore"):
        return {"kendall": s12 / np.sqrt(n1 * n2)}


def _centred_rows(x):
    """Row means and the grand mean of each asset's |x_t - x_u| matrix."""
    n = x.shape[1]
    rows = np.empty_like(x)
    for t in range(n):
        rows[:, t] = np.abs(x - x[:, t : t + 1]).mean(axis=1)
    return rows, rows.mean(axis=1)


def _dcor_kernel(x1, m1, x2, m2):
    n = x1.shape[1]
    (r1, g1), (r2, g2) = _centred_rows(x1), _centred_rows(x2)
    v12 = np.zeros((len(x1), len(x2)))
    v1, v2 = np.zeros(len(x1)), np.zeros(len(x2))
    for t in range(n):
        a = np.abs(x1 - x1[:, t : t + 1]) - r1 - r1[:, t : t + 1] + g1[:, None]
        b = np.abs(x2 - x2[:, t : t + 1]) - r2 - r2[:, t : t + 1] + g2[:, None]
        v12 += a @ b.T
        v1 += (a * a).sum(axis=1)
        v2 += (b * b).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return {"distance_correlation": np.sqrt(np.clip(v12, 0, None) / np.sqrt(np.outer(v1, v2)))}


def _information_kernel(bins: int):
    def kernel(x1, m1, x2, m2):
        def onehot(x, m):
            lo, hi = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
            width = np.where(hi > lo, (hi - lo) / bins, 1.0)
            b = np.clip(np.floor((x - lo) / width), 0, bins - 1)
            return [(b == k) * m for k in range(bins)]

        h1, h2 = onehot(x1, m1), onehot(x2, m2)
        n = m1 @ m2.T
        info = np.zeros_like(n)
        joint = np.zeros_like(n)
        p1 = [a @ m2.T / n for a in h1]
        p2 = [m1 @ b.T / n for b in h2]
        for i, a in enumerate(h1):
            for j, b in enumerate(h2):
                p = a @ b.T / n
                with np.errstate(divide="ignore", invalid="ignore"):
                    info += np.where(p > 0, p * np.log(p / (p1[i] * p2[j])), 0.0)
                    joint -= np.where(p > 0, p * np.log(p), 0.0)
        return {"information": info, "joint_entropy": joint}

    return kernel


def distance_table(returns: DataFrame, method: str, bins: int = 10) -> DataFrame:
    """(asset_i, asset_j, codependence, distance) for i <= j by one of six methods."""
    from panelwright.functions.dist import with_average_rank

    rows = returns.where(F.col("r").isNotNull()).select("date", "ticker", "r")
    half = lambda c: F.sqrt(F.greatest(0.5 * (1 - c), F.lit(0.0)))
    if method in ("pearson", "spearman", "covariance"):
        if method == "spearman":
            rows = with_average_rank(rows, ["ticker"], "r", "rk").select("date", "ticker", F.col("rk").alias("r"))
        m = with_moments(pair_sums(rows))
        dep = F.col("cov" if method == "covariance" else "corr")
        return m.select("asset_i", "asset_j", dep.alias("codependence"), half(F.col("corr")).alias("distance"))
    if method == "kendall":
        m = blocked_pairs(rows, _kendall_kernel, ["kendall"], chunk=None)
        return m.select("asset_i", "asset_j", F.col("kendall").alias("codependence"), half(F.col("kendall")).alias("distance"))
    if method == "distance_correlation":
        m = blocked_pairs(rows, _dcor_kernel, ["distance_correlation"], chunk=None)
        c = F.col("distance_correlation")
        return m.select("asset_i", "asset_j", c.alias("codependence"), F.sqrt(F.greatest(1 - c, F.lit(0.0))).alias("distance"))
    if method == "mutual_information":
        m = blocked_pairs(rows, _information_kernel(bins), ["information", "joint_entropy"], chunk=None)
        gap = F.coalesce(F.try_divide(F.col("joint_entropy") - F.col("information"), F.col("joint_entropy")), F.lit(0.0))
        return m.select("asset_i", "asset_j", F.col("information").alias("codependence"), F.greatest(gap, F.lit(0.0)).alias("distance"))
    raise ConfigurationError(f"unknown distance {method!r}")


def compose(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Final weight = outer weight * inner weight, added over the portfolios that hold the asset.

    ``inner`` is (portfolio, asset, w), ``outer`` (portfolio, v).
    """
    return inner.join(outer.select("portfolio", "v"), "portfolio").groupBy("asset").agg(F.sum(F.col("w") * F.col("v")).alias("w"))


def nested_weights(returns: DataFrame, clusters: DataFrame, power: float = 1.0) -> DataFrame:
    """Weights by sd^-power inside clusters, then over the clusters' own return series."""
    rows = returns.join(clusters.select("ticker", "cluster"), "ticker")
    inner = inverse_volatility(rows, ["cluster"], power).withColumnRenamed("cluster", "portfolio")
    series = portfolio_returns(returns, inner).withColumnRenamed("portfolio", "ticker")
    outer = inverse_volatility(series, power=power).select(F.col("asset").alias("portfolio"), F.col("w").alias("v"))
    return compose(inner, outer)


def stacked_weights(returns: DataFrame, models: DataFrame) -> DataFrame:
    """Equal and inverse-volatility style models (portfolio, asset, w) as assets of an outer inverse-volatility portfolio."""
    series = portfolio_returns(returns, models).withColumnRenamed("portfolio", "ticker")
    outer = inverse_volatility(series).select(F.col("asset").alias("portfolio"), F.col("w").alias("v"))
    return compose(models, outer)
