"""Means and covariances as tables: mu(asset, mu) and cov(asset_i, asset_j, cov) for all ordered pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from panelwright.errors import ConfigurationError, DataError
from panelwright.functions.dist import attach_one, with_group_stats
from panelwright.functions.pairs import blocked_pairs, mirrored, pair_sums, product_sums, with_moments
from panelwright.operators.spectral import PanelGram, Spectrum, inverse_product, inverse_products, largest_eigenvalue
from panelwright.session import cut
from panelwright.sources.panel import with_axis


def mean(returns: DataFrame) -> DataFrame:
    return returns.groupBy(F.col("ticker").alias("asset")).agg(F.avg("r").alias("mu"))


def covariance(returns: DataFrame) -> DataFrame:
    """Sample covariance (T-1) and correlation over the dates both assets have."""
    return with_moments(pair_sums(returns, both=True))


def equal_weights(assets: DataFrame) -> DataFrame:
    """(asset, w) with 1/N each."""
    n = assets.agg(F.count(F.lit(1)).alias("n"))
    return attach_one(assets, n).select("asset", (1.0 / F.col("n")).alias("w"))


def ew_weights(returns: DataFrame, alpha: float) -> DataFrame:
    """Adds the weight (1 - alpha)^(T - t) of the date."""
    return with_axis(returns).withColumn("w", F.pow(F.lit(1.0 - alpha), F.col("n_dates") - F.col("idx")))


def ew_mean(returns: DataFrame, alpha: float = 0.2) -> DataFrame:
    rows = ew_weights(returns.where(F.col("r").isNotNull()), alpha)
    return rows.groupBy(F.col("ticker").alias("asset")).agg((F.sum(F.col("w") * F.col("r")) / F.sum("w")).alias("mu"))


def equilibrium_mean(cov: DataFrame, weights: DataFrame | None = None, risk_aversion: float = 1.0) -> DataFrame:
    """risk aversion * sum_j cov_ij * w_j; equal weights when none are given."""
    w = weights if weights is not None else equal_weights(cov.select(F.col("asset_i").alias("asset")).distinct())
    rows = cov.join(w.select(F.col("asset").alias("asset_j"), "w"), "asset_j")
    return rows.groupBy(F.col("asset_i").alias("asset")).agg((risk_aversion * F.sum(F.col("cov") * F.col("w"))).alias("mu"))


def apply_matrix(cov: DataFrame, vector: DataFrame, name: str = "x") -> DataFrame:
    """(asset, y) = cov @ x."""
    return (
        cov.join(vector.select(F.col("asset").alias("asset_j"), F.col(name).alias("_x")), "asset_j")
        .groupBy(F.col("asset_i").alias("asset"))
        .agg(F.sum(F.col("cov") * F.col("_x")).alias("y"))
    )


def shrunk_mean(returns: DataFrame, method: str = "james_stein") -> DataFrame:
    """Means pulled to the grand mean with the James-Stein, Bayes-Stein or Bodnar-Okhrin intensity.

    The first two take every return: means over an asset's own dates and the covariance over the
    dates that two assets share. Bodnar-Okhrin takes complete dates only.
    """
    if method == "bodnar_okhrin":
        gram = PanelGram(returns)
        mu = gram.rows.select(F.col("ticker").alias("asset"), F.col("m").alias("mu"))
        grand = mu.agg(F.avg("mu")).first()[0]
        n, t, q = gram.n, gram.t, inverse_products(gram)
        u, v, w = q["mm"], grand * grand * q["one"], grand * q["m1"]
        alpha = ((u - n / (t - n)) * v - w * w) / (u * v - w * w)
        beta = (1 - alpha) * w / v
    elif method in ("james_stein", "bayes_stein"):
        # a ticker that is null is an asset too, so the assets meet by a key
        key = F.coalesce(F.concat(F.lit("="), "ticker"), F.lit(""))
        rows = cut(returns.where(F.col("r").isNotNull()).select("date", F.col("ticker").alias("asset"), key.alias("ticker"), "r"))
        mu = cut(rows.groupBy("asset", "ticker").agg(F.avg("r").alias("mu")))
        cov = cut(covariance(rows.select("date", "ticker", "r")).select("asset_i", "asset_j", "cov"))
        size = mu.agg(F.count(F.lit(1)).alias("n"), F.avg("mu").alias("g")).first()
        n, grand = size["n"], size["g"]
        t = rows.select("date").distinct().count()
        if cov.where("cov IS NOT NULL").count() < n * n or not n:
            raise DataError("two assets share fewer than 2 dates")
        gaps = mu.select(F.col("ticker").alias("asset"), (F.col("mu") - grand).alias("x"))
        if method == "james_stein":
            trace = cov.where("asset_i = asset_j").agg(F.sum("cov")).first()[0]
            gap = gaps.agg(F.sum(F.col("x") * F.col("x"))).first()[0]
            beta = (trace - 2 * largest_eigenvalue(cov)) / gap / t
        else:
            beta = (n + 2) / ((n + 2) + t * inverse_product(cov, gaps))
        alpha = 1 - beta
    else:
        raise ConfigurationError(f"unknown shrinkage {method!r}")
    return mu.select("asset", (alpha * F.col("mu") + beta * grand).alias("mu"))


def _centred(returns: DataFrame) -> DataFrame:
    rows = with_group_stats(returns.where(F.col("r").isNotNull()), ["ticker"], F.avg("r").alias("_m"))
    return rows.withColumn("r", F.col("r") - F.col("_m")).select("date", "ticker", "r")


def _twice(column) -> object:
    """Weight of an i <= j row in a sum over all ordered pairs."""
    return F.sum(F.when(F.col("asset_i") == F.col("asset_j"), 1.0).otherwise(2.0) * column)


def _biased(returns: DataFrame) -> DataFrame:
    """(asset_i, asset_j, s = mean of x_i x_j, p2 = mean of squares, t, n) from centred rows, i <= j."""
    rows = _centred(returns)
    size = rows.agg(F.count_distinct("date").alias("t"), F.count_distinct("ticker").alias("n"))
    return attach_one(product_sums(rows), size).select(
        "asset_i", "asset_j", (F.col("p1") / F.col("t")).alias("s"), (F.col("p2") / F.col("t")).alias("p2"), "t", "n"
    )


def _to_identity(pairs: DataFrame, intensity: DataFrame) -> DataFrame:
    """(1 - k) * s + k * m on the diagonal; ``intensity`` is one row (k, m)."""
    rows = attach_one(pairs, intensity)
    s = (1 - F.col("k")) * F.col("s") + F.when(F.col("asset_i") == F.col("asset_j"), F.col("k") * F.col("m")).otherwise(0.0)
    return mirrored(rows.select("asset_i", "asset_j", s.alias("cov"), "k"))


def _diagonal(pairs: DataFrame, value: str = "s"):
    return F.when(F.col("asset_i") == F.col("asset_j"), F.col(value)).otherwise(0.0)


def ledoit_wolf(returns: DataFrame) -> DataFrame:
    """Shrinkage to the scaled identity with the Ledoit-Wolf intensity (k is the intensity).

    Divisors are T, as in the published estimator. The panel must be complete.
    """
    p = cut(_biased(returns))
    agg = p.agg(
        F.max("t").alias("t"), F.max("n").alias("n"), F.sum(_diagonal(p)).alias("trace"),
        _twice(F.col("s") * F.col("s")).alias("ss"), _twice(F.col("p2")).alias("pp"),
    )
    m = F.col("trace") / F.col("n")
    noise = (F.col("pp") - F.col("ss")) / (F.col("n") * F.col("t"))
    gap = (F.col("ss") - 2 * m * F.col("trace") + F.col("n") * m * m) / F.col("n")
    k = F.when(gap > 0, F.least(noise, gap) / gap).otherwise(0.0)
    return _to_identity(p, agg.select(k.alias("k"), m.alias("m")))


def _third_kernel(x1, m1, x2, m2):
    q1, q2 = x1 * x1, x2 * x2
    return {"p1": x1 @ x2.T, "p2": q1 @ q2.T, "p31": (q1 * x1) @ x2.T, "p13": x1 @ (q2 * x2).T}


def ledoit_wolf_constant_correlation(returns: DataFrame) -> DataFrame:
    """Shrinkage to the constant-correlation target with its Ledoit-Wolf intensity."""
    rows = _centred(returns)
    size = rows.agg(F.count_distinct("date").alias("t"), F.count_distinct("ticker").alias("n"))
    p = attach_one(blocked_pairs(rows, _third_kernel, ["p1", "p2", "p31", "p13"]), size)
    p = p.select("asset_i", "asset_j", "t", "n", *[(F.col(c) / F.col("t")).alias(o) for c, o in (("p1", "s"), ("p2", "p2"), ("p31", "p31"), ("p13", "p13"))])
    p = cut(p)
    var = p.where("asset_i = asset_j")
    p = p.join(var.select("asset_i", F.col("s").alias("vi")), "asset_i").join(
        var.select(F.col("asset_j"), F.col("s").alias("vj")), "asset_j"
    )
    off = F.col("asset_i") != F.col("asset_j")
    rho = p.where(off).agg(F.avg(F.col("s") / F.sqrt(F.col("vi") * F.col("vj"))).alias("rho"))
    p = cut(attach_one(p, rho))
    target = F.when(off, F.col("rho") * F.sqrt(F.col("vi") * F.col("vj"))).otherwise(F.col("s"))
    noise = F.col("p2") - F.col("s") * F.col("s")
    cross = F.col("rho") / 2 * (
        F.sqrt(F.col("vj") / F.col("vi")) * (F.col("p31") - F.col("vi") * F.col("s"))
        + F.sqrt(F.col("vi") / F.col("vj")) * (F.col("p13") - F.col("vj") * F.col("s"))
    )
    agg = p.agg(
        F.max("t").alias("t"), _twice(noise).alias("pi"), _twice(F.when(off, cross).otherwise(noise)).alias("ro"),
        _twice((target - F.col("s")) * (target - F.col("s"))).alias("ga"),
    )
    k = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("pi") - F.col("ro")) / F.col("ga") / F.col("t")))
    out = attach_one(p, agg.select(k.alias("k")))
    return mirrored(out.select("asset_i", "asset_j", (F.col("k") * target + (1 - F.col("k")) * F.col("s")).alias("cov"), "k"))


def oracle_approximating(returns: DataFrame) -> DataFrame:
    """Oracle-approximating shrinkage to the scaled identity."""
    p = cut(_biased(returns))
    agg = p.agg(
        F.max("t").alias("t"), F.max("n").alias("n"), F.sum(_diagonal(p)).alias("trace"), _twice(F.col("s") * F.col("s")).alias("ss")
    )
    m = F.col("trace") / F.col("n")
    alpha = F.col("ss") / (F.col("n") * F.col("n"))
    den = (F.col("t") + 1) * (alpha - m * m / F.col("n"))
    k = F.when(den == 0, 1.0).otherwise(F.least((alpha + m * m) / den, F.lit(1.0)))
    return _to_identity(p, agg.select(k.alias("k"), m.alias("m")))


def constant_shrinkage(returns: DataFrame, intensity: float = 0.1) -> DataFrame:
    p = _biased(returns)
    m = F.sum(_diagonal(p)) / F.max("n")
    return _to_identity(p, p.agg(m.alias("m")).withColumn("k", F.lit(float(intensity))))


def ew_covariance(returns: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Exponentially weighted second moments, weights normalized over the dates."""
    rows = ew_weights(returns.where(F.col("r").isNotNull()), alpha)
    total = rows.select("idx", "w").distinct().agg(F.sum("w").alias("_w"))
    scaled = attach_one(rows, total).withColumn("r", F.col("r") * F.sqrt(F.col("w") / F.col("_w")))
    return mirrored(product_sums(scaled.select("date", "ticker", "r")).select("asset_i", "asset_j", F.col("p1").alias("cov")))


def gerber(returns: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Concordant minus discordant over their sum beyond ``threshold`` deviations, times the deviations."""
    rows = with_group_stats(returns.where(F.col("r").isNotNull()), ["ticker"], F.stddev_samp("r").alias("sd"))
    sign = F.when(F.abs("r") > threshold * F.col("sd"), F.signum("r")).otherwise(0.0)
    sd = returns.groupBy(F.col("ticker").alias("asset")).agg(F.stddev_samp("r").alias("sd"))
    g = product_sums(rows.withColumn("r", sign).select("date", "ticker", "r"))
    return mirrored(
        g.join(sd.select(F.col("asset").alias("asset_i"), F.col("sd").alias("sd_i")), "asset_i")
        .join(sd.select(F.col("asset").alias("asset_j"), F.col("sd").alias("sd_j")), "asset_j")
        .select("asset_i", "asset_j", (F.coalesce(F.try_divide(F.col("p1"), F.col("p2")), F.lit(0.0)) * F.col("sd_i") * F.col("sd_j")).alias("cov"))
    )


def _low_rank(loadings: DataFrame) -> DataFrame:
    """(asset_i, asset_j, p1), i <= j: products of (ticker, k, value) summed over k, through the blocked product."""
    return product_sums(loadings.select(F.col("k").alias("date"), "ticker", F.col("value").alias("r")))


def denoised(returns: DataFrame) -> DataFrame:
    """Eigenvalues at or below the Marchenko-Pastur edge are replaced by their mean; complete dates only.

    The sum of all eigenvector squares is the identity, so only the eigenvectors
    above the edge are needed: sum (l_k - noise) v_k v_k' + noise * I.
    """
    gram = PanelGram(returns)
    edge = gram.trace / gram.n * (1 + math.sqrt(gram.n / gram.t)) ** 2
    signal = Spectrum(gram, above=edge)
    k = len(signal.values)
    noise = float((gram.trace - signal.values.sum()) / (gram.n - k)) if k < gram.n else 0.0
    diagonal = F.when(F.col("asset_i") == F.col("asset_j"), noise).otherwise(0.0)
    if k:
        part = _low_rank(signal.asset_vectors(np.sqrt(np.maximum(signal.values - noise, 0.0))))
    else:
        part = covariance(returns).select("asset_i", "asset_j", F.lit(0.0).alias("p1")).where("asset_i <= asset_j")
    return mirrored(part.select("asset_i", "asset_j", (F.col("p1") + diagonal).alias("cov")))


def detoned(returns: DataFrame) -> DataFrame:
    """The first eigen component removed; it is that of the complete dates."""
    first = Spectrum(PanelGram(returns), 1)
    market = _low_rank(first.asset_vectors(np.sqrt(first.values)))
    cov = with_moments(pair_sums(returns))
    return mirrored(
        cov.join(market, ["asset_i", "asset_j"]).select("asset_i", "asset_j", (F.col("cov") - F.col("p1")).alias("cov"))
    )


def implied(returns: DataFrame, implied_vols: DataFrame) -> DataFrame:
    """Historical correlation with implied volatilities (asset, iv)."""
    corr = with_moments(pair_sums(returns))
    iv = implied_vols
    return mirrored(
        corr.join(iv.select(F.col("asset").alias("asset_i"), F.col("iv").alias("iv_i")), "asset_i")
        .join(iv.select(F.col("asset").alias("asset_j"), F.col("iv").alias("iv_j")), "asset_j")
        .select("asset_i", "asset_j", (F.col("corr") * F.col("iv_i") * F.col("iv_j")).alias("cov"))
    )


def factor_loadings(returns: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """(asset, b0, b1..bk, resid_var): OLS of each asset on the factor columns.

    Spark aggregates the normal equations; tasks solve the small systems.
    """
    rows = returns.where(F.col("r").isNotNull()).join(factors, "date")
    z = [F.lit(1.0), *[F.col(n) for n in names]]
    size = len(z)
    sums = [F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i in range(size) for j in range(i, size)]
    sums += [F.sum(z[i] * F.col("r")).alias(f"h{i}") for i in range(size)]
    eqs = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r") * F.col("r")).alias("rr"), *sums)

    def run(frames):
        for f in frames:
            beta = np.zeros((len(f), size))
            var = np.zeros(len(f))
            for at in range(len(f)):
                g = np.zeros((size, size))
                for i in range(size):
                    for j in range(i, size):
                        g[i, j] = g[j, i] = f[f"g{i}_{j}"].iat[at]
                h = np.array([f[f"h{i}"].iat[at] for i in range(size)])
                beta[at] = np.linalg.lstsq(g, h, rcond=None)[0]
                rest = f["rr"].iat[at] - 2 * beta[at] @ h + beta[at] @ g @ beta[at]
                var[at] = max(rest, 0.0) / max(f["n"].iat[at] - size, 1)
            yield pd.DataFrame({"asset": f["ticker"].to_numpy(), **{f"b{i}": beta[:, i] for i in range(size)}, "resid_var": var})

    return eqs.mapInPandas(run, "asset string, " + ", ".join(f"b{i} double" for i in range(size)) + ", resid_var double")


def factor_model(returns: DataFrame, factors: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(mu, cov) with mu = a + B E[f] and cov = B F B' + residual variances.

    With F = L L', the systematic part is the product of B L with itself, which the
    blocked product computes without joining all asset pairs.
    """
    b = cut(factor_loadings(returns, factors, names))
    stats = factors.agg(
        *[F.avg(n).alias(f"m_{n}") for n in names],
        *[F.covar_samp(x, y).alias(f"c_{i}_{j}") for i, x in enumerate(names) for j, y in enumerate(names)],
    ).first()
    k = len(names)
    f = np.array([[stats[f"c_{i}_{j}"] for j in range(k)] for i in range(k)])
    values, vectors = np.linalg.eigh((f + f.T) / 2)
    root = vectors * np.sqrt(np.clip(values, 0, None))
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("date"), sum((F.col(f"b{i + 1}") * float(root[i, c]) for i in range(k)), F.lit(0.0)).alias("r"))
                for c in range(k)
            ]
        )
    )
    systematic = product_sums(b.select(F.col("asset").alias("ticker"), cells.alias("e")).select("e.date", "ticker", "e.r"))
    cov = mirrored(
        systematic.join(b.select(F.col("asset").alias("asset_i"), "resid_var"), "asset_i").select(
            "asset_i", "asset_j",
            (F.col("p1") + F.when(F.col("asset_i") == F.col("asset_j"), F.col("resid_var")).otherwise(0.0)).alias("cov"),
        )
    )
    mu = b.select("asset", sum((F.col(f"b{i + 1}") * float(stats[f"m_{n}"]) for i, n in enumerate(names)), F.col("b0")).alias("mu"))
    return mu, cov


def to_horizon(mu: DataFrame, cov: DataFrame, horizon: int, method: str = "exact") -> tuple[DataFrame, DataFrame]:
    """Log-normal moments over ``horizon`` periods; the linear method only scales the covariance."""
    if horizon < 1:
        raise DataError("horizon must be a positive whole number")
    if method not in ("exact", "linear"):
        raise ConfigurationError(f"unknown method {method!r}")
    var = cov.where("asset_i = asset_j").select(F.col("asset_i").alias("asset"), F.col("cov").alias("var"))
    m = mu.join(var, "asset")
    h = float(horizon)
    grown = m.select("asset", (F.exp((F.col("mu") + 0.5 * F.col("var")) * h) - 1).alias("mu"))
    if method == "linear":
        return grown, cov.select("asset_i", "asset_j", (F.col("cov") * h).alias("cov"))
    drift = m.select("asset", (F.col("mu") + 0.5 * F.col("var")).alias("d"))
    scaled = (
        cov.join(drift.select(F.col("asset").alias("asset_i"), F.col("d").alias("di")), "asset_i")
        .join(drift.select(F.col("asset").alias("asset_j"), F.col("d").alias("dj")), "asset_j")
        .select("asset_i", "asset_j", (F.exp((F.col("di") + F.col("dj")) * h) * (F.exp(F.col("cov") * h) - 1)).alias("cov"))
    )
    return grown, scaled


MEANS = ("empirical", "james_stein", "bayes_stein", "bodnar_okhrin", "ew", "equilibrium")
COVARIANCES = ("empirical", "ledoit_wolf", "constant_correlation", "oas", "shrunk", "ew", "gerber", "denoised", "detoned")


def prior(returns: DataFrame, mu_method: str = "empirical", cov_method: str = "ledoit_wolf", horizon: int | None = None, alpha: float = 0.2, risk_aversion: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The (mu, cov) tables chosen by name, at the given horizon."""
    estimators = {
        "empirical": covariance, "ledoit_wolf": ledoit_wolf, "constant_correlation": ledoit_wolf_constant_correlation,
        "oas": oracle_approximating, "shrunk": constant_shrinkage, "ew": lambda r: ew_covariance(r, alpha),
        "gerber": gerber, "denoised": denoised, "detoned": detoned,
    }
    if cov_method not in estimators:
        raise ConfigurationError(f"unknown covariance {cov_method!r}")
    if mu_method not in MEANS:
        raise ConfigurationError(f"unknown mean {mu_method!r}")
    cov = estimators[cov_method](returns).select("asset_i", "asset_j", "cov")
    if mu_method == "empirical":
        mu = mean(returns)
    elif mu_method == "ew":
        mu = ew_mean(returns, alpha)
    elif mu_method == "equilibrium":
        mu = equilibrium_mean(cov, risk_aversion=risk_aversion)
    else:
        mu = shrunk_mean(returns, mu_method)
    return (mu, cov) if horizon is None else to_horizon(mu, cov, horizon)


# Regimes


def last_probabilities(probs: DataFrame) -> DataFrame:
    """(state, p) on the last date."""
    last = probs.agg(F.max("date").alias("last"))
    return attach_one(probs, last).where(F.col("date") == F.col("last")).select("state", "p")


def blended_moments(regime_mu: DataFrame, regime_cov: DataFrame, probs: DataFrame, between: bool = False) -> tuple[DataFrame, DataFrame]:
    """Probability-weighted means and covariances; ``between`` adds the dispersion of the regime means."""
    p = last_probabilities(probs)
    mu = regime_mu.join(p, "state").groupBy("asset").agg(F.sum(F.col("p") * F.col("mu")).alias("mu"))
    rows = regime_cov.join(p, "state")
    value = F.col("cov")
    if between:
        gap = regime_mu.join(mu.withColumnRenamed("mu", "_b"), "asset").select("state", "asset", (F.col("mu") - F.col("_b")).alias("g"))
        rows = rows.join(gap.select("state", F.col("asset").alias("asset_i"), F.col("g").alias("gi")), ["state", "asset_i"]).join(
            gap.select("state", F.col("asset").alias("asset_j"), F.col("g").alias("gj")), ["state", "asset_j"]
        )
        value = value + F.col("gi") * F.col("gj")
    return mu, rows.groupBy("asset_i", "asset_j").agg(F.sum(F.col("p") * value).alias("cov"))


def regime_filter(returns: DataFrame, start: list[float], transition: list[list[float]], states: DataFrame) -> DataFrame:
    """(date, ticker, state, p): causal state probabilities of each series for given parameters.

    ``states`` has (ticker, means array, sds array). Each series is one group of at
    most one row per date; the forward pass runs in log space.
    """
    k = len(start)
    log_a = np.log(np.asarray(transition) + 1e-300)
    log_0 = np.log(np.asarray(start) + 1e-300)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        r = frame["r"].to_numpy()
        m, s = np.asarray(frame["means"].iat[0]), np.asarray(frame["sds"].iat[0])
        emit = -0.5 * np.log(2 * np.pi) - np.log(s) - 0.5 * ((r[:, None] - m) / s) ** 2
        out = np.empty((len(r), k))
        now = log_0 + emit[0]
        for t in range(len(r)):
            if t:
                both = now[:, None] + log_a
                top = both.max(axis=0)
                now = top + np.log(np.exp(both - top).sum(axis=0)) + emit[t]
            # The offset of a row does not change its probabilities, so it is taken out at once.
            now = now - now.max()
            now = now - np.log(np.exp(now).sum())
            out[t] = np.exp(now)
        n = len(frame)
        return pd.DataFrame(
            {
                "date": np.repeat(frame["date"].to_numpy(), k), "ticker": np.repeat(frame["ticker"].to_numpy(), k),
                "state": np.tile(np.arange(k), n), "p": out.ravel(),
            }
        )

    rows = returns.where(F.col("r").isNotNull()).select("date", "ticker", "r").join(states, "ticker")
    return rows.groupBy("ticker").applyInPandas(run, "date date, ticker string, state int, p double")


def _let(value, use):
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def forward_loglik(returns: DataFrame, models: DataFrame) -> DataFrame:
    """(ticker, n_states, loglik, n_dates): log-likelihood of each series under each candidate's parameters.

    ``models`` has (ticker, n_states, start, transition, means, sds). The scaled forward recursion is
    a fold over the series, sorted by date (at most one row per date): the probabilities are
    normalized at every step and the logarithms of the normalizers are summed, with the largest
    exponent taken out first. Null returns are left out, so dates are counted per series.
    """
    rows = returns.where(F.col("r").isNotNull()).groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.struct("date", F.col("r").cast("double").alias("r")))).alias("c")).join(models, "ticker")
    state = F.sequence(F.lit(0), F.col("n_states") - 1)
    half = 0.5 * math.log(2 * math.pi)

    def step(acc, x):
        def weigh(i):
            z = (x["r"] - F.col("means")[i]) / F.col("sds")[i]
            return F.ln(F.greatest(acc["p"][i], F.lit(1e-300))) - F.ln(F.col("sds")[i]) - half - 0.5 * z * z

        def normalized(scores):
            top = F.array_max(scores)
            return _let(F.transform(scores, lambda v: F.exp(v - top)), lambda u: _let(F.aggregate(u, F.lit(0.0), lambda a, v: a + v), lambda total: F.struct(
                F.transform(state, lambda j: F.aggregate(state, F.lit(0.0), lambda a, i: a + u[i] / total * F.col("transition")[i][j])).alias("p"),
                (acc["ll"] + top + F.ln(total)).alias("ll"))))

        return _let(F.transform(state, weigh), normalized)

    folded = F.aggregate("c", F.struct(F.col("start").alias("p"), F.lit(0.0).alias("ll")), step)
    return rows.select("ticker", "n_states", folded["ll"].alias("loglik"), F.size("c").cast("long").alias("n_dates"))


def bucket_regimes(returns: DataFrame, counts: tuple[int, ...] = (2, 3, 4), least_sd: float = 0.25) -> DataFrame:
    """Candidate parameters of each series (ticker, n_states, start, transition, means, sds) from equal buckets of its returns.

    A state's mean and deviation are those of its bucket, the deviation at least ``least_sd`` of the
    series'; transitions are the bucket's followers, one added to each count. A series without
    spread, or with fewer rows than states, gets no candidate.
    """
    by = Window.partitionBy("ticker")
    rows = returns.where(F.col("r").isNotNull()).select("ticker", "date", F.col("r").cast("double").alias("r"))
    rows = rows.withColumn("_at", F.row_number().over(by.orderBy("r", "date")) - 1).withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_sd", F.stddev_pop("r").over(by))
    rows = rows.where("_sd > 0").withColumn("n_states", F.explode(F.array(*[F.lit(k) for k in counts]))).where("_n >= n_states")
    rows = rows.withColumn("s", F.floor(F.col("_at") * F.col("n_states") / F.col("_n")).cast("int"))
    before = F.lag("s").over(Window.partitionBy("ticker", "n_states").orderBy("date"))
    keys = ["ticker", "n_states"]
    per = rows.groupBy(*keys, "s").agg(F.avg("r").alias("m"), F.greatest(F.stddev_pop("r"), least_sd * F.max("_sd")).alias("sd"))
    states = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("s", "m", "sd"))).alias("x"))
    moves = rows.withColumn("b", before).where("b IS NOT NULL").groupBy(*keys, (F.col("b") * F.col("n_states") + F.col("s")).alias("move")).agg(F.count(F.lit(1)).alias("c"))
    moves = moves.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("move", F.col("c").cast("double").alias("c")))).alias("moves"))
    k = F.col("n_states")
    state = F.sequence(F.lit(0), k - 1)

    def count(i, j):
        return F.coalesce(F.col("moves")[i * k + j], F.lit(0.0)) + 1.0

    transition = F.transform(state, lambda i: _let(F.aggregate(state, F.lit(0.0), lambda a, j: a + count(i, j)), lambda total: F.transform(state, lambda j: count(i, j) / total)))
    return states.join(moves, keys, "left").select(
        *keys, F.transform(state, lambda i: 1.0 / k).alias("start"), transition.alias("transition"), F.col("x.m").alias("means"), F.col("x.sd").alias("sds"))


def choose_state_count(fits: DataFrame, n_dates: int | None = None, n_assets: int = 1, criterion: str = "bic") -> DataFrame:
    """Scores of (model, n_states, loglik) rows and the smallest per model.

    Without ``n_dates`` the rows tell their own (n_dates).
    """
    if criterion not in ("aic", "bic"):
        raise ConfigurationError("criterion must be aic or bic")
    s, d = F.col("n_states"), n_assets
    k = s * (s - 1) + s * d + s * (d * (d + 1) // 2)
    log_t = F.ln("n_dates") if n_dates is None else F.lit(math.log(n_dates))
    score = -2 * F.col("loglik") + k * (F.lit(2.0) if criterion == "aic" else log_t)
    rows = fits.withColumn("score", score)
    best = rows.groupBy("model").agg(F.min_by("n_states", F.struct("score", "n_states")).alias("best"))
    return rows.join(best, "model").select("model", "n_states", "score", (F.col("n_states") == F.col("best")).alias("chosen"))
