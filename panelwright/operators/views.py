"""Views, posterior moments, scenario re-weighting, sentiment and stress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelwright.errors import ConfigurationError, DataError
from panelwright.functions.columns import clip
from panelwright.functions.dist import attach_one
from panelwright.operators.moments import apply_matrix
from panelwright.session import cut


def view_variances(cov: DataFrame, views: DataFrame) -> DataFrame:
    """(view, pvp = p' cov p) of picking rows (view, asset, p)."""
    rows = cov.join(views.select("view", F.col("asset").alias("asset_i"), F.col("p").alias("pi")), "asset_i").join(
        views.select("view", F.col("asset").alias("asset_j"), F.col("p").alias("pj")), ["view", "asset_j"]
    )
    return rows.groupBy("view").agg(F.sum(F.col("pi") * F.col("cov") * F.col("pj")).alias("pvp"))


def view_uncertainty(cov: DataFrame, views: DataFrame, tau: float = 0.05, confidence: DataFrame | None = None) -> DataFrame:
    """(view, omega): tau * p'Sp, scaled by 1/alpha - 1 where a confidence (view, alpha) is given."""
    v = view_variances(cov, views)
    if confidence is None:
        return v.select("view", (tau * F.col("pvp")).alias("omega"))
    return v.join(confidence.select("view", "alpha"), "view").select(
        "view", ((1 / F.col("alpha") - 1) * tau * F.col("pvp")).alias("omega")
    )


def track_record_uncertainty(forecasts: DataFrame, realized: DataFrame, min_rows: int = 5) -> DataFrame:
    """(view, omega): variance of forecast minus outcome over the dates complete in every view."""
    rows = forecasts.join(realized, ["date", "view"], "full").withColumn("gap", F.col("forecast") - F.col("realized"))
    n_views = rows.agg(F.count_distinct("view").alias("n_views"))
    whole = attach_one(rows.groupBy("date").agg(F.count("gap").alias("k")), n_views).where(F.col("k") == F.col("n_views"))
    out = rows.join(whole.select("date"), "date", "left_semi").groupBy("view").agg(
        F.var_samp("gap").alias("omega"), F.count(F.lit(1)).alias("n")
    )
    return out.where(F.col("n") >= min_rows).select("view", "omega")


def posterior(
    mu: DataFrame, cov: DataFrame, views: DataFrame, targets: DataFrame, tau: float = 0.05, risk_free: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """Posterior (mu, cov) for picking rows (view, asset, p) and targets (view, q, omega).

    With a diagonal uncertainty the views can be taken one after the other, each a
    rank-one update of the two tables; the result equals the joint formula. Only two
    numbers per view pass through the driver.
    """
    spread = cut(cov.select("asset_i", "asset_j", (tau * F.col("cov")).alias("cov")))
    m = mu.select("asset", "mu")
    for t in targets.orderBy("view").collect():
        p = views.where(F.col("view") == t["view"]).select("asset", "p")
        v = cut(apply_matrix(spread, p, "p"))
        s = v.join(m, "asset").join(p, "asset").agg(
            F.sum(F.col("p") * F.col("y")).alias("pvp"), F.sum(F.col("p") * F.col("mu")).alias("pm")
        ).first()
        a, b = s["pvp"] + t["omega"], t["q"] - s["pm"]
        m = cut(m.join(v, "asset").select("asset", (F.col("mu") + F.col("y") * (b / a)).alias("mu")))
        spread = cut(
            spread.join(v.select(F.col("asset").alias("asset_i"), F.col("y").alias("yi")), "asset_i")
            .join(v.select(F.col("asset").alias("asset_j"), F.col("y").alias("yj")), "asset_j")
            .select("asset_i", "asset_j", (F.col("cov") - F.col("yi") * F.col("yj") / a).alias("cov"))
        )
    total = cov.select("asset_i", "asset_j", F.col("cov").alias("c0")).join(spread, ["asset_i", "asset_j"])
    return m.select("asset", (F.col("mu") + risk_free).alias("mu")), total.select(
        "asset_i", "asset_j", (F.col("c0") + F.col("cov")).alias("cov")
    )


def picking_rows(views: DataFrame, assets: DataFrame) -> DataFrame:
    """(asset, expected, alpha) of raw views (asset, direction, magnitude_bps, confidence);
    unknown assets are dropped, confidence is clamped and defaults to 0.5."""
    return views.join(assets.select("asset"), "asset", "left_semi").select(
        "asset",
        (F.col("direction") * F.col("magnitude_bps") / 10_000).alias("expected"),
        clip(F.coalesce("confidence", F.lit(0.5)), 1e-6, 1 - 1e-6).alias("alpha"),
    )


def relative_views(mu: DataFrame, cov: DataFrame, means: DataFrame, variances: DataFrame) -> DataFrame:
    """(asset, kind, value): prior mean + x and prior variance * x."""
    a = means.join(mu, "asset").select("asset", F.lit("mean").alias("kind"), (F.col("mu") + F.col("x")).alias("value"))
    var = cov.where("asset_i = asset_j").select(F.col("asset_i").alias("asset"), F.col("cov").alias("var"))
    b = variances.join(var, "asset").select("asset", F.lit("variance").alias("kind"), (F.col("var") * F.col("x")).alias("value"))
    return a.unionByName(b)


# Scenarios


def tilt_to_mean(scenarios: DataFrame, target: float, steps: int = 30, tolerance: float = 1e-12) -> DataFrame:
    """(s, p): the probabilities closest to the given ones (s, x, p0) under which x has mean ``target``.

    p is proportional to p0 * exp(l * x); Newton's method finds l, each step one aggregate.
    Not within ``tolerance`` of the range of x after ``steps`` steps: ``DataError``.
    """
    span = scenarios.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("c")).first()
    if span["lo"] is None:
        raise DataError("no scenarios")
    if not span["lo"] < target < span["hi"]:
        raise ConfigurationError("the target mean is outside the scenarios")
    c, scale = span["c"], max(span["hi"] - span["lo"], 1e-300)
    z = (F.col("x") - c) / scale
    want = (target - c) / scale
    lam = 0.0
    for _ in range(steps):
        w = F.col("p0") * F.exp(F.lit(lam) * z)
        m = scenarios.agg(F.sum(w).alias("a"), F.sum(w * z).alias("b"), F.sum(w * z * z).alias("d")).first()
        mean = m["b"] / m["a"]
        var = m["d"] / m["a"] - mean * mean
        if abs(want - mean) < tolerance:
            break
        if var <= 0:
            raise DataError("the probabilities met in one scenario before the target mean was reached")
        lam += max(-2.0 / var**0.5, min(2.0 / var**0.5, (want - mean) / var))
    else:
        raise DataError(f"the target mean was not reached in {steps} steps")
    rows = scenarios.withColumn("w", F.col("p0") * F.exp(F.lit(lam) * z))
    total = rows.agg(F.sum("w").alias("t"))
    return attach_one(rows, total).select("s", (F.col("w") / F.col("t")).alias("p"))


def scenario_moments(scenarios: DataFrame, probs: DataFrame, beta: float = 0.95) -> DataFrame:
    """(asset, mean, variance, skew, kurtosis, cvar) of (s, asset, r) under (s, p).

    CVaR takes the worst rows until their probability reaches 1 - beta, the last in part.
    """
    rows = scenarios.join(probs, "s")
    m = rows.groupBy("asset").agg(F.sum(F.col("p") * F.col("r")).alias("mean"))
    rows = rows.join(m, "asset")
    d = F.col("r") - F.col("mean")
    w = Window.partitionBy("asset").orderBy("r", "s").rowsBetween(Window.unboundedPreceding, 0)
    used = F.greatest(F.lit(0.0), F.least(F.col("p"), (1 - beta) - (F.sum("p").over(w) - F.col("p"))))
    rows = rows.withColumn("used", used)
    out = rows.groupBy("asset").agg(
        F.max("mean").alias("mean"), F.sum(F.col("p") * d * d).alias("variance"), F.sum(F.col("p") * d * d * d).alias("m3"),
        F.sum(F.col("p") * d * d * d * d).alias("m4"), (-F.sum(F.col("used") * F.col("r")) / (1 - beta)).alias("cvar"),
    )
    return out.select(
        "asset", "mean", "variance", F.try_divide(F.col("m3"), F.pow("variance", F.lit(1.5))).alias("skew"),
        F.try_divide(F.col("m4"), F.col("variance") * F.col("variance")).alias("kurtosis"), "cvar",
    )


def scenario_correlation(scenarios: DataFrame, probs: DataFrame) -> DataFrame:
    """(asset_i, asset_j, corr), i <= j, under the probabilities, through the blocked product."""
    from panelwright.functions.pairs import product_sums

    rows = scenarios.join(probs, "s")
    m = rows.groupBy("asset").agg(F.sum(F.col("p") * F.col("r")).alias("m"))
    rows = rows.join(m, "asset")
    var = rows.groupBy("asset").agg(F.sum(F.col("p") * (F.col("r") - F.col("m")) * (F.col("r") - F.col("m"))).alias("v"))
    z = F.sqrt("p") * (F.col("r") - F.col("m")) / F.sqrt("v")
    cells = rows.join(var, "asset").select(F.col("s").alias("date"), F.col("asset").alias("ticker"), z.alias("r"))
    return product_sums(cells).select("asset_i", "asset_j", F.col("p1").alias("corr"))


def divergence(probs: DataFrame, base: DataFrame) -> DataFrame:
    """One row: sum(p * ln(p / p0))."""
    rows = probs.join(base.select("s", "p0"), "s")
    return rows.agg(F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln(F.col("p") / F.col("p0"))).otherwise(0.0)).alias("kl"))


def pool_opinions(experts: DataFrame, weights: DataFrame, base: DataFrame, linear: bool = True) -> DataFrame:
    """(s, p): experts (expert, s, p) pooled with weights (expert, v); the rest of the weight stays on the base (s, p0)."""
    rest = weights.agg((1 - F.sum("v")).alias("rest"))
    rows = experts.join(weights.select("expert", "v"), "expert")
    if linear:
        mixed = rows.groupBy("s").agg(F.sum(F.col("v") * F.col("p")).alias("mix"))
        return attach_one(base.join(mixed, "s", "left"), rest).select(
            "s", (F.coalesce("mix", F.lit(0.0)) + F.col("rest") * F.col("p0")).alias("p")
        )
    logs = rows.groupBy("s").agg(F.sum(F.col("v") * F.ln("p")).alias("mix"))
    raw = attach_one(base.join(logs, "s"), rest).select("s", F.exp(F.col("mix") + F.col("rest") * F.ln("p0")).alias("raw"))
    total = raw.agg(F.sum("raw").alias("t"))
    return attach_one(raw, total).select("s", (F.col("raw") / F.col("t")).alias("p"))


def expert_weights(ic: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(expert, v): max(ICIR, 0) + eps, normalized; fewer than 3 points get eps."""
    ratio = F.coalesce(F.try_divide(F.avg("ic"), F.stddev_samp("ic")), F.lit(0.0))
    raw = ic.groupBy("expert").agg(
        F.when(F.count("ic") < 3, eps).otherwise(F.greatest(ratio, F.lit(0.0)) + eps).alias("raw")
    )
    total = raw.agg(F.sum("raw").alias("t"))
    return attach_one(raw, total).select("expert", (F.col("raw") / F.col("t")).alias("v"))


# Sentiment and indicators


def sentiment_signal(articles: DataFrame, as_of, half_life_days: float = 5.0) -> DataFrame:
    """sum(score * exp(-ln2 * age / half-life)) per ticker; an article after ``as_of`` has age 0."""
    if half_life_days <= 0:
        raise ConfigurationError("half-life must be positive")
    now = F.unix_micros(F.lit(as_of).cast("timestamp"))
    age = F.greatest(F.lit(0.0), (now - F.unix_micros("published")) / 86_400e6)
    return articles.groupBy("ticker").agg(
        F.sum(F.col("score") * F.exp(-F.ln(F.lit(2.0)) * age / half_life_days)).alias("signal")
    )


def adjusted_confidence(views: DataFrame, signals: DataFrame) -> DataFrame:
    """alpha * (1 + |signal|) when the signs of sentiment and view agree, else alpha * (1 - |signal|)."""
    s = F.coalesce(F.col("signal"), F.lit(0.0))
    agree = (s > 0) == (F.col("direction") > 0)
    factor = F.when(s == 0, 1.0).when(agree, 1 + F.abs(s)).otherwise(1 - F.abs(s))
    return views.join(signals, "ticker", "left").select(
        "ticker", "direction", clip(F.col("alpha") * factor, 0.01, 0.99).alias("alpha")
    )


def indicators(panel: DataFrame, month: int = 21, year: int = 252, rsi: int = 14) -> DataFrame:
    """Momentum, RSI and distance to the yearly extremes per ticker over its own last prices."""
    w = Window.partitionBy("ticker").orderBy("date")
    back = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    rows = panel.where(F.col("close").isNotNull()).select(
        "ticker", "close", (F.col("close") - F.lag("close").over(w)).alias("move"), F.row_number().over(back).alias("k")
    )
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("close")))
    recent = F.col("k") <= rsi
    gain = F.sum(F.when(recent & (F.col("move") > 0), F.col("move")).otherwise(0.0)) / rsi
    loss = F.sum(F.when(recent & (F.col("move") < 0), -F.col("move")).otherwise(0.0)) / rsi
    in_year = F.when(F.col("k") <= year, F.col("close"))
    agg = rows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), at(1).alias("last"), at(month + 1).alias("m1"), at(year + 1).alias("y1"),
        F.count(F.when(recent, F.col("move"))).alias("n_moves"),
        gain.alias("gain"), loss.alias("loss"), F.max(in_year).alias("high"), F.min(in_year).alias("low"),
    )
    return agg.select(
        "ticker",
        (F.try_divide(F.col("m1"), F.col("y1")) - 1).alias("momentum_12_1"),
        F.when(F.col("n") > year, F.try_divide(F.col("last"), F.col("m1")) - 1).alias("momentum_1m"),
        F.when(F.col("n_moves") >= rsi, F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain") / F.col("loss")))).alias("rsi"),
        (F.col("last") / F.col("high") - 1).alias("from_high"),
        (F.col("last") / F.col("low") - 1).alias("from_low"),
    )


def target_upside(rows: DataFrame) -> DataFrame:
    return rows.withColumn("upside", F.try_divide(F.col("target_price"), F.col("current_price")) - 1)


# Budgets and stress


def normalized_group_weights(raw: DataFrame, keys: Sequence[str], floor: float = 0.1) -> DataFrame:
    """Weights floored and scaled to mean 1 in their group."""
    rows = raw.withColumn("w", F.greatest("w", F.lit(floor)))
    total = rows.groupBy(*keys).agg(F.avg("w").alias("_m"))
    return rows.join(total, list(keys)).withColumn("w", F.col("w") / F.col("_m")).drop("_m")


def sector_budgets(budgets: DataFrame, assets: DataFrame) -> DataFrame:
    """(asset, budget): sector budgets (sector, b) split equally over the sector's assets, normalized."""
    n = assets.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))
    rows = assets.join(n, "sector").join(budgets, "sector", "left").select(
        "asset", (F.coalesce("b", F.lit(0.0)) / F.col("n")).alias("raw")
    )
    total = rows.agg(F.sum("raw").alias("t"), F.count(F.lit(1)).alias("k"))
    return attach_one(rows, total).select("asset", F.when(F.col("t") > 0, F.col("raw") / F.col("t")).otherwise(1.0 / F.col("k")).alias("budget"))


def clamped_scenarios(shocks: DataFrame, severe: float = 0.10) -> DataFrame:
    """Stress scenarios (scenario, probability, asset, shock) with values clamped.

    When no scenario's negative shocks average a drawdown of ``severe``, every shock of
    the first scenario is lowered to at least that.
    """
    rows = shocks.withColumn("probability", clip(F.col("probability"), 1e-4, 1 - 1e-4)).withColumn(
        "shock", clip(F.col("shock"), -0.9999, 0.9999)
    )
    falls = rows.groupBy("scenario").agg(F.avg(F.when(F.col("shock") < 0, F.col("shock"))).alias("m"))
    known = falls.agg(F.coalesce(F.bool_or(F.col("m") <= -severe), F.lit(False)).alias("_ok"), F.min("scenario").alias("_first"))
    patch = ~F.col("_ok") & (F.col("scenario") == F.col("_first"))
    return attach_one(rows, known).select(
        "scenario", "probability", "asset",
        F.when(patch, F.least(F.col("shock"), F.lit(-severe))).otherwise(F.col("shock")).alias("shock"),
    )


def stressed_holdings(scenarios: DataFrame, weights: DataFrame) -> DataFrame:
    """(portfolio, scenario, probability, loss): sum(w * shock)."""
    return scenarios.join(weights, "asset").groupBy("portfolio", "scenario", "probability").agg(
        F.sum(F.col("w") * F.col("shock")).alias("loss")
    )
