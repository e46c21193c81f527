"""Risk and ratio measures of many portfolios at once.

A portfolio has one return per date, so its windows are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.errors import ConfigurationError
from panelwright.functions.dist import attach_one
from panelwright.functions.pairs import rectangular
from panelwright.operators.moments import last_probabilities
from panelwright.session import cut

# Exponents over which the entropic measures are minimized.
Z_GRID = [round(0.1 * 1.5**k, 6) for k in range(21)]

MEASURES = (
    "variance", "standard_deviation", "semi_variance", "semi_deviation", "mean_absolute_deviation",
    "first_lower_partial_moment", "gini_mean_difference", "fourth_central_moment", "fourth_lower_partial_moment",
    "value_at_risk", "cvar", "entropic_value_at_risk", "entropic_risk", "worst_realization",
    "max_drawdown", "average_drawdown", "cdar", "drawdown_at_risk", "entropic_drawdown_at_risk", "ulcer_index",
)


def portfolio_returns(returns: DataFrame, weights: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """sum(w * r) per portfolio and date, as a blocked product; no row per asset, date and portfolio."""
    left = weights.select(*keys, F.col("asset").alias("ticker"), F.col("w").alias("a"))
    return rectangular(left, returns.select("ticker", "date", F.col("r").alias("b")), keys, "ticker", "date", "r")


def _entropic(loss: Column, beta: float) -> Column:
    """min over z of ln(mean(exp(z * loss)) / (1 - beta)) / z."""
    return F.least(*[F.ln(F.avg(F.exp(loss * z)) / (1 - beta)) / z for z in Z_GRID])


def risk_table(rows: DataFrame, keys: Sequence[str] = ("portfolio",), beta: float = 0.95, downside_rows_only: bool = False) -> DataFrame:
    """Every measure of (keys, date, r) per group.

    ``downside_rows_only`` divides the semi-variance by the number of downside rows
    (0 with fewer than two) instead of by all rows. Drawdowns use the wealth after
    each return; ``ruined`` flags a return of -100 % or less.
    """
    part = Window.partitionBy(*keys)
    by_date = part.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    alive = F.when(F.col("r") > -1, F.ln(1 + F.col("r")))
    x = (
        rows.where(F.col("r").isNotNull())
        .withColumn("_m", F.avg("r").over(part))
        .withColumn("_n", F.count(F.lit(1)).over(part))
        .withColumn("_rn", F.row_number().over(part.orderBy("r", "date")))
        .withColumn("_w", F.exp(F.sum(alive).over(by_date)))
    )
    x = x.withColumn("_dd", 1 - F.col("_w") / F.max("_w").over(by_date))
    x = x.withColumn("_dn", F.row_number().over(part.orderBy(F.col("_dd").desc(), "date")))
    r, m, n, rn, dd, dn = (F.col(c) for c in ("r", "_m", "_n", "_rn", "_dd", "_dn"))
    d = r - m
    down = F.least(d, F.lit(0.0))
    tail = F.round((1 - beta) * n, 9)
    worst = F.greatest(F.lit(1), F.floor(tail))
    at = F.greatest(F.lit(1), F.ceil(tail))
    semi = F.sum(down * down)
    below = F.count_if(d < 0)
    semi = (
        F.when(below < 2, 0.0).otherwise(semi / F.nullif(below, F.lit(0))) if downside_rows_only else semi / F.count(F.lit(1))
    )
    gini = F.try_divide(2 * F.sum((2 * rn - n - 1) * r), F.max(n * (n - 1)))
    out = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("r").alias("mean"),
        F.coalesce(F.var_samp("r"), F.lit(0.0)).alias("variance"),
        semi.alias("semi_variance"),
        F.avg(F.abs(d)).alias("mean_absolute_deviation"),
        F.avg(-down).alias("first_lower_partial_moment"),
        gini.alias("gini_mean_difference"),
        F.avg(d * d * d).alias("_m3"),
        F.avg(d * d * d * d).alias("fourth_central_moment"),
        F.avg(down * down * down * down).alias("fourth_lower_partial_moment"),
        F.max(F.when(rn == at, -r)).alias("value_at_risk"),
        F.avg(F.when(rn <= worst, -r)).alias("cvar"),
        _entropic(-r, beta).alias("entropic_value_at_risk"),
        F.ln(F.avg(F.exp(-r)) / (1 - beta)).alias("entropic_risk"),
        F.greatest(-F.min("r"), F.lit(0.0)).alias("worst_realization"),
        F.max("_dd").alias("max_drawdown"),
        F.avg("_dd").alias("average_drawdown"),
        F.avg(F.when(dn <= worst, dd)).alias("cdar"),
        F.max(F.when(dn == at, dd)).alias("drawdown_at_risk"),
        _entropic(dd, beta).alias("entropic_drawdown_at_risk"),
        F.sqrt(F.avg(dd * dd)).alias("ulcer_index"),
        F.bool_or(r <= -1).alias("ruined"),
    )
    sd = F.sqrt("variance")
    return (
        out.withColumn("standard_deviation", sd)
        .withColumn("semi_deviation", F.sqrt("semi_variance"))
        .withColumn("skew", F.try_divide(F.col("_m3"), F.col("variance") * sd))
        .withColumn("kurtosis", F.try_divide(F.col("fourth_central_moment"), F.col("variance") * F.col("variance")))
        .drop("_m3")
    )


def ratio_table(risks: DataFrame, risk_free: float = 0.0, periods: int = 252, extra: Column | None = None) -> DataFrame:
    """(mean - rf) over each measure, annualized Sharpe and Sortino; ``extra`` is a user score."""
    excess = F.col("mean") - risk_free
    ratios = [F.try_divide(excess, F.col(m)).alias(f"{m}_ratio") for m in MEASURES if m not in ("variance", "semi_variance")]
    root = float(periods) ** 0.5
    more = [] if extra is None else [extra.alias("score")]
    return risks.select(
        "portfolio", "mean", *ratios,
        (F.try_divide(excess, F.col("standard_deviation")) * root).alias("annualized_sharpe"),
        (F.try_divide(excess, F.col("semi_deviation")) * root).alias("annualized_sortino"),
        *more,
    )


def information_ratio(rows: DataFrame, benchmark: DataFrame, periods: int = 252) -> DataFrame:
    """Yearly active return over yearly tracking error; 0 when the error is 0. ``benchmark`` is (date, b)."""
    a = F.col("r") - F.col("b")
    s = rows.join(benchmark, "date").groupBy("portfolio").agg(F.avg(a).alias("m"), F.stddev_samp(a).alias("sd"))
    root = float(periods) ** 0.5
    return s.select("portfolio", F.coalesce(F.try_divide(F.col("m") * periods, F.col("sd") * root), F.lit(0.0)).alias("information_ratio"))


def summary(rows: DataFrame, periods: int = 252) -> DataFrame:
    """mean, annualized mean, variance, deviation, Sharpe, Sortino, max drawdown and CVaR per portfolio."""
    t = risk_table(rows)
    return t.select(
        "portfolio", "mean", (F.col("mean") * periods).alias("annualized_mean"), "variance", "standard_deviation",
        F.try_divide(F.col("mean"), F.col("standard_deviation")).alias("sharpe_ratio"),
        F.try_divide(F.col("mean"), F.col("semi_deviation")).alias("sortino_ratio"), "max_drawdown", "cvar",
    )


# Regime risk

MIN_STATE_ROWS = 5


def assigned_states(probs: DataFrame) -> DataFrame:
    """(date, state): the most probable state, the lowest of equals."""
    return probs.groupBy("date").agg(F.max_by("state", F.struct("p", -F.col("state"))).alias("state"))


def blended_risk(rows: DataFrame, probs: DataFrame, measures: Sequence[str], beta: float = 0.95) -> DataFrame:
    """sum over states of last probability * the state's own measure on its dates;
    a state with few dates takes the full sample."""
    bad = [m for m in measures if m not in MEASURES or m.startswith("entropic")]
    if bad:
        raise ConfigurationError(f"unsupported regime measures {bad}")
    common = rows.join(assigned_states(probs), "date")
    own = risk_table(common, ("portfolio", "state"), beta, downside_rows_only=True)
    full = risk_table(common, ("portfolio",), beta, downside_rows_only=True)

    def pick(prefix: str) -> Column:
        out = F.lit(None).cast("double")
        for s, m in enumerate(measures):
            out = F.when(F.col("state") == s, F.col(f"{prefix}{m}")).otherwise(out)
        return out

    used = sorted(set(measures))
    full = full.select("portfolio", *[F.col(m).alias(f"f_{m}") for m in used])
    own = own.select("portfolio", "state", F.col("n").alias("n_state"), *[F.col(m).alias(f"o_{m}") for m in used])
    grid = full.select("*", F.explode(F.array(*[F.lit(s) for s in range(len(measures))])).alias("state"))
    joined = grid.join(own, ["portfolio", "state"], "left").join(last_probabilities(probs), "state")
    risk = F.when(F.coalesce("n_state", F.lit(0)) >= MIN_STATE_ROWS, pick("o_")).otherwise(pick("f_"))
    return joined.groupBy("portfolio").agg(F.sum(F.when(F.col("p") > 0, F.col("p") * risk).otherwise(0.0)).alias("blended_risk"))


def regime_budget(budgets: DataFrame, probs: DataFrame) -> DataFrame:
    """(asset, budget): probability-weighted state budgets, normalized; equal when the total is not positive."""
    b = budgets.join(last_probabilities(probs), "state").groupBy("asset").agg(F.sum(F.col("p") * F.col("b")).alias("b"))
    total = b.agg(F.sum("b").alias("t"), F.count(F.lit(1)).alias("n"))
    return attach_one(b, total).select("asset", F.when(F.col("t") > 0, F.col("b") / F.col("t")).otherwise(1.0 / F.col("n")).alias("budget"))


def dominant_state(probs: DataFrame) -> DataFrame:
    """One row: the most probable state on the last date."""
    return last_probabilities(probs).agg(F.max_by("state", F.struct("p", -F.col("state"))).alias("state"))


# Contributions


def risk_contributions(cov: DataFrame, weights: DataFrame, budgets: DataFrame | None = None) -> DataFrame:
    """Per portfolio and asset: share of risk, gap to the budget (equal if none), diversification ratio."""
    wi = weights.select("portfolio", F.col("asset").alias("asset_i"), F.col("w").alias("wi"))
    cov = cut(cov.select("asset_i", "asset_j", "cov"))  # read for the product, its sizes and the diagonal
    own = cov.where("asset_i = asset_j").select("asset_i", F.col("cov").alias("var"))
    left = weights.select("portfolio", F.col("asset").alias("asset_j"), F.col("w").alias("a"))
    rows = rectangular(left, cov.select("asset_j", "asset_i", F.col("cov").alias("b")), ["portfolio"], "asset_j", "asset_i", "cw").join(own, "asset_i")
    rows = rows.join(wi, ["portfolio", "asset_i"])
    total = rows.groupBy("portfolio").agg(
        F.sum(F.col("wi") * F.col("cw")).alias("pv"), F.sum(F.col("wi") * F.sqrt("var")).alias("ws"), F.count(F.lit(1)).alias("k")
    )
    out = rows.join(total, "portfolio").select(
        "portfolio", F.col("asset_i").alias("asset"),
        (F.col("wi") * F.col("cw") / F.sqrt("pv")).alias("contribution"),
        (F.col("wi") * F.col("cw") / F.col("pv")).alias("share"),
        (F.col("ws") / F.sqrt("pv")).alias("diversification_ratio"), "k",
    )
    if budgets is None:
        return out.withColumn("gap", F.col("share") - 1.0 / F.col("k")).drop("k")
    return out.join(budgets.select("asset", "budget"), "asset", "left").withColumn(
        "gap", F.col("share") - F.coalesce("budget", F.lit(0.0))
    ).drop("k", "budget")
