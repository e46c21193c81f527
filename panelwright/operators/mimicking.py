"""Factor-mimicking portfolios and quantile portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.errors import ConfigurationError
from panelwright.functions.dist import with_row_number
from panelwright.functions.pairs import mirrored, pair_sums, with_moments

_KEYS = ["factor", "date"]


def _legs(pairs: DataFrame, quantile: float) -> DataFrame:
    """Rows in the top (side 1) or bottom (side -1) k names of their date; ranks by (score, ticker)."""
    if not 0.0 < quantile <= 0.5:
        raise ConfigurationError("quantile must be in (0, 0.5]")
    rows = with_row_number(pairs, _KEYS, "x", "ticker", "_rn", "_n")
    k = F.greatest(F.lit(1), F.ceil(F.round(F.col("_n") * quantile, 9)))
    side = F.when(F.col("_rn") > F.col("_n") - k, 1).when(F.col("_rn") <= k, -1)
    return rows.withColumn("_k", k).withColumn("side", F.when(F.col("_n") >= 2 * F.col("_k"), side))


def _leg_mean(side: int, weighting: str) -> Column:
    r = F.when(F.col("side") == side, F.col("fwd"))
    plain = F.avg(r)
    if weighting == "equal":
        return plain
    w = F.when(F.col("side") == side, F.abs("x"))
    return F.when(F.sum(w) > 0, F.sum(w * r) / F.sum(w)).otherwise(plain)


def leg_returns(pairs: DataFrame, quantile: float = 0.3, weighting: str = "equal") -> DataFrame:
    """(factor, date, long_r, short_r); null on dates with fewer than 2k names.

    ``pairs`` has factor, date, ticker, x and the return of the date as fwd.
    """
    if weighting not in ("equal", "value"):
        raise ConfigurationError(f"unknown weighting {weighting!r}")
    return _legs(pairs, quantile).groupBy(*_KEYS).agg(
        _leg_mean(1, weighting).alias("long_r"), _leg_mean(-1, weighting).alias("short_r")
    )


def long_short(pairs: DataFrame, quantile: float = 0.3, weighting: str = "equal") -> DataFrame:
    return leg_returns(pairs, quantile, weighting).select(*_KEYS, (F.col("long_r") - F.col("short_r")).alias("factor_return"))


def _beta(leg: str) -> Column:
    y = F.when(F.col("m").isNotNull(), F.col(leg))
    var = F.var_samp(F.when(y.isNotNull(), F.col("m")))
    return F.when((F.count(y) < 2) | (var < 1e-20), 1.0).otherwise(F.covar_samp(y, F.col("m")) / var)


def beta_neutral(pairs: DataFrame, market: DataFrame, quantile: float = 0.3) -> DataFrame:
    """Long leg minus hedge * short leg, hedge = beta_long / beta_short over the whole period."""
    legs = leg_returns(pairs, quantile)
    hedge = (
        legs.join(market.select("date", "m"), "date", "left")
        .groupBy("factor")
        .agg(_beta("long_r").alias("bl"), _beta("short_r").alias("bs"))
        .select("factor", F.when(F.abs("bs") > 1e-10, F.col("bl") / F.col("bs")).otherwise(1.0).alias("hedge"))
    )
    return legs.join(hedge, "factor").select(*_KEYS, (F.col("long_r") - F.col("hedge") * F.col("short_r")).alias("factor_return"))


def factor_correlation(returns: DataFrame) -> DataFrame:
    """Pairwise-complete Pearson correlation of factor returns, all ordered pairs."""
    cells = returns.select("date", F.col("factor").alias("ticker"), F.col("factor_return").alias("r"))
    return mirrored(with_moments(pair_sums(cells))).select(
        F.col("asset_i").alias("factor_i"), F.col("asset_j").alias("factor_j"), "corr"
    )


def quantile_portfolios(pairs: DataFrame, n: int = 5) -> DataFrame:
    """(factor, date, q1..qn, spread): mean returns of equal-sized buckets of the broken ranks.

    The bucket edges of ranks 1..N lie at 1 + (N - 1) * i / n; whole-number arithmetic.
    """
    rows = with_row_number(pairs, _KEYS, "x", "ticker", "_rn", "_n")
    steps = F.floor(((F.col("_rn") - 1) * n + F.col("_n") - 2) / (F.col("_n") - 1))
    bucket = F.when(F.col("_n") >= n, F.greatest(F.lit(1), steps))
    means = [F.avg(F.when(F.col("_b") == i, F.col("fwd"))).alias(f"q{i}") for i in range(1, n + 1)]
    out = rows.withColumn("_b", bucket).groupBy(*_KEYS).agg(*means)
    return out.withColumn("spread", F.col(f"q{n}") - F.col("q1"))


def spread_summary(portfolios: DataFrame, periods: int = 252) -> DataFrame:
    """Annualized mean, t and Sharpe of the top-minus-bottom spread per factor."""
    s = portfolios.groupBy("factor").agg(
        F.count("spread").alias("n"), F.avg("spread").alias("m"), F.stddev_samp("spread").alias("sd")
    )
    ok = (F.col("n") > 1) & (F.col("sd") > 0)
    return s.select(
        "factor",
        (F.col("m") * periods).alias("annualized_mean"),
        F.when(ok, F.col("m") / (F.col("sd") / F.sqrt("n"))).alias("t_stat"),
        F.when(ok, F.col("m") * F.sqrt(F.lit(float(periods))) / F.col("sd")).alias("sharpe"),
    )
