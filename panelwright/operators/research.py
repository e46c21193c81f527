"""Factor validation: information coefficients, spreads, tests and collinearity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.config import FACTOR_GROUPS, SPREAD_BANDS
from panelwright.errors import DataError
from panelwright.functions.columns import finite
from panelwright.functions.dist import by_calendar, group_quantiles, with_average_ranks, with_group_stats
from panelwright.functions.stats import t_two_sided
from panelwright.operators.standardize import components_for, fit_components, standardized_rows


def paired(scores: DataFrame, forward: DataFrame, x: str = "x") -> DataFrame:
    """Scores joined to the forward returns of their date, both present."""
    return (
        scores.where(F.col(x).isNotNull())
        .join(forward.where(F.col("fwd").isNotNull()).select("date", "ticker", "fwd"), ["date", "ticker"])
    )


def rank_ic(pairs: DataFrame, keys: Sequence[str] = ("factor", "date"), x: str = "x") -> DataFrame:
    """Spearman correlation of score and forward return per group; null below 3 names."""
    ranked = with_average_ranks(pairs, keys, {x: "_rx", "fwd": "_ry"})
    return ranked.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) >= 3, finite(F.corr("_rx", "_ry"))).alias("ic")
    )


def ic_series(scores: DataFrame, forward: DataFrame, x: str = "x") -> DataFrame:
    """(factor, date, ic) over the dates both tables share; undefined dates are skipped."""
    return rank_ic(paired(scores, forward, x), x=x).where(F.col("ic").isNotNull())


def icir(ic: DataFrame, key: str = "factor") -> DataFrame:
    """Mean over deviation; 0 with fewer than 2 points or no deviation."""
    return ic.groupBy(key).agg(F.coalesce(F.try_divide(F.avg("ic"), F.stddev_samp("ic")), F.lit(0.0)).alias("icir"))


def ic_stats(ic: DataFrame, lags: int = 5, key: str = "factor") -> DataFrame:
    """n, mean, sd, ICIR, Newey-West variance, t and two-sided p per factor.

    The lag terms are means over the n - lag products, with Bartlett weights.
    A factor's series has one row per date, so its window is bounded by the calendar.
    """
    d = with_group_stats(ic.where(F.col("ic").isNotNull()), [key], F.avg("ic").alias("_m"))
    w = Window.partitionBy(key).orderBy("date")
    dev = F.col("ic") - F.col("_m")
    rows = d.select(
        key, "ic", (dev * dev).alias("_g0"), *[(dev * F.lag(dev, k).over(w)).alias(f"_g{k}") for k in range(1, lags + 1)]
    )
    nw = F.avg("_g0")
    for k in range(1, lags + 1):
        nw = nw + F.coalesce(F.avg(f"_g{k}"), F.lit(0.0)) * (2 * (1 - k / (lags + 1)))
    agg = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_std"),
        F.greatest(nw, F.lit(1e-12)).alias("variance_nw"),
    )
    short = F.col("n") < 3
    t = F.when(short, 0.0).otherwise(F.col("mean_ic") / F.sqrt(F.col("variance_nw") / F.col("n")))
    return (
        agg.withColumn("t_stat", t)
        .withColumn("p_value", F.when(short, 1.0).otherwise(t_two_sided(F.col("t_stat"), F.greatest(F.col("n") - 1, F.lit(1)))))
        .withColumn("icir", F.coalesce(F.try_divide(F.col("mean_ic"), F.col("ic_std")), F.lit(0.0)))
    )


def adjust_p_values(rows: DataFrame, alpha: float = 0.05, p: str = "p_value", key: str = "factor") -> DataFrame:
    """Holm and Benjamini-Hochberg adjusted p-values and their flags (one row per factor)."""
    by_p = Window.orderBy(p, key)
    m = F.count(F.lit(1)).over(Window.partitionBy())
    rn = F.row_number().over(by_p)
    step = rows.withColumn("_rn", rn).withColumn("_m", m)
    holm = F.max(F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_rn") + 1))).over(by_p.rowsBetween(Window.unboundedPreceding, 0))
    bh = F.min(F.least(F.lit(1.0), F.col(p) * F.col("_m") / F.col("_rn"))).over(by_p.rowsBetween(0, Window.unboundedFollowing))
    return (
        step.withColumn("p_holm", holm).withColumn("p_bh", bh).drop("_rn", "_m")
        .withColumn("significant_holm", F.col("p_holm") <= alpha)
        .withColumn("significant_bh", F.col("p_bh") <= alpha)
    )


def bh_rejections(rows: DataFrame, alpha: float = 0.05, p: str = "p_value", key: str = "factor") -> DataFrame:
    """Flag of all p-values up to the last one under alpha * rank / n."""
    rn = F.row_number().over(Window.orderBy(p, key))
    every = Window.partitionBy()
    ranked = rows.withColumn("_rn", rn).withColumn("_m", F.count(F.lit(1)).over(every))
    last = F.max(F.when(F.col(p) <= alpha * F.col("_rn") / F.col("_m"), F.col("_rn"))).over(every)
    return ranked.withColumn("rejected", F.coalesce(F.col("_rn") <= last, F.lit(False))).drop("_rn", "_m")


def factor_universe_report(ic: DataFrame, lags: int = 5, alpha: float = 0.05) -> DataFrame:
    return adjust_p_values(ic_stats(ic, lags), alpha)


def quantile_buckets(pairs: DataFrame, n: int, keys: Sequence[str], x: str = "x") -> DataFrame:
    """Bucket 0.. by the group's quantile edges; equal edges merge, intervals are closed on the right."""
    cuts = group_quantiles(pairs, keys, x, {f"_e{i}": i / n for i in range(n + 1)}, n_out="n_names")
    edges = F.array_distinct(F.array(*[F.col(f"_e{i}") for i in range(n + 1)]))
    cuts = cuts.select(*keys, "n_names", edges.alias("_edges"))
    inner = F.slice(F.col("_edges"), F.lit(2), F.greatest(F.size("_edges") - 1, F.lit(0)))
    bucket = F.size(F.filter(inner, lambda e: e < F.col(x)))
    return pairs.join(by_calendar(cuts, keys), list(keys)).withColumn("bucket", bucket).drop("_edges")


def quantile_spread(pairs: DataFrame, n: int = 5, keys: Sequence[str] = ("factor", "date"), x: str = "x") -> DataFrame:
    """Mean return of the top bucket minus the bottom bucket; null with too few names or buckets."""
    b = quantile_buckets(pairs, n, keys, x).groupBy(*keys, "bucket", "n_names").agg(F.avg("fwd").alias("_m"))
    return b.groupBy(*keys).agg(
        F.when(
            (F.max("n_names") >= n) & (F.count(F.lit(1)) >= 2),
            F.max_by("_m", "bucket") - F.min_by("_m", "bucket"),
        ).alias("spread")
    )


def _correlation(table: DataFrame, names: Sequence[str]):
    rows, n = standardized_rows(table, names)
    return Correlation.corr(rows, "_v").first()[0].toArray(), n


def variance_inflation(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """1 / (1 - R2) of each factor on the others: the diagonal of the inverse correlation matrix.

    Only the k x k matrix of factors reaches the driver.
    """
    spark = table.sparkSession
    try:
        corr, _ = _correlation(table, names)
    except DataError:
        return spark.createDataFrame([(n, 1.0) for n in names], "factor string, vif double")
    corr = np.where(np.isnan(corr), np.eye(len(names)), corr)
    values = []
    for i in range(len(names)):
        rest = [j for j in range(len(names)) if j != i]
        r2 = float(corr[i, rest] @ np.linalg.lstsq(corr[np.ix_(rest, rest)], corr[rest, i], rcond=None)[0])
        values.append(float("inf") if r2 >= 1.0 - 1e-12 else 1.0 / (1.0 - r2))
    return spark.createDataFrame(list(zip(names, values)), "factor string, vif double")


def redundant_factors(table: DataFrame, names: Sequence[str], threshold: float = 10.0) -> DataFrame:
    return variance_inflation(table, names).where(F.col("vif") > threshold)


def factor_components(table: DataFrame, names: Sequence[str], k: int | None = None) -> DataFrame:
    """(component, explained, cumulated, needed_95, factor, loading) of the factor correlations."""
    rows, _ = standardized_rows(table, names)
    loadings, ratios = fit_components(rows, k or len(names))
    need = components_for(ratios, 0.95)
    out, total = [], 0.0
    for i, share in enumerate(ratios):
        total += share
        out += [(f"PC{i + 1}", share, total, need, f, loadings[i][j]) for j, f in enumerate(names)]
    return table.sparkSession.createDataFrame(
        out, "component string, explained double, cumulated double, needed_95 int, factor string, loading double"
    )


def _band(factor: Column, side: int) -> Column:
    m = F.create_map(*[F.lit(v) for f, g in FACTOR_GROUPS.items() for v in (f, SPREAD_BANDS[g][side])])
    return F.element_at(m, factor)


def validation_report(
    scores: DataFrame, forward: DataFrame, lags: int = 6, n_quantiles: int = 5, t_threshold: float = 2.0, alpha: float = 0.05
) -> DataFrame:
    """Per factor: IC statistics, the latest quantile spread with its usual band, adjusted p-values."""
    pairs = paired(scores, forward)
    stats = adjust_p_values(ic_stats(rank_ic(pairs).where(F.col("ic").isNotNull()), lags), alpha)
    latest = (
        scores.select("factor", "date").distinct().join(forward.select("date").distinct(), "date")
        .groupBy("factor").agg(F.max("date").alias("date"))
    )
    spreads = quantile_spread(pairs.join(latest, ["factor", "date"], "left_semi"), n_quantiles)
    size = F.abs("spread")
    inside = (size >= _band(F.col("factor"), 0)) & (size <= _band(F.col("factor"), 1))
    return stats.join(spreads.select("factor", "spread"), "factor", "left").select(
        "factor", "mean_ic", "ic_std", "t_stat", "p_value", (F.abs("t_stat") >= t_threshold).alias("significant"),
        "spread", F.when(F.col("spread").isNotNull(), F.coalesce(inside, F.lit(False))).alias("within_band"),
        "significant_holm", "significant_bh",
    )
