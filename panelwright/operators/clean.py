"""Return cleaning, imputation and asset pre-selection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.config import CleaningConfig
from panelwright.errors import DataError
from panelwright.functions.columns import clip
from panelwright.functions.dist import attach_one, by_calendar, in_ranges
from panelwright.functions.pairs import correlations_above, mirrored, pair_sums, with_moments
from panelwright.session import cut
from panelwright.sources.panel import date_axis, dense, with_axis

GROUP_PAIRS = 4_000_000  # correlated pairs that one task goes through in order


def validate(returns: DataFrame, max_abs: float = 10.0) -> DataFrame:
    """NaN, infinities and |r| above the limit become null."""
    r = F.col("r")
    return returns.withColumn("r", F.when(~F.isnan(r) & (F.abs(r) <= max_abs), r))


def outlier_stats(train: DataFrame) -> DataFrame:
    """Mean and standard deviation per asset, learned on the training rows."""
    return train.groupBy("ticker").agg(F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("sd_r"))


def treat_outliers(returns: DataFrame, stats: DataFrame, winsor_z: float = 3.0, remove_z: float = 10.0) -> DataFrame:
    """|z| >= remove_z to null, winsor_z <= |z| < remove_z clipped; zero deviation untouched."""
    rows = returns.join(stats, "ticker", "left")
    r, m, s = F.col("r"), F.col("mean_r"), F.col("sd_r")
    z = F.abs(F.try_divide(r - m, s))
    fixed = (
        F.when(z.isNull(), r)
        .when(z >= remove_z, F.lit(None))
        .when(z >= winsor_z, clip(r, m - winsor_z * s, m + winsor_z * s))
        .otherwise(r)
    )
    return rows.withColumn("r", fixed).select(*returns.columns)


def impute_by_sector(returns: DataFrame, sectors: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Null cells take the sector mean of the date, else the mean of the date; cells of the tickers in ``only``, if given.

    The filled cell is null itself, so the leave-one-out mean is the plain mean. Means are those of
    all tickers. Names without a sector form one group. The means, a row per calendar day and sector,
    are broadcast, so the cells stay with their ticker.
    """
    returns = returns.select("date", "ticker", "r")

    def with_sector(rows: DataFrame) -> DataFrame:
        return rows.join(sectors.select("ticker", "sector"), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("")))

    known = with_sector(returns.where(F.col("r").isNotNull() & F.col("date").isNotNull() & F.col("ticker").isNotNull()))
    by_sector = known.groupBy("date", "sector").agg(F.sum("r").alias("_s"), F.count("r").alias("_n"))
    by_date = by_sector.groupBy("date").agg(F.sum("_s").alias("_ds"), F.sum("_n").alias("_dn"))
    return (
        with_sector(dense(returns, "r", only)).where(F.col("date").isNotNull())
        .join(F.broadcast(by_sector), ["date", "sector"], "left")
        .join(by_calendar(by_date, ["date"]), "date", "left")
        .select(
            "date", "ticker",
            F.coalesce("r", F.try_divide(F.col("_s"), F.col("_n")), F.try_divide(F.col("_ds"), F.col("_dn"))).alias("r"),
        )
    )


def nearest_assets(returns: DataFrame, k: int = 5) -> DataFrame:
    """(ticker, nb, rnk): the k assets with the largest absolute pairwise-complete correlation."""
    pairs = mirrored(with_moments(pair_sums(returns))).where(
        (F.col("asset_i") != F.col("asset_j")) & F.col("corr").isNotNull()
    )
    # Correlations are rounded for the ordering, so equal ones tie and fall to the name.
    w = Window.partitionBy("asset_i").orderBy(F.round(F.abs("corr"), 12).desc(), "asset_j")
    return pairs.select(F.col("asset_i").alias("ticker"), F.col("asset_j").alias("nb"), F.row_number().over(w).alias("rnk")).where(
        F.col("rnk") <= k
    )


def _neighbour_rows(cells: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Per (ticker, date): x1..xk of the neighbours (0 where the rank does not exist), all present?"""
    obs = cells.where(F.col("r").isNotNull()).select("date", F.col("ticker").alias("nb"), F.col("r").alias("x"))
    size = near.groupBy("ticker").agg(F.count(F.lit(1)).alias("k_have"))
    xs = [F.coalesce(F.max(F.when(F.col("rnk") == i, F.col("x"))), F.lit(0.0)).alias(f"x{i}") for i in range(1, k + 1)]
    return (
        near.join(obs, "nb")
        .groupBy("ticker", "date")
        .agg(F.count(F.lit(1)).alias("k_here"), *xs)
        .join(size, "ticker")
        .where(F.col("k_here") == F.col("k_have"))
        .drop("k_here", "k_have")
    )


def regression_coefficients(returns: DataFrame, near: DataFrame, k: int = 5, min_rows: int = 60) -> DataFrame:
    """OLS with intercept of each asset on its neighbours over the complete rows.

    The normal equations are aggregated by Spark; a task only solves the small system.
    """
    rows = _neighbour_rows(returns, near, k).join(
        returns.where(F.col("r").isNotNull()).select("ticker", "date", "r"), ["ticker", "date"]
    )
    z: list[Column] = [F.lit(1.0), *[F.col(f"x{i}") for i in range(1, k + 1)]]
    size = k + 1
    sums = [F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i in range(size) for j in range(i, size)]
    sums += [F.sum(z[i] * F.col("r")).alias(f"h{i}") for i in range(size)]
    eqs = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") >= min_rows)

    def solve(frames):
        for f in frames:
            out = {"ticker": f["ticker"].to_numpy()}
            beta = np.zeros((len(f), size))
            for row in range(len(f)):
                g = np.zeros((size, size))
                for i in range(size):
                    for j in range(i, size):
                        g[i, j] = g[j, i] = f[f"g{i}_{j}"].iat[row]
                h = np.array([f[f"h{i}"].iat[row] for i in range(size)])
                beta[row] = np.linalg.lstsq(g, h, rcond=None)[0]
            for i in range(size):
                out[f"b{i}"] = beta[:, i]
            yield pd.DataFrame(out)

    return eqs.mapInPandas(solve, "ticker string, " + ", ".join(f"b{i} double" for i in range(size)))


def impute_by_regression(returns: DataFrame, train: DataFrame, sectors: DataFrame, k: int = 5, min_rows: int = 60) -> DataFrame:
    """Null cells are predicted from observed neighbours where all are present, else by sector."""
    near = nearest_assets(train, k)
    beta = regression_coefficients(train, near, k, min_rows)
    guess = F.col("b0")
    for i in range(1, k + 1):
        guess = guess + F.col(f"b{i}") * F.col(f"x{i}")
    fitted = _neighbour_rows(returns, near, k).join(beta, "ticker").select("date", "ticker", guess.alias("fit"))
    observed = returns.select("date", "ticker", F.col("r").alias("obs"))
    return (
        impute_by_sector(returns, sectors)
        .join(observed, ["date", "ticker"], "left")
        .join(fitted, ["date", "ticker"], "left")
        .select("date", "ticker", F.coalesce("obs", "fit", "r").alias("r"))
    )


def apply_delisting_returns(returns: DataFrame, delistings: DataFrame, check: bool = True) -> DataFrame:
    """Replace the last non-null return of each delisted ticker."""
    if check:
        unknown = delistings.join(returns.select("ticker").distinct(), "ticker", "left_anti").limit(1).count()
        if unknown:
            raise DataError("a delisted ticker has no column of returns")
    last = (
        returns.where(F.col("r").isNotNull())
        .join(delistings.select("ticker", "delisting_return"), "ticker")
        .groupBy("ticker", "delisting_return")
        .agg(F.max("date").alias("last_date"))
    )
    return returns.join(last, "ticker", "left").withColumn(
        "r", F.when(F.col("date") == F.col("last_date"), F.col("delisting_return")).otherwise(F.col("r"))
    ).select(*returns.columns)


def complete_assets(returns: DataFrame) -> DataFrame:
    """Tickers with a return on every panel date."""
    axis = date_axis(returns).agg(F.max("idx").alias("n_dates"))
    counts = returns.groupBy("ticker").agg(F.count("r").alias("n"))
    return attach_one(counts, axis).where(F.col("n") == F.col("n_dates")).select("ticker")


def varying_assets(returns: DataFrame, floor: float = 1e-8) -> DataFrame:
    return returns.groupBy("ticker").agg(F.var_samp("r").alias("v")).where(F.col("v") > floor).select("ticker")


def correlated_assets(returns: DataFrame, threshold: float = 0.95, absolute: bool = False) -> DataFrame:
    """Tickers to drop: pairs above the threshold are taken from the highest correlation
    down, and of two assets still present the one with the higher mean correlation goes.

    Done in rounds: a pair that is the highest open pair of both its assets can be
    decided at once, which gives the same result as one pass over the sorted pairs. Assets
    with the same first neighbour are a group, whose inner pairs one task goes through in
    order, as far as no open pair to another group ranks above them.
    """
    above, mean = correlations_above(returns, threshold, absolute)
    dropped = above.select(F.col("asset_i").alias("ticker")).limit(0)
    if above.isEmpty():
        return dropped
    open_pairs = (
        above.join(mean.select(F.col("asset").alias("asset_i"), F.col("m").alias("m_i")), "asset_i")
        .join(mean.select(F.col("asset").alias("asset_j"), F.col("m").alias("m_j")), "asset_j")
        .select(
            "asset_i", "asset_j",
            F.struct("corr", "asset_i", "asset_j").alias("rank"),
            F.when(F.round(F.col("m_i") - F.col("m_j"), 12) > 0, F.col("asset_i")).otherwise(F.col("asset_j")).alias("loser"),
        )
    )
    open_pairs = cut(open_pairs)
    while not open_pairs.isEmpty():
        gone = cut(_decided(open_pairs))
        dropped = dropped.unionByName(gone)
        # The winner's decided pair ends with its loser, so it leaves the table too.
        open_pairs = cut(
            open_pairs.join(gone.select(F.col("ticker").alias("asset_i")), "asset_i", "left_anti")
            .join(gone.select(F.col("ticker").alias("asset_j")), "asset_j", "left_anti")
        )
    return dropped.distinct()


def _on_both(pairs: DataFrame, assets: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """The columns of the two assets of a pair, as ``<column>_i`` and ``<column>_j``."""
    for end in "ij":
        pairs = pairs.join(assets.select(F.col("asset").alias(f"asset_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in columns]), f"asset_{end}", how)
    return pairs


def _decided(open_pairs: DataFrame) -> DataFrame:
    """(ticker): losers of the pairs that can be decided in this round, among them the highest of all."""
    both = F.explode(F.array(F.struct(F.col("asset_i").alias("asset"), F.col("asset_j").alias("other")), F.struct(F.col("asset_j").alias("asset"), F.col("asset_i").alias("other"))))
    ends = open_pairs.select(both.alias("_e"), "rank").select("_e.*", "rank")
    per = ends.groupBy("asset").agg(F.min(F.least("asset", "other")).alias("label"), F.max("rank").alias("best"))
    tagged = _on_both(open_pairs, per, "label", "best").withColumn("grp", F.when(F.col("label_i") == F.col("label_j"), F.col("label_i")))
    large = tagged.where("grp IS NOT NULL").groupBy("grp").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP_PAIRS)
    tagged = tagged.join(large, "grp", "left").withColumn("grp", F.when(F.col("_n").isNull(), F.col("grp")))
    tagged = cut(tagged.select("grp", "asset_i", "asset_j", "rank", "loser", ((F.col("rank") == F.col("best_i")) & (F.col("rank") == F.col("best_j"))).alias("top")))
    outer = tagged.where("grp IS NULL")
    limit = outer.select(F.explode(F.array("asset_i", "asset_j")).alias("asset"), "rank").groupBy("asset").agg(F.max("rank").alias("limit"))
    inner = _on_both(tagged.where("grp IS NOT NULL"), limit, "limit", how="left")
    for end in "ij":
        inner = inner.withColumn(f"free_{end}", F.coalesce(F.col("rank") > F.col(f"limit_{end}"), F.lit(True)))
    rows = inner.select("grp", "asset_i", "asset_j", "loser", "rank", (F.col("free_i") & F.col("free_j")).alias("free"))
    rows = rows.repartition("grp").sortWithinPartitions("grp", F.col("rank").desc()).drop("rank")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, gone, waiting = None, set(), set()
        for frame in frames:
            lost = []
            for g, i, j, loser, free in zip(*(frame[c].tolist() for c in ("grp", "asset_i", "asset_j", "loser", "free"))):
                if g != group:
                    group, gone, waiting = g, set(), set()
                if i in gone or j in gone:
                    continue
                if free and i not in waiting and j not in waiting:
                    gone.add(loser)
                    lost.append(loser)
                else:
                    waiting |= {i, j}
            yield pd.DataFrame({"ticker": lost}, dtype=object)

    found = rows.mapInPandas(run, "ticker string")
    return outer.where("top").select(F.col("loser").alias("ticker")).unionByName(found).distinct()


def best_assets(returns: DataFrame, k: int, top: bool = True) -> DataFrame:
    """Top (or bottom) k by mean return; every task keeps only its own k rows."""
    mean = returns.groupBy("ticker").agg(F.avg("r").alias("m"))
    order = F.round("m", 12).desc() if top else F.round("m", 12).asc()
    return mean.orderBy(order, "ticker").limit(k).select("ticker")


def pareto_front(points: DataFrame) -> DataFrame:
    """Rows of (ticker, mean, sd) that no other row beats in mean and sd.

    Sorted by (sd, mean descending) a row survives when its mean is a new maximum;
    exact duplicates of a survivor survive too. The running maximum goes across
    ranges of sd first and inside a range next, so no task sorts all assets.
    """
    known = points.where(F.col("mean").isNotNull() & F.col("sd").isNotNull())
    rows, path, _ = in_ranges(known, [], F.col("sd"), -F.col("mean"))
    before = Window.orderBy(*path).rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(*path).agg(F.max("mean").alias("top")).select(*path, F.max("top").over(before).alias("lower"))
    inside = (
        Window.partitionBy(*path).orderBy("sd", F.col("mean").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    prev = F.max(F.struct(F.col("mean").alias("m"), (-F.col("sd")).alias("s"))).over(inside)
    here = F.col("prev").isNull() | (F.col("mean") > F.col("prev.m")) | (
        (F.col("mean") == F.col("prev.m")) & (F.col("sd") == -F.col("prev.s"))
    )
    return (
        rows.withColumn("prev", prev)
        .join(bins, path)
        .where(here & (F.col("lower").isNull() | (F.col("mean") > F.col("lower"))))
        .select("ticker", "mean", "sd")
    )


def mean_sd_points(returns: DataFrame) -> DataFrame:
    return returns.groupBy("ticker").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"))


def not_expiring(assets: DataFrame, expiries: DataFrame, as_of, lookahead_days: int) -> DataFrame:
    """Assets whose expiry lies after the look-ahead window; no expiry never expires."""
    limit = F.date_add(F.lit(as_of).cast("date"), lookahead_days)
    return assets.join(expiries.select("ticker", "expiry"), "ticker", "left").where(
        F.col("expiry").isNull() | (F.col("expiry") > limit)
    ).select(*assets.columns)


def no_terminal_zero_returns(returns: DataFrame, final_periods: int = 12, tolerance: float = 1e-10) -> DataFrame:
    """One row: true (survivorship suspected) when no asset has a zero return in the last rows."""
    rows = with_axis(returns)
    zero = (F.abs("r") <= tolerance) & (F.col("idx") > F.col("n_dates") - final_periods)
    return rows.agg(
        (F.coalesce(F.max("n_dates") >= final_periods, F.lit(False)) & ~F.coalesce(F.bool_or(zero), F.lit(False))).alias("suspected")
    )


@dataclass
class FittedPreSelection:
    """Outlier statistics and surviving assets learned on the training rows."""

    stats: DataFrame
    assets: DataFrame
    sectors: DataFrame
    config: CleaningConfig

    def transform(self, returns: DataFrame) -> DataFrame:
        c = self.config
        rows = treat_outliers(validate(returns, c.max_abs_return), self.stats, c.winsor_z, c.remove_z)
        return impute_by_sector(rows, self.sectors, self.assets)


def fit_pre_selection(
    train: DataFrame, sectors: DataFrame, config: CleaningConfig | None = None,
    expiries: DataFrame | None = None, as_of=None,
) -> FittedPreSelection:
    """Validate, treat outliers, impute, then drop incomplete, flat and correlated assets;
    optional top k, Pareto front and expiry steps. Everything is learned on ``train``."""
    c = config or CleaningConfig()
    stats = cut(outlier_stats(validate(train, c.max_abs_return)))
    rows = impute_by_sector(treat_outliers(validate(train, c.max_abs_return), stats, c.winsor_z, c.remove_z), sectors)
    # Complete and varying by windows over the ticker, where the cells lie already; only these are written.
    width = date_axis(train.where(F.col("date").isNotNull())).agg(F.max("idx").alias("n_dates"))
    mine = Window.partitionBy("ticker")
    rows = attach_one(rows.withColumn("_n", F.count("r").over(mine)).withColumn("_v", F.var_samp("r").over(mine)), width)
    good = F.col("ticker").isNotNull() & (F.col("_n") == F.col("n_dates")) & (F.col("_v") > c.variance_floor)
    rows = cut(rows.where(good).select("date", "ticker", "r"))
    gone = correlated_assets(rows, c.correlation_threshold, c.absolute_correlation)
    assets = rows.select("ticker").distinct().join(gone, "ticker", "left_anti")
    if c.top_k is not None:
        assets = best_assets(rows.join(assets, "ticker", "left_semi"), c.top_k)
    if c.pareto:
        assets = pareto_front(mean_sd_points(rows.join(assets, "ticker", "left_semi"))).select("ticker")
    if c.expiry_lookahead_days is not None and expiries is not None:
        assets = not_expiring(assets, expiries, as_of, c.expiry_lookahead_days)
    return FittedPreSelection(stats, cut(assets), sectors, c)
