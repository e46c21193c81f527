"""Cross-validated backtests and parameter search in one plan over all folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelwright.functions.dist import attach_one
from panelwright.operators.portfolios import inverse_volatility
from panelwright.operators.risk import risk_table

Fit = Callable[[DataFrame, Sequence[str]], DataFrame]


def cross_val_predict(returns: DataFrame, folds: DataFrame, fit: Fit = inverse_volatility, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """(keys, date, r): weights fitted on each fold's training rows, applied to its test dates.

    ``fit(rows, keys)`` returns (keys, asset, w); all folds are fitted by one
    aggregate. Folds may carry a ticker (asset subsets).
    """
    on = ["date", "ticker"] if "ticker" in folds.columns else ["date"]
    rows = returns.where(F.col("r").isNotNull()).join(folds.select(*keys, "role", *on), on)
    weights = fit(rows.where(F.col("role") == "train"), list(keys))
    tests = rows.where(F.col("role") == "test").join(
        weights.select(*keys, F.col("asset").alias("ticker"), "w"), [*keys, "ticker"]
    )
    return tests.groupBy(*keys, "date").agg(F.sum(F.col("w") * F.col("r")).alias("r"))


def path_returns(predicted: DataFrame, folds: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, date, r): the fold of each (path, block) supplies the returns of the block's dates."""
    blocks = folds.where(F.col("role") == "test").select("fold", "block", "date")
    return paths.join(blocks, ["fold", "block"]).join(predicted, ["fold", "date"]).select("path", "date", "r")


def fit_by_rule(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weights for parameter rows: the ``top_k`` assets by mean return, proportional to sd^-power.

    ``keys`` includes param columns top_k and power carried by the rows.
    """
    stats = rows.groupBy(*keys, "top_k", "power", F.col("ticker").alias("asset")).agg(
        F.avg("r").alias("m"), F.stddev_samp("r").alias("sd")
    )
    w = Window.partitionBy(*keys).orderBy(F.round("m", 12).desc(), "asset")
    kept = stats.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.col("top_k"))
    kept = kept.withColumn("raw", F.pow(F.try_divide(F.lit(1.0), F.col("sd")), F.col("power")))
    total = kept.groupBy(*keys).agg(F.sum("raw").alias("t"))
    return kept.join(total, list(keys)).select(*keys, "asset", (F.col("raw") / F.col("t")).alias("w"))


def grid(spark, top_k: Sequence[int], power: Sequence[float]) -> DataFrame:
    """(param, top_k, power): every combination."""
    rows = [(i, k, float(p)) for i, (k, p) in enumerate((k, p) for k in top_k for p in power)]
    return spark.createDataFrame(rows, "param int, top_k int, power double")


def sampled(params: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n parameter rows by a seeded whole-number hash (the randomized search)."""
    h = (F.col("param").cast("long") * 7919 + seed * 104729) % 1009
    return params.withColumn("_h", (h * h) % 997).orderBy("_h", "param").limit(n).drop("_h")


def _with_params(folds: DataFrame, params: DataFrame) -> DataFrame:
    """Every fold row once per parameter row: the grid (small) travels as one array."""
    packed = params.agg(F.collect_list(F.struct("param", "top_k", "power")).alias("_p"))
    return attach_one(folds.select("fold", "role", "date"), packed).select(
        "fold", "role", "date", F.explode("_p").alias("p")
    ).select("fold", "role", "date", "p.param", "p.top_k", "p.power")


def search(returns: DataFrame, folds: DataFrame, params: DataFrame, score: str = "sharpe") -> DataFrame:
    """(param, top_k, power, score, best): mean fold score of every parameter row, all folds and
    parameters in one plan."""
    tagged = _with_params(folds, params)
    keys = ["param", "fold"]
    rows = returns.where(F.col("r").isNotNull()).join(tagged, "date")
    weights = fit_by_rule(rows.where(F.col("role") == "train"), keys)
    tests = rows.where(F.col("role") == "test").join(weights.select(*keys, F.col("asset").alias("ticker"), "w"), [*keys, "ticker"])
    series = tests.groupBy(*keys, "date").agg(F.sum(F.col("w") * F.col("r")).alias("r"))
    risks = risk_table(series, keys)
    value = F.try_divide(F.col("mean"), F.col("standard_deviation")) if score == "sharpe" else -F.col(score)
    mean = risks.groupBy("param").agg(F.avg(value).alias("score"))
    best = F.row_number().over(Window.orderBy(F.round("score", 12).desc(), "param")) == 1
    return mean.join(params, "param").select("param", "top_k", "power", "score", best.alias("best"))


def net_returns(gross: DataFrame, changes: DataFrame, cost_bps: float = 10.0) -> DataFrame:
    """Gross return minus the two-way turnover cost on change dates; ``changes`` is (date, asset, dw)."""
    cost = changes.groupBy("date").agg((F.sum(F.abs("dw")) * cost_bps / 10_000).alias("cost"))
    return gross.join(cost, "date", "left").select("date", (F.col("r") - F.coalesce("cost", F.lit(0.0))).alias("r"))
