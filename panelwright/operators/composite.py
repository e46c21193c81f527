"""Group scores and composite scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, functions as F

from panelwright.config import CompositeConfig
from panelwright.errors import ConfigurationError
from panelwright.functions.dist import attach_one
from panelwright.operators.factors import group_of
from panelwright.session import cut


def group_scores(scores: DataFrame, keys: Sequence[str] = (), x: str = "x") -> DataFrame:
    """Mean of the covered factors of each group; null where none is covered."""
    rows = scores.withColumn("grp", group_of(F.col("factor"))).where(F.col("grp").isNotNull())
    return rows.groupBy(*keys, "ticker", "grp").agg(F.avg(x).alias("score"))


def tier_weights(spark, config: CompositeConfig, given: dict[str, float] | None = None) -> DataFrame:
    """(grp, tier): at most one row per group, from the config or as given."""
    weights = given if given is not None else config.tiers()
    return spark.createDataFrame([(g, float(w)) for g, w in weights.items()], "grp string, tier double")


def weighted_composite(groups: DataFrame, weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """sum(w * score) / sum(w) over the groups present; a null score counts 0 and keeps its weight."""
    rows = groups.join(F.broadcast(weights), "grp")
    return rows.groupBy(*keys, "ticker").agg(
        F.coalesce(F.try_divide(F.sum(F.col("w") * F.coalesce("score", F.lit(0.0))), F.sum("w")), F.lit(0.0)).alias("composite")
    )


def equal_weight(groups: DataFrame, config: CompositeConfig | None = None, given: dict[str, float] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    tiers = tier_weights(groups.sparkSession, config or CompositeConfig(), given)
    return weighted_composite(groups, tiers.withColumnRenamed("tier", "w"), keys)


def _with_fallback(groups: DataFrame, strength: DataFrame, tiers: DataFrame) -> DataFrame:
    """(grp, w): strength * tier, or the tiers themselves when every product is 0."""
    present = groups.select("grp").distinct()
    raw = (
        tiers.join(present, "grp", "left_semi")
        .join(strength, "grp", "left")
        .withColumn("raw", F.coalesce("strength", F.lit(0.0)) * F.col("tier"))
    )
    total = raw.agg(F.sum("raw").alias("total"))
    return attach_one(raw, total).select("grp", F.when(F.col("total") == 0, F.col("tier")).otherwise(F.col("raw")).alias("w"))


def ic_weighted(groups: DataFrame, ic: DataFrame, config: CompositeConfig | None = None, given: dict[str, float] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Weights max(mean IC over the last rows, 0) * tier; ``ic`` has (date, grp, ic).

    Scores and ICs are read twice, so both are written once.
    """
    c = config or CompositeConfig()
    groups, ic = cut(groups), cut(ic)
    dates = ic.select("date").distinct().orderBy(F.col("date").desc()).limit(c.ic_lookback)
    strength = (
        ic.join(dates, "date", "left_semi").groupBy("grp").agg(F.greatest(F.avg("ic"), F.lit(0.0)).alias("strength"))
    )
    w = _with_fallback(groups, strength, tier_weights(groups.sparkSession, c, given))
    return weighted_composite(groups, w, keys)


def icir_weighted(groups: DataFrame, ic: DataFrame, config: CompositeConfig | None = None, given: dict[str, float] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Weights |ICIR| * tier; the scores are read twice, so they are written once."""
    c = config or CompositeConfig()
    groups = cut(groups)
    ratio = F.try_divide(F.avg("ic"), F.stddev_samp("ic"))
    strength = ic.groupBy("grp").agg(F.abs(F.coalesce(ratio, F.lit(0.0))).alias("strength"))
    w = _with_fallback(groups, strength, tier_weights(groups.sparkSession, c, given))
    return weighted_composite(groups, w, keys)


def _training(table: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    clean = table.where(" and ".join(f"`{n}` is not null" for n in [*names, target]))
    return VectorAssembler(inputCols=list(names), outputCol="_v").transform(clean).withColumn("_y", F.col(target))


def fit_ridge(table: DataFrame, names: Sequence[str], target: str = "fwd", alpha: float = 1.0):
    """Ridge with a free intercept and the penalty alpha * |w|^2 beside the squared error.

    The solver divides its penalty by the deviation of the label, so that is put back.
    """
    rows = _training(table, names, target)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("_y").alias("sd")).first()
    return LinearRegression(
        featuresCol="_v", labelCol="_y", predictionCol="_raw", regParam=alpha / size["n"] * (size["sd"] or 1.0),
        elasticNetParam=0.0, standardization=False, solver="normal",
    ).fit(rows)


def fit_trees(table: DataFrame, names: Sequence[str], target: str = "fwd", depth: int = 3, rounds: int = 50):
    """Boosted trees."""
    return GBTRegressor(
        featuresCol="_v", labelCol="_y", predictionCol="_raw", maxDepth=depth, maxIter=rounds, stepSize=0.1, seed=0
    ).fit(_training(table, names, target))


def predict_scores(model, table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Predictions with column means for nulls, scaled to mean 0 and deviation 1 (ddof 0);
    rows that had a null come out null."""
    filled = [f"_f_{n}" for n in names]
    means = Imputer(inputCols=list(names), outputCols=filled, strategy="mean").fit(table)
    rows = VectorAssembler(inputCols=filled, outputCol="_v").transform(means.transform(table))
    rows = model.transform(rows)
    stats = rows.agg(F.avg("_raw").alias("_m"), F.stddev_pop("_raw").alias("_s"))
    holes = F.lit(False)
    for n in names:
        holes = holes | F.col(n).isNull()
    scaled = (F.col("_raw") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return attach_one(rows, stats).select("ticker", F.when(~holes, scaled).alias("composite"))


def composite(
    scores: DataFrame,
    config: CompositeConfig | None = None,
    ic: DataFrame | None = None,
    training: DataFrame | None = None,
    given: dict[str, float] | None = None,
    x: str = "x",
) -> DataFrame:
    """One cross-section of (ticker, factor, x) to (ticker, composite) by the configured method.

    ``training`` is a wide table of factor columns and ``fwd``.
    """
    c = config or CompositeConfig()
    if c.method in ("ic_weighted", "icir_weighted"):
        if ic is None:
            raise ConfigurationError(f"{c.method} needs the IC history")
        fn = ic_weighted if c.method == "ic_weighted" else icir_weighted
        return fn(group_scores(scores, x=x), ic, c, given)
    if c.method in ("ridge", "trees"):
        if training is None:
            raise ConfigurationError(f"{c.method} needs training scores and returns")
        names = [n for n in training.columns if n not in ("ticker", "date", "fwd")]
        model = (
            fit_ridge(training, names, alpha=c.ridge_alpha)
            if c.method == "ridge"
            else fit_trees(training, names, depth=c.tree_depth, rounds=c.tree_rounds)
        )
        wide = scores.groupBy("ticker").pivot("factor", names).agg(F.first(x))
        return predict_scores(model, wide, names)
    if c.method != "equal_weight":
        raise ConfigurationError(f"unknown method {c.method!r}")
    return equal_weight(group_scores(scores, x=x), c, given)
