"""Cross-sectional standardization of factor scores in long form (keys, ticker, x)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from panelwright.config import StandardizeConfig
from panelwright.errors import ConfigurationError, DataError
from panelwright.functions.columns import clip
from panelwright.functions.dist import by_calendar, group_quantiles, with_average_rank, with_group_stats
from panelwright.functions.stats import normal_quantile


def winsorize(df: DataFrame, keys: Sequence[str], x: str = "x", lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Clip at the group's quantiles (linear interpolation)."""
    cuts = group_quantiles(df, keys, x, {"_lo": lower, "_hi": upper})
    return df.join(by_calendar(cuts, keys), list(keys), "left").withColumn(x, clip(F.col(x), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def z_score(df: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """(x - mean) / sd with ddof 1; a zero or undefined deviation gives 0 to every row, nulls included."""
    rows = with_group_stats(df, keys, F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    flat = F.col("_s").isNull() | (F.col("_s") == 0)
    return rows.withColumn(x, F.when(flat, 0.0).otherwise((F.col(x) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def rank_normal(df: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """Normal quantile of (average rank - 0.5) / n; null stays null."""
    ranked = with_average_rank(df, keys, x, "_rk", "_nn")
    scored = ranked.withColumn(x, normal_quantile((F.col("_rk") - 0.5) / F.col("_nn"))).drop("_rk", "_nn")
    empty = df.where(F.col(x).isNull())
    return scored.select(*df.columns).unionByName(empty)


def neutralize(df: DataFrame, keys: Sequence[str], labels: Sequence[str], x: str = "x") -> DataFrame:
    """x minus the mean of its group; rows without a label become null."""
    rows = with_group_stats(df, [*keys, *labels], F.avg(x).alias("_g"))
    labelled = F.lit(True)
    for name in labels:
        labelled = labelled & F.col(name).isNotNull()
    return rows.withColumn(x, F.when(labelled, F.col(x) - F.col("_g"))).drop("_g").select(*df.columns)


def z_score_neutral(df: DataFrame, keys: Sequence[str], labels: Sequence[str], x: str = "x") -> DataFrame:
    """``z_score`` followed by ``neutralize`` from one aggregate.

    Counts, means and variances per (keys, labels) add up to the moments of the whole
    group, and the neutral score is (x - label mean) / sd of the group.
    """
    per = df.groupBy(*keys, *labels).agg(
        F.count(x).alias("_c"), F.avg(x).alias("_g"), F.var_pop(x).alias("_v")
    )
    whole = Window.partitionBy(*keys)
    n = F.sum("_c").over(whole)
    per = per.withColumn("_n", n).withColumn("_m", F.sum(F.col("_c") * F.col("_g")).over(whole) / F.nullif(n, F.lit(0)))
    spread = F.col("_c") * (F.col("_v") + (F.col("_g") - F.col("_m")) * (F.col("_g") - F.col("_m")))
    per = per.withColumn("_s", F.sqrt(F.try_divide(F.sum(spread).over(whole), F.col("_n") - 1)))
    flat = F.col("_s").isNull() | (F.col("_s") == 0)
    labelled = F.lit(True)
    for name in labels:
        labelled = labelled & F.col(name).isNotNull()
    # Label columns may be null, so they are compared null-safe under other names.
    stats = per.select(*keys, *[F.col(c).alias(f"_k_{c}") for c in labels], "_g", "_s")
    stats = stats.withColumnsRenamed({c: f"_k_{c}" for c in keys})
    on = F.lit(True)
    for name in [*keys, *labels]:
        on = on & F.col(name).eqNullSafe(F.col(f"_k_{name}"))
    return (
        df.join(stats, on, "left")
        .select(*df.columns, "_g", "_s")
        .withColumn(x, F.when(labelled, F.when(flat, 0.0).otherwise((F.col(x) - F.col("_g")) / F.col("_s"))))
        .drop("_g", "_s")
    )


def standardize(
    df: DataFrame, keys: Sequence[str], config: StandardizeConfig | None = None,
    labels: DataFrame | None = None, x: str = "x",
) -> DataFrame:
    """Winsorize, score, neutralize and optionally score again; ``labels`` has ticker, sector[, country]."""
    c = config or StandardizeConfig()
    rows = winsorize(df, keys, x, c.lower, c.upper)
    neutral = c.neutralize and labels is not None
    if c.method == "rank_normal":
        rows = rank_normal(rows, keys, x)
    elif not neutral:
        rows = z_score(rows, keys, x)
    if neutral:
        names = ["sector", "country"] if c.by_country else ["sector"]
        rows = rows.join(labels.select("ticker", *names), "ticker", "left")
        rows = neutralize(rows, keys, names, x) if c.method == "rank_normal" else z_score_neutral(rows, keys, names, x)
        if c.restandardize:
            rows = z_score(rows, keys, x)
    return rows.select(*df.columns)


def with_coverage(scores: DataFrame, x: str = "x") -> DataFrame:
    return scores.withColumn("covered", F.col(x).isNotNull())


def standardized_rows(table: DataFrame, names: Sequence[str]):
    """Complete rows as a vector of columns scaled to mean 0 and deviation 1 (ddof 0); returns (rows, n)."""
    if len(names) < 2:
        raise ConfigurationError("need at least 2 factors")
    clean = table.where(" and ".join(f"`{n}` is not null" for n in names))
    stats = clean.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(n).alias(f"m_{n}") for n in names],
        *[F.stddev_pop(n).alias(f"s_{n}") for n in names],
    ).first()
    if stats["n"] < 2:
        raise DataError("need at least 2 complete rows")
    scaled = [
        ((F.col(n) - stats[f"m_{n}"]) / (stats[f"s_{n}"] if stats[f"s_{n}"] else 1.0)).alias(n) for n in names
    ]
    rows = clean.select(*[c for c in table.columns if c not in names], *scaled)
    return VectorAssembler(inputCols=list(names), outputCol="_v").transform(rows), stats["n"]


def fit_components(rows: DataFrame, k: int):
    """(loadings as k lists, explained variance ratios); each sign makes the largest loading positive."""
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows)
    pc = model.pc.toArray()
    loadings = []
    for i in range(k):
        col = pc[:, i]
        big = max(range(len(col)), key=lambda j: round(abs(col[j]), 9))
        loadings.append([float(v) * (1.0 if col[big] >= 0 else -1.0) for v in col])
    return loadings, [float(v) for v in model.explainedVariance.toArray()]


def components_for(ratios: Sequence[float], share: float) -> int:
    """Fewest components whose cumulated share reaches ``share``."""
    total = 0.0
    for i, v in enumerate(ratios, 1):
        total += v
        if total >= share:
            return i
    return len(ratios)


def orthogonalize(table: DataFrame, names: Sequence[str], min_share: float = 0.95, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Scores on the leading principal components; incomplete rows get nulls."""
    rows, _ = standardized_rows(table, names)
    loadings, ratios = fit_components(rows, len(names))
    n = components_for(ratios, min_share)
    scores = [
        sum((F.col(f) * loadings[i][j] for j, f in enumerate(names)), F.lit(0.0)).alias(f"PC{i + 1}") for i in range(n)
    ]
    return table.select(*keys).join(rows.select(*keys, *scores), list(keys), "left")
