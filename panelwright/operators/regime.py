"""Macro regime classification and factor tilts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.config import GROUPS, REGIME_TILTS


def _spread_rule(spread: Column) -> Column:
    return (
        F.when(spread > 1.0, "expansion")
        .when(spread > 0, "slowdown")
        .when(spread > -0.5, "recovery")
        .when(spread.isNotNull(), "recession")
        .otherwise("expansion")
    )


def classify(macro: DataFrame) -> DataFrame:
    """Regime per (country, date), each using the rows known up to its date.

    Growth against its last value and its 4-row mean decides; rising unemployment
    with positive growth is a slowdown; with fewer than two growth values the last
    yield spread decides. Missing values are skipped by carrying the last ones.
    """
    w = Window.partitionBy("country").orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    def recent(name: str, n: int) -> Column:
        # The newest n non-null values, newest first; collect_list skips nulls.
        values = F.collect_list(name).over(upto) if name in macro.columns else F.array().cast("array<double>")
        return F.slice(F.reverse(values), 1, n)

    g, u, s = F.col("_g"), F.col("_u"), F.col("_s")
    now, prev = F.get(g, F.lit(0)), F.get(g, F.lit(1))
    trend = F.aggregate(g, F.lit(0.0), lambda a, b: a + b) / F.size(g)
    growth = (
        F.when((F.size(u) >= 2) & (F.get(u, F.lit(0)) > F.get(u, F.lit(1))) & (now > 0), "slowdown")
        .when((now > trend) & (now > prev), "expansion")
        .when(now > trend, "slowdown")
        .when(now <= prev, "recession")
        .otherwise("recovery")
    )
    rows = macro.select(
        "country", "date", recent("gdp_growth", 4).alias("_g"), recent("unemployment_rate", 2).alias("_u"), recent("yield_spread", 1).alias("_s")
    )
    return rows.select(
        "country", "date", F.when(F.size(g) >= 2, growth).otherwise(_spread_rule(F.get(s, F.lit(0)))).alias("regime")
    )


def tilt_table(spark) -> DataFrame:
    """(regime, grp, tilt) for every regime and group; 1 where nothing is listed."""
    rows = [(r, g, float(t.get(g, 1.0))) for r, t in REGIME_TILTS.items() for g in GROUPS]
    return spark.createDataFrame(rows, "regime string, grp string, tilt double")


def tilted_weights(regimes: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Group weights times tilt, rescaled to the original total; ``weights`` has (grp, w)."""
    rows = regimes.join(F.broadcast(tilt_table(regimes.sparkSession)), "regime").join(F.broadcast(weights), "grp")
    per = Window.partitionBy(*keys)
    total, tilted = F.sum("w").over(per), F.sum(F.col("w") * F.col("tilt")).over(per)
    scale = F.when((total > 0) & (tilted > 0), total / tilted).otherwise(1.0)
    return rows.select(*keys, "regime", "grp", (F.col("w") * F.col("tilt") * scale).alias("w"))


def lagged_macro(macro: DataFrame, as_of, lag_days: int = 63) -> DataFrame:
    """Rows published by ``as_of``; a country without any keeps all its rows."""
    known = F.col("date") <= F.date_sub(F.lit(as_of).cast("date"), lag_days)
    any_known = F.max(known).over(Window.partitionBy("country"))
    return macro.withColumn("_any", any_known).where(known | ~F.col("_any")).drop("_any")
