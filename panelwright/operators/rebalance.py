"""Drift, turnover, cost and the rebalancing decision, for many portfolios at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.config import CALENDAR_DAYS, DriftRule
from panelwright.errors import ConfigurationError

_KEYS = ["portfolio", "asset"]


def drifted(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """w * (1 + r) over the portfolio's sum; left unscaled when the sum is 0.

    ``returns`` is (asset, r) or (asset, date, r); with dates every date drifts from
    the given weights.
    """
    keys = ["portfolio", "date"] if "date" in returns.columns else ["portfolio"]
    rows = weights.join(returns, "asset").withColumn("g", F.col("w") * (1 + F.col("r")))
    total = rows.groupBy(*keys).agg(F.sum("g").alias("t"))
    return rows.join(total, keys).select(
        *keys, "asset", F.when(F.col("t") == 0, F.col("g")).otherwise(F.col("g") / F.col("t")).alias("w")
    )


def aligned(current: DataFrame, target: DataFrame) -> DataFrame:
    """(portfolio, asset, cw, tw) with 0 for names on one side only."""
    a = current.select(*_KEYS, F.col("w").alias("cw"))
    b = target.select(*_KEYS, F.col("w").alias("tw"))
    return a.join(b, _KEYS, "full").select(
        *_KEYS, F.coalesce("cw", F.lit(0.0)).alias("cw"), F.coalesce("tw", F.lit(0.0)).alias("tw")
    )


def _moved() -> Column:
    return F.abs(F.col("tw") - F.col("cw"))


def turnover(current: DataFrame, target: DataFrame) -> DataFrame:
    """Half the sum of absolute weight changes."""
    return aligned(current, target).groupBy("portfolio").agg((F.sum(_moved()) / 2).alias("turnover"))


def rebalancing_cost(current: DataFrame, target: DataFrame, rate: float | DataFrame) -> DataFrame:
    """sum(rate * |change|); ``rate`` is one number or (asset, rate)."""
    rows = aligned(current, target)
    if isinstance(rate, DataFrame):
        rows = rows.join(rate.select("asset", "rate"), "asset", "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    else:
        rows = rows.withColumn("rate", F.lit(float(rate)))
    return rows.groupBy("portfolio").agg(F.sum(F.col("rate") * _moved()).alias("cost"))


def drift(rule: DriftRule) -> Column:
    """Drift of one asset; relative drift is that from a positive target and never fires for others."""
    gap = F.abs(F.col("cw") - F.col("tw"))
    return F.when(F.col("tw") > 0, gap / F.col("tw")).otherwise(0.0) if rule.relative else gap


def threshold_rule(current: DataFrame, target: DataFrame, rule: DriftRule) -> DataFrame:
    """(portfolio, fires): any drift strictly above the threshold."""
    return aligned(current, target).groupBy("portfolio").agg(F.bool_or(drift(rule) > rule.threshold).alias("fires"))


def weekdays_between(start: Column, end: Column) -> Column:
    """Business days in [start, end): whole weeks and the rest, counted from a Monday."""
    def upto(d: Column) -> Column:
        days = F.datediff(d, F.lit("1900-01-01").cast("date"))
        return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(5))

    return (upto(end) - upto(start)).cast("long")


def calendar_rule(reviews: DataFrame, frequencies: Sequence[str] = tuple(CALENDAR_DAYS)) -> DataFrame:
    """(portfolio, frequency, elapsed, due): whether the frequency's business days have passed since the last review.

    ``reviews`` is (portfolio, last_review, today); a portfolio without a last review is due.
    """
    if unknown := set(frequencies) - set(CALENDAR_DAYS):
        raise ConfigurationError(f"unknown frequencies {sorted(unknown)}")
    periods = F.explode(F.create_map(*[F.lit(x) for f in frequencies for x in (f, CALENDAR_DAYS[f])])).alias("frequency", "_days")
    rows = reviews.select("portfolio", weekdays_between(F.col("last_review"), F.col("today")).alias("elapsed"), periods)
    return rows.select("portfolio", "frequency", "elapsed", F.coalesce(F.col("elapsed") >= F.col("_days"), F.lit(True)).alias("due"))


def hybrid_rule(current: DataFrame, target: DataFrame, reviews: DataFrame, rule: DriftRule) -> DataFrame:
    """(portfolio, elapsed, due, fires): the threshold counts only once the period has passed.

    ``reviews`` is (portfolio, last_review, today).
    """
    t = threshold_rule(current, target, rule)
    rows = reviews.join(t, "portfolio").withColumn("elapsed", weekdays_between(F.col("last_review"), F.col("today")))
    due = F.lit(True) if rule.period_days is None else F.col("elapsed") >= rule.period_days
    return rows.select("portfolio", "elapsed", due.alias("due"), (due & F.col("fires")).alias("fires"))


def decide(previous: DataFrame, new: DataFrame, rule: DriftRule, reviews: DataFrame | None = None) -> DataFrame:
    """(portfolio, turnover, rebalance): the previous weights are cut to the new assets and scaled to sum 1."""
    prev = new.select(*_KEYS).join(previous.select(*_KEYS, "w"), _KEYS, "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    total = prev.groupBy("portfolio").agg(F.sum("w").alias("t"))
    prev = prev.join(total, "portfolio").select(
        *_KEYS, F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(F.col("w")).alias("w")
    )
    moved = turnover(prev, new)
    if rule.period_days is None or reviews is None:
        fired = threshold_rule(prev, new, rule)
    else:
        fired = hybrid_rule(prev, new, reviews, rule).select("portfolio", "fires")
    return moved.join(fired, "portfolio").select("portfolio", "turnover", F.col("fires").alias("rebalance"))
