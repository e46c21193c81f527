"""Stock selection from composite scores (keys, ticker, score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelwright.config import SelectionConfig
from panelwright.functions.dist import attach_one, by_calendar, group_quantiles, top_k, with_row_number
from panelwright.operators.universe import flag_members
from panelwright.session import cut
from panelwright.sources.panel import with_axis


def _buffer(count: int, fraction: float) -> int:
    return max(1, int(count * fraction))


def fixed_count(scores: DataFrame, count: int, buffer_fraction: float = 0.1, members: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Top names plus current members in the buffer ranks; ties by ticker."""
    limit = count + (_buffer(count, buffer_fraction) if members is not None else 0)
    ranked = top_k(scores.where(F.col("score").isNotNull()), keys, [F.col("score").desc(), F.col("ticker")], limit)
    rows = flag_members(ranked, members)
    return rows.where((F.col("rnk") <= count) | F.col("member")).select(*keys, "ticker", "score")


def quantile(scores: DataFrame, entry: float = 0.8, exit: float | None = None, members: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """At or above the entry quantile, or a member at or above the exit quantile."""
    cuts = group_quantiles(scores, keys, "score", {"_in": entry, "_out": entry if exit is None else exit})
    rows = scores.join(cuts, list(keys)) if keys else attach_one(scores, cuts)
    rows = flag_members(rows, members)
    s = F.col("score")
    return rows.where((s >= F.col("_in")) | (F.col("member") & (s >= F.col("_out")))).select(*keys, "ticker", "score")


def over_dates(scores: DataFrame, config: SelectionConfig) -> DataFrame:
    """(date, ticker) selections for all dates, the members of a date being its
    predecessor's selection.

    Whether a score enters, leaves or sits in between does not depend on the members,
    so membership is the last entering or leaving mark of the ticker: one window, no
    loop over dates. A date without a score ends the membership.
    """
    rows = scores.where(F.col("score").isNotNull())
    s = F.col("score")
    if config.method == "fixed_count":
        near = config.target_count + _buffer(config.target_count, config.buffer_fraction)
        ranked = with_row_number(rows.withColumn("_neg", -s), ["date"], "_neg", "ticker", "_rn", "_n")
        mark = F.when(F.col("_rn") <= config.target_count, 1).when(F.col("_rn") > near, 0)
    else:
        exit_q = config.target_quantile if config.exit_quantile is None else config.exit_quantile
        cuts = group_quantiles(rows, ["date"], "score", {"_in": config.target_quantile, "_out": exit_q})
        ranked = rows.join(by_calendar(cuts, ["date"]), "date")
        mark = F.when(s >= F.col("_in"), 1).when(s < F.col("_out"), 0)
    w = Window.partitionBy("ticker").orderBy("idx")
    gap = F.coalesce(F.col("idx") - F.lag("idx").over(w) != 1, F.lit(True))
    marked = with_axis(ranked.withColumn("_mark", mark)).withColumn("_mark", F.coalesce("_mark", F.when(gap, 0)))
    inside = F.last("_mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_in_now", inside).where(F.col("_in_now") == 1).select("date", "ticker", "score")


def sector_balance(selected: DataFrame, scores: DataFrame, sectors: DataFrame, tolerance: float = 0.05, parent: DataFrame | None = None) -> DataFrame:
    """Keep every sector's count within its parent share +- tolerance of the selection size.

    The best names not selected fill a short sector, the worst selected leave a long one.
    """
    universe = sectors if parent is None else sectors.join(parent.select("ticker"), "ticker", "left_semi")
    named = universe.where(F.col("sector").isNotNull())
    shares = named.groupBy("sector").agg(F.count(F.lit(1)).alias("_c"))
    shares = attach_one(shares, shares.agg(F.sum("_c").alias("_all"))).select("sector", (F.col("_c") / F.col("_all")).alias("share"))
    picked = selected.select("ticker").distinct().withColumn("_sel", F.lit(True))
    rows = cut(
        sectors.join(picked, "ticker", "full").join(scores.select("ticker", "score"), "ticker", "left")
        .select("ticker", "sector", F.coalesce("_sel", F.lit(False)).alias("_sel"), F.when(F.col("_sel"), F.col("score")).otherwise(-F.col("score")).alias("_order"))
    )
    size = rows.where("_sel").agg(F.count_distinct("ticker").alias("_size"))
    have = rows.where("_sel").groupBy("sector").agg(F.count(F.lit(1)).alias("_have"))
    bounds = attach_one(shares.join(have, "sector", "left"), size).select(
        "sector",
        F.coalesce("_have", F.lit(0)).alias("_have"),
        F.greatest(F.lit(0.0), F.bround((F.col("share") - tolerance) * F.col("_size"), 0)).cast("long").alias("_min"),
        F.bround((F.col("share") + tolerance) * F.col("_size"), 0).cast("long").alias("_max"),
    )
    # the best of the others and the worst of the selected come first
    moved = with_row_number(rows, ["sector", "_sel"], "_order", "ticker", "_rn", "_n").join(bounds, "sector").where(
        F.col("_rn") <= F.when(F.col("_sel"), F.col("_have") - F.col("_max")).otherwise(F.col("_min") - F.col("_have")))
    kept = rows.where("_sel").select("ticker").distinct().join(moved.where("_sel").select("ticker"), "ticker", "left_anti")
    return kept.unionByName(moved.where("NOT _sel").select("ticker"))


def turnover(current: DataFrame, new: DataFrame, universe: DataFrame) -> DataFrame:
    """Size of the symmetric difference over the size of the universe; one row."""
    a = current.select("ticker").distinct().withColumn("_a", F.lit(1))
    b = new.select("ticker").distinct().withColumn("_b", F.lit(1))
    moved = a.join(b, "ticker", "full").agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("_moved"))
    size = universe.select("ticker").distinct().agg(F.count(F.lit(1)).alias("_size"))
    return attach_one(moved, size).select(F.coalesce(F.try_divide(F.col("_moved"), F.col("_size")), F.lit(0.0)).alias("turnover"))


def select(
    scores: DataFrame, config: SelectionConfig | None = None, members: DataFrame | None = None,
    sectors: DataFrame | None = None, parent: DataFrame | None = None,
) -> DataFrame:
    """One cross-section: pick by count or quantile, then balance sectors if asked."""
    c = config or SelectionConfig()
    if c.method == "fixed_count":
        picked = fixed_count(scores, c.target_count, c.buffer_fraction, members)
    else:
        picked = quantile(scores, c.target_quantile, c.exit_quantile, members)
    if c.sector_balance and sectors is not None:
        universe = parent if parent is not None else scores
        return sector_balance(picked, scores, sectors, c.sector_tolerance, universe)
    return picked.select("ticker")
