"""Expected returns, alpha after cost, view baskets and exposure bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelwright.errors import ConfigurationError
from panelwright.functions.dist import attach_one, group_quantiles


def _map(values: dict[str, float]):
    return F.create_map(*[F.lit(v) for kv in values.items() for v in (kv[0], float(kv[1]))])


def expected_returns(groups: DataFrame, betas: DataFrame, premia: dict[str, float], risk_free: float = 0.0) -> DataFrame:
    """rf + market premium * beta (missing beta 1) + sum of group premium * score (null 0)."""
    others = {g: v for g, v in premia.items() if g != "market"}
    per_group = F.coalesce(F.element_at(_map(others), F.col("grp")), F.lit(0.0)) if others else F.lit(0.0)
    tilt = groups.groupBy("ticker").agg(F.sum(per_group * F.coalesce("score", F.lit(0.0))).alias("tilt"))
    return tilt.join(betas.select("ticker", "beta"), "ticker", "left").select(
        "ticker",
        (F.lit(float(risk_free)) + float(premia.get("market", 0.0)) * F.coalesce("beta", F.lit(1.0)) + F.col("tilt")).alias("expected"),
    )


def gross_alpha(rows: DataFrame, cost_bps: float = 10.0) -> DataFrame:
    """Adds net alpha plus turnover cost."""
    return rows.withColumn("gross_alpha", F.col("net_alpha") + F.col("avg_turnover") * cost_bps / 10_000)


def turnover_series(weights: DataFrame) -> DataFrame:
    """(as_of, turnover): half the absolute weight change against the review before.

    A name missing on a review has weight 0 there; the change of a name that leaves
    is found by looking one review ahead, so no grid is built.
    """
    dates = weights.select("as_of").distinct().select("as_of", F.row_number().over(Window.orderBy("as_of")).alias("k"))
    total = dates.agg(F.max("k").alias("n"))
    w = Window.partitionBy("asset").orderBy("k")
    rows = attach_one(weights.join(dates, "as_of"), total)
    rows = rows.withColumn("_pk", F.lag("k").over(w)).withColumn("_pw", F.lag("w").over(w)).withColumn("_nk", F.lead("k").over(w))
    before = F.when(F.col("_pk") == F.col("k") - 1, F.col("_pw")).otherwise(0.0)
    leaves = (F.coalesce("_nk", F.col("n") + 1) != F.col("k") + 1) & (F.col("k") < F.col("n"))
    moves = F.filter(
        F.array(
            F.struct(F.col("k").alias("k"), F.abs(F.col("w") - before).alias("d")),
            F.when(leaves, F.struct((F.col("k") + 1).alias("k"), F.abs("w").alias("d"))),
        ),
        lambda x: x.isNotNull(),
    )
    per = rows.select(F.explode(moves).alias("m")).groupBy(F.col("m.k").alias("k")).agg((F.sum("m.d") / 2).alias("turnover"))
    return dates.where("k > 1").join(per, "k", "left").select("as_of", F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def net_alpha(ic: DataFrame, weights: DataFrame, cost_bps: float = 10.0, periods: int = 252) -> DataFrame:
    """One row: gross alpha from the mean IC, mean turnover, cost, net alpha and net ICIR."""
    root = float(periods) ** 0.5
    s = ic.agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("m"), F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("sd"))
    t = turnover_series(weights).agg(F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("avg_turnover"))
    rows = attach_one(s, t).select(
        (F.col("m") * root).alias("gross_alpha"), "avg_turnover",
        (F.col("avg_turnover") * cost_bps / 10_000).alias("total_cost"), (F.col("sd") * root).alias("vol"),
    )
    net = F.col("gross_alpha") - F.col("total_cost")
    return rows.select(
        "gross_alpha", "avg_turnover", "total_cost", net.alias("net_alpha"),
        F.when(F.col("vol") > 1e-12, net / F.col("vol")).otherwise(0.0).alias("net_icir"),
    )


def factor_premia(returns: DataFrame, periods: int = 252) -> DataFrame:
    """Mean factor return per year."""
    return returns.groupBy("factor").agg((F.avg("factor_return") * periods).alias("premium"))


def view_baskets(scores: DataFrame, premia: DataFrame, selected: DataFrame, x: str = "x") -> DataFrame:
    """(factor, ticker, leg, confidence): names at or beyond the quartiles, one row per name.

    Kept as rows, not as lists, so a basket may be as large as the universe.
    """
    rows = scores.where(F.col(x).isNotNull()).join(selected.select("ticker"), "ticker", "left_semi")
    cuts = group_quantiles(rows, ["factor"], x, {"_q25": 0.25, "_q75": 0.75}, n_out="_n").where("_n >= 4")
    legs = F.array_compact(
        F.array(F.when(F.col(x) >= F.col("_q75"), "top"), F.when(F.col(x) <= F.col("_q25"), "bottom"))
    )
    return (
        rows.join(cuts, "factor").join(premia.select("factor", "premium"), "factor")
        .select("factor", "ticker", F.explode(legs).alias("leg"), F.abs("premium").alias("confidence"))
    )


def exposure_rows(scores: DataFrame, bounds: dict[str, tuple[float, float]], x: str = "x") -> DataFrame:
    """(factor, row, ticker, a, b): a'w <= b for the lower (-z, -lb) and the upper (z, ub) side."""
    lo, hi = _bounds(bounds)
    f = F.col("factor")
    sides = F.array(
        F.struct(F.lit("lower").alias("row"), (-F.col(x)).alias("a"), (-F.element_at(lo, f)).alias("b")),
        F.struct(F.lit("upper").alias("row"), F.col(x).alias("a"), F.element_at(hi, f).alias("b")),
    )
    return scores.select("factor", "ticker", F.explode(sides).alias("s")).select("factor", "s.row", "ticker", "s.a", "s.b")


def _bounds(bounds: dict[str, tuple[float, float]]):
    for name, (lb, ub) in bounds.items():
        if lb > ub:
            raise ConfigurationError(f"lower bound above upper bound for {name!r}")
    return _map({f: b[0] for f, b in bounds.items()}), _map({f: b[1] for f, b in bounds.items()})


def exposure_check(scores: DataFrame, bounds: dict[str, tuple[float, float]], weights: DataFrame | None = None, x: str = "x") -> DataFrame:
    """Exposure per factor (and portfolio) and whether it lies inside its bounds;
    without weights the equal-weight portfolio of all scored names."""
    lo, hi = _bounds(bounds)
    f = F.col("factor")
    if weights is None:
        rows = scores.groupBy("factor").agg(F.avg(x).alias("exposure"))
    else:
        rows = scores.join(weights.select("portfolio", F.col("asset").alias("ticker"), "w"), "ticker").groupBy("portfolio", "factor").agg(
            F.sum(F.col("w") * F.col(x)).alias("exposure")
        )
    return rows.withColumn(
        "feasible", (F.col("exposure") >= F.element_at(lo, f)) & (F.col("exposure") <= F.element_at(hi, f))
    )
