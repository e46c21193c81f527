"""End-to-end flows: prices to weights, selection to weights, named strategies.

Every stage hands on a lazy table; a stage that several later ones read is written
once to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from panelwright.config import CleaningConfig, CompositeConfig, DriftRule, FactorConfig, ScreenConfig, SelectionConfig, StandardizeConfig
from panelwright.errors import ConfigurationError
from panelwright.operators import composite, factors, folds, moments, portfolios, rebalance, regime, risk, selection, standardize, universe
from panelwright.operators.clean import fit_pre_selection
from panelwright.session import cut
from panelwright.sources.ingest import write_weights
from panelwright.sources.panel import simple_returns

WeightRule = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class RunConfig:
    cleaning: CleaningConfig = field(default_factory=CleaningConfig)
    train: int = 252
    test: int = 63
    purge: int = 0
    backtest: bool = True
    rule: DriftRule = field(default_factory=DriftRule)


def full_run(
    prices: DataFrame, sectors: DataFrame, weight_rule: WeightRule = portfolios.inverse_volatility,
    config: RunConfig | None = None, previous: DataFrame | None = None, reviews: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """weights, summary, backtest, backtest_summary and, with previous weights, decision.

    The pre-selection is fitted on each fold's training rows alone; the number of
    folds is bounded by the date count.
    """
    c = config or RunConfig()
    returns = cut(simple_returns(prices).where("idx > 1").select("date", "ticker", "r"))
    fitted = fit_pre_selection(returns, sectors, c.cleaning)
    clean = cut(fitted.transform(returns))
    weights = cut(weight_rule(clean).select("asset", "w"))
    tagged = weights.select(F.lit(1).cast("long").alias("portfolio"), "asset", "w")
    out = {"weights": weights, "summary": risk.summary(risk.portfolio_returns(clean, tagged))}
    if c.backtest:
        axis = cut(folds.walk_forward(returns, c.test, c.train, c.purge))
        parts = None
        for row in axis.select("fold").distinct().orderBy("fold").collect():
            mine = axis.where(F.col("fold") == row["fold"])
            part = _fold_returns(returns, mine, sectors, weight_rule, c).withColumn("fold", F.lit(row["fold"]))
            parts = part if parts is None else parts.unionByName(part)
        if parts is not None:
            out["backtest"] = cut(parts.select("fold", "date", "r"))
            out["backtest_summary"] = risk.summary(out["backtest"].withColumn("portfolio", F.lit(1).cast("long")))
    if previous is not None:
        out["decision"] = rebalance.decide(previous, tagged, c.rule, reviews)
    return out


def _fold_returns(returns: DataFrame, fold: DataFrame, sectors: DataFrame, weight_rule: WeightRule, c: RunConfig) -> DataFrame:
    train = returns.join(fold.where("role = 'train'").select("date"), "date", "left_semi")
    test = returns.join(fold.where("role = 'test'").select("date"), "date", "left_semi")
    fitted = fit_pre_selection(train, sectors, c.cleaning)
    weights = weight_rule(fitted.transform(train)).select(F.lit(1).cast("long").alias("portfolio"), "asset", "w")
    return risk.portfolio_returns(fitted.transform(test), weights).select("date", "r")


@dataclass(frozen=True)
class SelectionRunConfig:
    screens: ScreenConfig = field(default_factory=ScreenConfig)
    factors: FactorConfig = field(default_factory=FactorConfig)
    factor_names: tuple[str, ...] = ("book_to_price", "roe", "momentum_12_1", "volatility")
    standardize: StandardizeConfig = field(default_factory=StandardizeConfig)
    composite: CompositeConfig = field(default_factory=CompositeConfig)
    selection: SelectionConfig = field(default_factory=SelectionConfig)
    use_regime: bool = False
    country: str | None = None
    statement_date: str | None = None
    run: RunConfig = field(default_factory=RunConfig)


def select_universe(
    prices: DataFrame, fundamentals: DataFrame, sectors: DataFrame, config: SelectionRunConfig,
    statements: DataFrame | None = None, ratings: DataFrame | None = None, trades: DataFrame | None = None,
    macro: DataFrame | None = None, ic: DataFrame | None = None, members: DataFrame | None = None, as_of=None,
) -> DataFrame:
    """Screens, factors of the survivors, standardization, regime tilts, composite, selection: (ticker).

    With ``statement_date`` and ``as_of`` the fundamentals are a history, cut to what was public.
    """
    c = config
    if c.statement_date is not None and as_of is not None:
        fundamentals = cut(factors.point_in_time(fundamentals, as_of, c.factors.annual_lag_days, c.statement_date))
    kept = cut(universe.investable(fundamentals, prices, statements, c.screens, members))
    panel = prices.join(kept, "ticker", "left_semi")
    own = fundamentals.join(kept, "ticker", "left_semi")
    table = factors.factor_table(own, panel, ratings, trades, list(c.factor_names), c.factors)
    scores = standardize.standardize(cut(factors.factors_long(table)), ["factor"], c.standardize, sectors)
    given = None
    if c.use_regime and macro is not None:
        when = as_of if as_of is not None else prices.agg(F.max("date")).first()[0]
        known = regime.lagged_macro(macro, when, c.factors.macro_lag_days)
        if c.country is not None:
            known = known.where(F.col("country") == c.country)
        last = regime.classify(known).orderBy(F.col("date").desc(), "country").limit(1)
        tiers = composite.tier_weights(prices.sparkSession, c.composite).withColumnRenamed("tier", "w")
        rows = regime.tilted_weights(last, tiers, ["country", "date"]).collect()  # one row per factor group
        given = {r["grp"]: r["w"] for r in rows}
    score = composite.composite(scores, c.composite, ic, given=given).withColumnRenamed("composite", "score")
    return selection.select(cut(score), c.selection, members, sectors, kept)


def selection_run(prices: DataFrame, fundamentals: DataFrame, sectors: DataFrame, config: SelectionRunConfig | None = None, weight_rule: WeightRule = portfolios.inverse_volatility, **tables) -> dict[str, DataFrame]:
    """``select_universe`` followed by ``full_run`` on the chosen names; adds ``selected``."""
    c = config or SelectionRunConfig()
    panel = cut(prices)
    chosen = cut(select_universe(panel, cut(fundamentals), sectors, c, **tables))
    out = full_run(panel.join(chosen, "ticker", "left_semi"), sectors, weight_rule, c.run)
    return {"selected": chosen, **out}


# Named strategies

STRATEGIES = (
    "max-sharpe", "min-variance", "min-cvar", "max-utility", "risk-parity", "cvar-parity",
    "hrp", "herc", "max-diversification", "equal-weight", "inverse-vol",
)

_OBJECTIVES = {
    "max-sharpe": portfolios.Objective("max_ratio", "standard_deviation"),
    "min-variance": portfolios.Objective("min_risk", "variance"),
    "min-cvar": portfolios.Objective("min_risk", "cvar"),
    "max-utility": portfolios.Objective("max_utility", "variance"),
}


def cvar_gaps(returns: DataFrame, weights: DataFrame, beta: float = 0.95) -> DataFrame:
    """(portfolio, score): minus the squared distance of the CVaR shares from equal shares."""
    from pyspark.sql import Window

    series = risk.portfolio_returns(returns, weights)
    w = Window.partitionBy("portfolio")
    bad = series.withColumn("rn", F.row_number().over(w.orderBy("r", "date"))).withColumn("n", F.count(F.lit(1)).over(w))
    bad = bad.where(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.round((1 - beta) * F.col("n"), 9)))).select("portfolio", "date")
    parts = (
        returns.where(F.col("r").isNotNull()).join(bad, "date")
        .join(weights.select("portfolio", F.col("asset").alias("ticker"), "w"), ["portfolio", "ticker"])
        .groupBy("portfolio", "ticker").agg(F.sum(F.col("w") * F.col("r")).alias("c"))
    )
    total = parts.groupBy("portfolio").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("k"))
    gap = F.col("c") / F.col("t") - 1.0 / F.col("k")
    return parts.join(total, "portfolio").groupBy("portfolio").agg((-F.sum(gap * gap)).alias("score"))


def strategy_weights(name: str, returns: DataFrame, clusters: DataFrame, n_candidates: int = 1_000) -> DataFrame:
    """(asset, w) of a named strategy.

    Strategies that call for a convex solver pick the best of a seeded candidate table
    by the same objective; the two hierarchical ones weigh inside and across clusters.
    """
    if name not in STRATEGIES:
        raise ConfigurationError(f"unknown strategy {name!r}")
    if name == "equal-weight":
        return portfolios.equal_weight(returns)
    if name == "inverse-vol":
        return portfolios.inverse_volatility(returns)
    if name in ("hrp", "herc"):
        return portfolios.nested_weights(returns, clusters, 2.0 if name == "hrp" else 1.0)
    assets = returns.select(F.col("ticker").alias("asset")).distinct()
    w = cut(portfolios.candidates(assets, n_candidates))
    if name in _OBJECTIVES:
        scored = portfolios.score_candidates(returns, w, _OBJECTIVES[name])
    elif name == "cvar-parity":
        scored = cvar_gaps(returns, w)
    else:
        c = risk.risk_contributions(moments.covariance(returns), w)
        score = F.max("diversification_ratio") if name == "max-diversification" else -F.sum(F.col("gap") * F.col("gap"))
        scored = c.groupBy("portfolio").agg(score.alias("score"))
    return portfolios.best_candidate(scored, w).select("asset", "w")


def run_strategy(name: str, prices: DataFrame, sectors: DataFrame, clusters: DataFrame, config: RunConfig | None = None, path: str | None = None, as_of: str = "latest", n_candidates: int = 1_000) -> dict[str, DataFrame]:
    """The full run of a named strategy; with a path the weights are written sorted."""
    out = full_run(prices, sectors, lambda r: strategy_weights(name, r, clusters, n_candidates), config)
    if path is not None:
        write_weights(out["weights"].withColumn("as_of", F.lit(as_of)), path)
    return out
