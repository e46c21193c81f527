"""Flows: no look-ahead, previous weights, strategies, point-in-time fundamentals."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panels import long
from panelwright.config import Band, CleaningConfig, DriftRule, FactorConfig, ScreenConfig, SelectionConfig
from panelwright.errors import ConfigurationError
from panelwright.plans import flows


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(42)
    r = rng.normal(0.001, 0.02, (160, 10))
    dates = pd.bdate_range("2023-01-02", periods=160)
    close = pd.DataFrame(100 * np.cumprod(1 + r, axis=0), index=dates, columns=[f"T{i}" for i in range(10)])
    prices = spark.createDataFrame(long(close, "close").assign(volume=1e6), "date date, ticker string, close double, volume double").cache()
    sectors = spark.createDataFrame([(f"T{i}", f"s{i % 3}") for i in range(10)], "ticker string, sector string").cache()
    return close, prices, sectors


def test_full_run(spark, market):
    close, prices, sectors = market
    config = flows.RunConfig(cleaning=CleaningConfig(winsor_z=50, remove_z=60), train=80, test=30, rule=DriftRule(0.01))
    previous = spark.createDataFrame([(1, "T0", 1.0), (1, "GONE", 1.0)], "portfolio long, asset string, w double")
    out = flows.full_run(prices, sectors, config=config, previous=previous)
    w = out["weights"].toPandas().set_index("asset")["w"]
    r = close.pct_change(fill_method=None).iloc[1:]
    inv = 1 / r.std()
    assert np.allclose(w[close.columns], inv / inv.sum())
    back = out["backtest"].toPandas().sort_values("date")
    assert len(back) == 60 and set(back["fold"]) == {0, 1}
    train = 1 / r.iloc[30:110].std()
    assert np.allclose(back["r"].iloc[30:], r.iloc[110:140] @ (train / train.sum()))
    d = out["decision"].first()
    assert d["rebalance"] and d["turnover"] == pytest.approx(1 - w["T0"])


def test_unknown_strategy(market):
    _, prices, sectors = market
    with pytest.raises(ConfigurationError):
        flows.strategy_weights("best-of-all", prices, sectors)


def test_every_strategy_sums_to_one(spark, market):
    close, _, sectors = market
    r = spark.createDataFrame(long(close.pct_change(fill_method=None).iloc[1:], "r"), "date date, ticker string, r double").cache()
    clusters = sectors.withColumnRenamed("sector", "cluster")
    for name in ("max-sharpe", "risk-parity", "cvar-parity", "hrp", "max-diversification", "equal-weight"):
        w = flows.strategy_weights(name, r, clusters, 40).toPandas()
        assert len(w) == 10 and w["w"].sum() == pytest.approx(1) and (w["w"] > 0).all(), name


def test_selection_uses_only_public_statements(spark, market):
    _, prices, sectors = market
    rows = [(f"T{i}", "2022-12-31", 1e9, float(i)) for i in range(10)] + [(f"T{i}", "2023-06-30", 1e9, float(-i)) for i in range(10)]
    fund = spark.createDataFrame(rows, "ticker string, d string, market_cap double, book_value double").selectExpr("ticker", "to_date(d) period_date", "market_cap", "book_value")
    zero = Band(0.0, 0.0)
    config = flows.SelectionRunConfig(
        screens=ScreenConfig(market_cap=zero, addv_long=zero, addv_short=zero, frequency=zero, min_history=1, min_seasoning=1),
        factors=FactorConfig(), factor_names=("book_to_price",), selection=SelectionConfig(target_count=3), statement_date="period_date",
    )
    pick = lambda day: {r["ticker"] for r in flows.select_universe(prices, fund, sectors.withColumn("sector", F.lit("s")), config, as_of=day).collect()}
    assert pick("2023-07-15") == {"T7", "T8", "T9"}
    assert pick("2023-12-31") == {"T0", "T1", "T2"}
