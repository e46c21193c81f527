"""Factors, standardization, scoring and selection against pandas re-computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panels import long
from panelwright.config import Band, CompositeConfig, FactorConfig, ScreenConfig, SelectionConfig, StandardizeConfig
from panelwright.errors import ConfigurationError
from panelwright.operators import composite, factors, regime, selection, standardize, universe


@pytest.fixture(scope="module")
def prices():
    rng = np.random.default_rng(31)
    dates = pd.bdate_range("2020-02-03", periods=300)
    market = rng.standard_t(5, (300, 1)) * 0.007
    moves = market * np.linspace(0.3, 1.5, 10) + rng.normal(0, 0.011, (300, 10))
    close = pd.DataFrame(np.linspace(12, 240, 10) * np.cumprod(1 + moves, axis=0), index=dates, columns=[f"T{i}" for i in range(10)])
    close.iloc[40:44, 2] = np.nan
    close.iloc[200, 5] = np.nan
    close.iloc[:20, 7] = np.nan
    volume = pd.DataFrame(np.round(rng.lognormal(11, 0.8, (300, 10))), index=dates, columns=close.columns)
    volume.iloc[::50, 1] = 0
    return close, volume


def panel(spark, close, volume):
    rows = long(close, "close").merge(long(volume, "volume"), on=["date", "ticker"])
    return spark.createDataFrame(rows, "date date, ticker string, close double, volume double")


def test_price_factors_follow_the_filled_panel(spark, prices):
    close, volume = prices
    got = factors.price_factors(panel(spark, close, volume)).toPandas().set_index("ticker").loc[close.columns]
    r = close.ffill().pct_change(fill_method=None).dropna().iloc[-252:]
    market = r.mean(axis=1)
    dollars = (close * volume).reindex(r.index).replace(0, np.nan)
    assert np.allclose(got["momentum_12_1"], close.iloc[-22] / close.iloc[-252] - 1)
    assert np.allclose(got["volatility"], -r.std() * np.sqrt(252))
    assert np.allclose(got["beta"], [-r[c].cov(market) / market.var() for c in r])
    assert np.allclose(got["amihud_illiquidity"], (r.abs() / dollars).mean())


def test_price_factors_on_sparse_panels(spark, prices):
    close, volume = prices
    got = factors.price_factors(panel(spark, close, volume), FactorConfig(complete_dates=False)).toPandas().set_index("ticker")
    r = close.ffill().pct_change(fill_method=None).where(close.notna()).iloc[-252:]
    assert np.allclose(got.loc[close.columns, "volatility"], -r.std() * np.sqrt(252))


def test_short_panel_has_no_momentum(spark, prices):
    close, volume = prices
    got = factors.momentum(panel(spark, close.iloc[:100], volume.iloc[:100])).toPandas()
    assert got["momentum_12_1"].isna().all()


def test_point_in_time_takes_last_value_per_column(spark):
    rows = [("A", "2023-03-31", 1.0, 10.0), ("A", "2023-06-30", 2.0, None), ("A", "2023-09-30", 3.0, 30.0), ("B", "2023-09-30", 9.0, 9.0)]
    df = spark.createDataFrame(rows, "ticker string, d string, x double, y double").selectExpr("ticker", "to_date(d) period_date", "x", "y")
    got = factors.point_in_time(df, "2023-09-01", 45).collect()
    assert [(r["ticker"], r["x"], r["y"]) for r in got] == [("A", 2.0, 10.0)]
    dates = spark.createDataFrame([("2023-05-10",), ("2023-09-01",), ("2023-12-31",)], "d string").selectExpr("to_date(d) as_of")
    many = {(str(r["as_of"]), r["ticker"]): (r["x"], r["y"]) for r in factors.point_in_time_dates(df, dates, 45).collect()}
    assert many == {("2023-09-01", "A"): (2.0, 10.0), ("2023-12-31", "A"): (3.0, 30.0), ("2023-12-31", "B"): (9.0, 9.0)}
    early = factors.point_in_time(df, "2023-01-01", 45)
    assert early.count() == 0


def test_fallback_picks_a_column_not_a_row(spark):
    df = spark.createDataFrame([("A", 10.0, None, 4.0), ("B", 0.0, 2.0, 4.0)], "ticker string, market_cap double, book_value double, total_equity double")
    got = {r["ticker"]: r["book_to_price"] for r in factors.fundamental_factors(df, ["book_to_price"]).collect()}
    assert got == {"A": None, "B": None}
    assert factors.fundamental_factors(df, ["roe"]).first()["roe"] is None


def test_z_score_of_flat_group_is_zero_for_all(spark):
    df = spark.createDataFrame([("a", "A", 2.0), ("a", "B", 2.0), ("a", "C", None), ("b", "A", 1.0)], "g string, ticker string, x double")
    assert {r["x"] for r in standardize.z_score(df, ["g"]).collect()} == {0.0}


def test_joint_score_equals_the_single_steps(spark):
    rng = np.random.default_rng(0)
    rows = [(f"f{i % 3}", f"T{i:03d}", None if i % 11 == 0 else float(rng.normal())) for i in range(300)]
    labels = [(f"T{i:03d}", None if i % 13 == 0 else f"s{i % 5}") for i in range(300)]
    df = spark.createDataFrame(rows, "factor string, ticker string, x double")
    lab = spark.createDataFrame(labels, "ticker string, sector string")
    joined = df.join(lab, "ticker")
    a = standardize.neutralize(standardize.z_score(joined, ["factor"]).select(*joined.columns), ["factor"], ["sector"])
    b = standardize.z_score_neutral(joined, ["factor"], ["sector"])
    x = a.toPandas().set_index(["factor", "ticker"])["x"].sort_index()
    y = b.toPandas().set_index(["factor", "ticker"])["x"].sort_index()
    assert np.allclose(x, y, equal_nan=True) and len(y) == 300


def test_winsorized_bounds_and_moments(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 3, 500)
    df = spark.createDataFrame([("f", f"T{i}", float(v)) for i, v in enumerate(x)], "factor string, ticker string, x double")
    got = standardize.standardize(df, ["factor"], StandardizeConfig(neutralize=False)).toPandas()["x"]
    assert got.mean() == pytest.approx(0, abs=1e-9) and got.std() == pytest.approx(1)
    clipped = standardize.winsorize(df, ["factor"]).toPandas()["x"]
    assert clipped.min() == pytest.approx(np.quantile(x, 0.01)) and clipped.max() == pytest.approx(np.quantile(x, 0.99))


def test_orthogonal_scores_are_uncorrelated(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 2))
    x = np.column_stack([base[:, 0], base[:, 0] * 0.9 + 0.1 * base[:, 1], base[:, 1]])
    df = spark.createDataFrame([(f"T{i}", *map(float, r)) for i, r in enumerate(x)] + [("N", None, 1.0, 1.0)], "ticker string, a double, b double, c double")
    got = standardize.orthogonalize(df, ["a", "b", "c"]).toPandas().set_index("ticker")
    assert list(got.columns) == ["PC1", "PC2"] and got.loc["N"].isna().all()
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(np.corrcoef(z.T))
    want = np.abs(z @ vectors[:, ::-1][:, :2])
    assert np.allclose(np.abs(got.drop("N").loc[[f"T{i}" for i in range(200)]]), want)
    assert abs(np.corrcoef(got.dropna().T)[0, 1]) < 1e-9


def test_ic_weights_fall_back_when_all_are_zero(spark):
    groups = spark.createDataFrame([("A", "value", 1.0), ("A", "liquidity", None), ("B", "value", 0.5), ("B", "liquidity", 2.0)], "ticker string, grp string, score double")
    bad = spark.createDataFrame([("2024-01-31", "value", -0.1), ("2024-01-31", "liquidity", -0.2)], "date string, grp string, ic double")
    plain = {r["ticker"]: r["composite"] for r in composite.equal_weight(groups).collect()}
    assert plain["A"] == pytest.approx(1 / 1.5) and plain["B"] == pytest.approx((0.5 + 0.5 * 2) / 1.5)
    assert {r["ticker"]: r["composite"] for r in composite.ic_weighted(groups, bad).collect()} == pytest.approx(plain)
    more = bad.unionByName(spark.createDataFrame([("2024-02-29", "value", 0.3), ("2024-02-29", "liquidity", -0.2)], bad.schema))
    got = {r["ticker"]: r["composite"] for r in composite.ic_weighted(groups, more).collect()}
    assert got == pytest.approx({"A": 1.0, "B": 0.5})
    with pytest.raises(ConfigurationError):
        composite.composite(groups, CompositeConfig(method="ic_weighted"))


def test_ridge_matches_closed_form_and_trees_rank(spark):
    rng = np.random.default_rng(42)
    names = ["book_to_price", "roe", "momentum_12_1", "volatility"]
    x = rng.normal(size=(100, 4))
    y = 0.3 * x[:, 0] + rng.normal(0, 0.05, 100)
    rows = [(f"T{i:03d}", *map(float, x[i]), float(y[i])) for i in range(100)]
    df = spark.createDataFrame(rows + [("N", None, 0.0, 0.0, 0.0, 1.0)], "ticker string, " + ", ".join(f"{n} double" for n in names) + ", fwd double")
    model = composite.fit_ridge(df, names, alpha=2.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(4), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-8)
    scored = composite.predict_scores(model, df, names).toPandas().set_index("ticker")["composite"]
    assert np.isnan(scored["N"])
    filled = np.vstack([x, [x[:, 0].mean(), 0, 0, 0]])
    raw = filled @ want
    assert np.allclose(scored.loc[[f"T{i:03d}" for i in range(100)]], ((raw - raw.mean()) / raw.std())[:100], atol=1e-6)
    trees = composite.predict_scores(composite.fit_trees(df, names, rounds=10), df, names).toPandas().set_index("ticker")["composite"]
    both = pd.DataFrame({"t": trees, "y": pd.Series(y, index=[f"T{i:03d}" for i in range(100)])}).dropna()
    assert both["t"].rank().corr(both["y"].rank()) > 0.9
    # the dispatcher, from long scores, gives the same
    table = df.unpivot("ticker", names, "factor", "x")
    for config, expected in ((CompositeConfig(method="ridge", ridge_alpha=2.0), scored), (CompositeConfig(method="trees", tree_rounds=10), trees)):
        got = composite.composite(table, config, training=df).toPandas().set_index("ticker")["composite"]
        assert np.allclose(got.loc[expected.index], expected, atol=1e-9, equal_nan=True)
        with pytest.raises(ConfigurationError):
            composite.composite(table, config)


def test_regime_ladder(spark):
    rows = [("X", i, g, u, s) for i, (g, u, s) in enumerate([(None, 5.0, 1.5), (1.0, 5.0, 0.5), (2.0, 4.0, 0.0), (1.9, 4.0, 0.0), (0.5, 3.0, 0.0), (0.8, 2.0, 0.0), (3.0, 9.0, 0.0)])]
    df = spark.createDataFrame(rows, "country string, date int, gdp_growth double, unemployment_rate double, yield_spread double")
    got = [r["regime"] for r in regime.classify(df).orderBy("date").collect()]
    assert got == ["expansion", "slowdown", "expansion", "slowdown", "recession", "recovery", "slowdown"]


def test_tilts_keep_the_total(spark):
    w = composite.tier_weights(spark, CompositeConfig()).withColumnRenamed("tier", "w")
    reg = spark.createDataFrame([("X", "recession"), ("Y", "recovery")], "country string, regime string")
    got = regime.tilted_weights(reg, w, ["country"]).groupBy("country").agg(F.sum("w").alias("t"))
    assert [r["t"] for r in got.collect()] == pytest.approx([6.5, 6.5])


@pytest.mark.parametrize("config", [SelectionConfig(target_count=8, buffer_fraction=0.5), SelectionConfig(method="quantile", target_quantile=0.8, exit_quantile=0.6)])
def test_selection_over_dates_equals_the_loop(spark, config):
    rng = np.random.default_rng(6)
    x = pd.DataFrame(np.cumsum(rng.normal(size=(15, 40)), axis=0), index=pd.bdate_range("2024-01-01", periods=15), columns=[f"T{i:02d}" for i in range(40)])
    x = x.mask(rng.random(x.shape) < 0.1)
    df = spark.createDataFrame(long(x, "score"), "date date, ticker string, score double")
    got = selection.over_dates(df, config).toPandas().groupby("date")["ticker"].agg(set)
    members = set()
    for date, row in x.iterrows():
        row = row.dropna()
        if config.method == "fixed_count":
            order = row.sort_values(ascending=False).index
            now = set(order[:8]) | (members & set(order[8:12]))
        else:
            now = {t for t, v in row.items() if v >= row.quantile(0.8) or (t in members and v >= row.quantile(0.6))}
        assert got[date.date()] == now
        members = now


def test_sector_balance_equals_the_loop(spark):
    rng = np.random.default_rng(12)
    names = [f"T{i:02d}" for i in range(60)]
    sector = {t: f"s{int(v)}" for t, v in zip(names, rng.integers(0, 5, 60))}
    score = dict(zip(names, rng.normal(size=60).tolist()))
    picked = sorted(names, key=lambda t: (sector[t] != "s1", -score[t]))[:20]
    out = set(picked)
    for s in set(sector.values()):
        share = sum(v == s for v in sector.values()) / 60
        low, high = max(0, round((share - 0.02) * 20)), round((share + 0.02) * 20)
        have = [t for t in picked if sector[t] == s]
        if len(have) < low:
            rest = sorted((t for t in names if sector[t] == s and t not in picked), key=lambda t: -score[t])
            out |= set(rest[: low - len(have)])
        elif len(have) > high:
            out -= set(sorted(have, key=lambda t: score[t])[: len(have) - high])
    df = spark.createDataFrame([(t, score[t]) for t in names], "ticker string, score double")
    lab = spark.createDataFrame(list(sector.items()), "ticker string, sector string")
    sel = spark.createDataFrame([(t,) for t in picked], "ticker string")
    assert {r["ticker"] for r in selection.sector_balance(sel, df, lab, 0.02).collect()} == out


def test_screens(spark):
    rng = np.random.default_rng(7)
    dates = pd.bdate_range("2023-01-02", periods=300)
    names = ["AAPL", "MSFT", "GOOG", "TINY", "NEW"]
    close = pd.DataFrame(rng.uniform(50, 200, (300, 5)), index=dates, columns=names)
    volume = pd.DataFrame(rng.integers(100_000, 5_000_000, (300, 5)).astype(float), index=dates, columns=names)
    close.loc[dates[:250], "NEW"] = np.nan
    volume.loc[dates[:250], "NEW"] = 0
    volume.loc[rng.random(300) < 0.2, "TINY"] = 0
    fund = spark.createDataFrame(list(zip(names, [2e9, 1.5e9, 3e9, 5e7, 5e8], [150.0, 300.0, 100.0, 0.5, 25.0])), "ticker string, market_cap double, current_price double")
    stm = [(t, p, i) for t in names[:3] for p, n in (("annual", 4), ("quarterly", 10)) for i in range(n)] + [("TINY", "annual", 0)]
    statements = spark.createDataFrame(stm, "ticker string, period_type string, k int")
    full = spark.createDataFrame(
        close.rename_axis(index="date", columns="ticker").stack().rename("close").reset_index().merge(
            volume.rename_axis(index="date", columns="ticker").stack().rename("volume").reset_index(), on=["date", "ticker"]
        ).assign(date=lambda f: f["date"].dt.date).dropna(), "date date, ticker string, close double, volume double")
    got = {r["ticker"] for r in universe.investable(fund, full, statements).collect()}
    assert got == {"AAPL", "MSFT", "GOOG"}
    freq = {r["ticker"]: r["frequency"] for r in universe.trading_frequency(full, 252).collect()}
    assert freq["NEW"] == pytest.approx(50 / 252) and freq["AAPL"] == 1.0
    members = spark.createDataFrame([("TINY",)], "ticker string")
    loose = universe.screen(fund, "market_cap", Band(1e8, 4e7), members)
    assert {r["ticker"] for r in loose.collect()} == set(names)
    assert {r["ticker"] for r in universe.screen(fund, "market_cap", Band(1e8, 4e7)).collect()} == set(names) - {"TINY"}
    assert ScreenConfig.small_cap().market_cap.entry == 50_000_000
    with pytest.raises(ConfigurationError):
        Band(1.0, 2.0)
