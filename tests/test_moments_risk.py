"""Moments, risk, candidate portfolios, rebalancing and views against numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from panels import long
from panelwright.config import DriftRule
from panelwright.errors import ConfigurationError, DataError
from panelwright.operators import backtest, folds, moments, portfolios, rebalance, risk, spectral, views


def matrix(df, value="cov"):
    return df.toPandas().pivot(index="asset_i", columns="asset_j", values=value)


def vector(df, value="mu"):
    return df.toPandas().set_index("asset")[value].sort_index()


@pytest.fixture(scope="module")
def factor_returns(spark):
    """Ten assets on two factors, 250 dates."""
    rng = np.random.default_rng(7)
    f = rng.normal(0.001, 0.02, (250, 2))
    load = rng.uniform(-1, 2, (2, 10))
    x = f @ load + rng.normal(0, 0.01, (250, 10))
    dates = pd.bdate_range("2022-01-03", periods=250)
    wide = pd.DataFrame(x, index=dates, columns=[f"A{i}" for i in range(10)])
    df = spark.createDataFrame(long(wide), "date date, ticker string, r double").cache()
    return wide, pd.DataFrame(f, index=dates, columns=["f1", "f2"]), df


def shrink(x, method):
    mu, cov, (t, n) = x.mean(0), np.cov(x.T), x.shape
    grand = np.full(n, mu.mean())
    inv = np.linalg.inv(cov)
    if method == "james_stein":
        ev = np.linalg.eigvalsh(cov)
        beta = (ev.sum() - 2 * ev.max()) / ((mu - grand) ** 2).sum() / t
        return (1 - beta) * mu + beta * grand
    if method == "bayes_stein":
        beta = (n + 2) / ((n + 2) + t * (mu - grand) @ inv @ (mu - grand))
        return (1 - beta) * mu + beta * grand
    u, v, w = mu @ inv @ mu, grand @ inv @ grand, mu @ inv @ grand
    alpha = ((u - n / (t - n)) * v - w**2) / (u * v - w**2)
    return alpha * mu + (1 - alpha) * w / v * grand


@pytest.mark.parametrize("method", ["james_stein", "bayes_stein", "bodnar_okhrin"])
def test_shrunk_means(factor_returns, method):
    wide, _, df = factor_returns
    assert np.allclose(vector(moments.shrunk_mean(df, method)), shrink(wide.to_numpy(), method), rtol=1e-7)


def spread_panel(spark, t, n, seed, top=()):
    """Returns with given strong components and noise; more dates than a block of vectors holds."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.01, (t, n)) + sum((np.outer(rng.normal(0, s, t), rng.normal(0, 1, n)) for s in top), np.zeros((t, n)))
    wide = pd.DataFrame(x, index=pd.bdate_range("2020-01-01", periods=t), columns=[f"B{i:03d}" for i in range(n)])
    return wide, spark.createDataFrame(long(wide), "date date, ticker string, r double")


@pytest.mark.parametrize("t, n", [(150, 90), (80, 200)])
def test_leading_eigenpairs_of_the_panel(spark, t, n):
    wide, df = spread_panel(spark, t, n, 3, (0.02, 0.01, 0.005))
    values, vectors = np.linalg.eigh(np.cov(wide.T))
    gram = spectral.PanelGram(df.unionByName(spark.createDataFrame([(pd.Timestamp("2030-01-01").date(), "B001", 0.5)], df.schema)))  # an incomplete date
    assert (gram.t, gram.n) == (t, n) and gram.trace == pytest.approx(values.sum())
    found = spectral.Spectrum(gram, 3, block=8)
    assert np.allclose(found.values, values[:-4:-1], rtol=1e-9)
    got = found.asset_vectors().toPandas().pivot(index="ticker", columns="k", values="value").to_numpy()
    assert np.allclose(np.abs(got.T @ vectors[:, :-4:-1]), np.eye(3), atol=1e-7)
    edge = float(np.sqrt(values[-3] * values[-4]))
    assert np.allclose(spectral.Spectrum(gram, above=edge, block=8).values, values[:-4:-1], rtol=1e-9)
    assert len(spectral.Spectrum(gram, above=values[-1] * 2, block=8).values) == 0
    with pytest.raises(DataError, match="not found"):
        spectral.Spectrum(gram, 60, block=4, max_passes=2)


def test_systems_over_the_panel(spark):
    wide, df = spread_panel(spark, 150, 60, 4, (0.01,))
    inv, mu, one = np.linalg.inv(np.cov(wide.T)), wide.mean().to_numpy(), np.ones(60)
    got = spectral.inverse_products(spectral.PanelGram(df))
    assert spectral.inverse_products(spectral.PanelGram(df), block=4) == pytest.approx(got, rel=1e-8)
    assert got == pytest.approx({"mm": mu @ inv @ mu, "m1": mu @ inv @ one, "one": one @ inv @ one}, rel=1e-8)
    with pytest.raises(DataError, match="passes"):
        spectral.inverse_products(spectral.PanelGram(df), block=4, max_passes=3)
    with pytest.raises(DataError):
        spectral.inverse_products(spectral.PanelGram(spread_panel(spark, 30, 60, 4)[1]), max_passes=200)
    with pytest.raises(DataError, match="complete"):
        spectral.PanelGram(df.where("date = '2020-01-01'"))


def test_denoised_and_detoned(factor_returns):
    wide, _, df = factor_returns
    cov = np.cov(wide.T)
    values, vectors = np.linalg.eigh(cov)
    edge = values.mean() * (1 + math.sqrt(10 / 250)) ** 2
    noise = values[values <= edge].mean()
    want = vectors @ np.diag(np.where(values > edge, values, noise)) @ vectors.T
    got = matrix(moments.denoised(df))
    assert np.allclose(got, want, atol=1e-10) and np.trace(got) == pytest.approx(np.trace(cov))
    detoned = matrix(moments.detoned(df))
    assert np.allclose(detoned, cov - values[-1] * np.outer(vectors[:, -1], vectors[:, -1]), atol=1e-10)


def test_every_covariance_is_positive_semidefinite(factor_returns):
    _, _, df = factor_returns
    for name in ("empirical", "ledoit_wolf", "constant_correlation", "oas", "shrunk", "ew", "denoised"):
        _, cov = moments.prior(df, "empirical", name)
        m = matrix(cov)
        assert np.allclose(m, m.T) and np.linalg.eigvalsh(m)[0] > -1e-12, name


def test_factor_model(spark, factor_returns):
    wide, f, df = factor_returns
    factors = spark.createDataFrame([(d.date(), float(a), float(b)) for d, (a, b) in zip(f.index, f.to_numpy())], "date date, f1 double, f2 double")
    mu, cov = moments.factor_model(df, factors, ["f1", "f2"])
    z = np.column_stack([np.ones(250), f])
    beta, rss, _, _ = np.linalg.lstsq(z, wide, rcond=None)
    want = beta[1:].T @ np.cov(f.T) @ beta[1:] + np.diag(rss / 247)
    assert np.allclose(matrix(cov), want, atol=1e-12)
    assert np.allclose(vector(mu), wide.mean(), atol=1e-12)


def test_horizon_checks(factor_returns):
    _, _, df = factor_returns
    mu, cov = moments.mean(df), moments.covariance(df)
    with pytest.raises(DataError):
        moments.to_horizon(mu, cov, 0)
    with pytest.raises(ConfigurationError):
        moments.to_horizon(mu, cov, 5, "cubic")
    with pytest.raises(ConfigurationError):
        moments.prior(df, "empirical", "no such")


def test_regime_filter_sums_to_one_and_ignores_the_future(spark, factor_returns):
    wide, _, df = factor_returns
    params = df.groupBy("ticker").agg(F.array(F.lit(0.01), F.lit(-0.01)).alias("means"), F.array(F.lit(0.01), F.lit(0.03)).alias("sds"))
    run = lambda d: moments.regime_filter(d, [0.5, 0.5], [[0.95, 0.05], [0.1, 0.9]], params).toPandas().pivot(index=["ticker", "date"], columns="state", values="p")
    full = run(df)
    assert np.allclose(full.sum(axis=1), 1)
    cut = wide.index[100].date()
    early = run(df.where(F.col("date") <= F.lit(cut)))
    assert np.allclose(early, full.loc[early.index])


def regimes_in_turn(spark, means, sds, t, seed):
    """Each regime holds for twenty dates, so that all last equally long."""
    rng = np.random.default_rng(seed)
    turn = [(i // 20) % len(means) for i in range(t)]
    rows = [(day.date(), "A", float(rng.normal(means[s], sds[s]))) for day, s in zip(pd.bdate_range("2000-01-03", periods=t), turn)]
    return spark.createDataFrame(rows, "date date, ticker string, r double")


def plain_loglik(r, start, transition, means, sds):
    p, total = np.array(start), 0.0
    for x in r:
        u = p * np.exp(-0.5 * ((x - means) / sds) ** 2) / (sds * np.sqrt(2 * np.pi))
        total += np.log(u.sum())
        p = u / u.sum() @ transition
    return total


@pytest.mark.parametrize("means, sds, want", [((-0.03, 0.03), (0.004, 0.004), 2), ((-0.05, 0.0, 0.05), (0.004, 0.004, 0.004), 3)])
def test_likelihoods_pick_the_number_of_regimes(spark, means, sds, want):
    df = regimes_in_turn(spark, means, sds, 600, 5)
    df = df.unionByName(df.orderBy("date").limit(360).select("date", F.lit("B").alias("ticker"), "r")).unionByName(
        spark.createDataFrame([(pd.Timestamp("1999-01-01").date(), "B", None), (pd.Timestamp("1999-01-01").date(), "flat", 0.0)], df.schema))
    models = moments.bucket_regimes(df)
    fits = moments.forward_loglik(df, models)
    given = {(m.ticker, m.n_states): m for m in models.collect()}
    assert set(given) == {(t, k) for t in "AB" for k in (2, 3, 4)}
    for row in fits.collect():
        m = given[row.ticker, row.n_states]
        r = df.where(f"ticker = '{row.ticker}' AND r IS NOT NULL").orderBy("date").toPandas()["r"].to_numpy()
        assert row.n_dates == len(r) and np.allclose(np.sum(m.transition, axis=1), 1)
        assert row.loglik == pytest.approx(plain_loglik(r, m.start, np.array(m.transition), np.array(m.means), np.array(m.sds)), rel=1e-10)
    chosen = moments.choose_state_count(fits.withColumnRenamed("ticker", "model")).where("chosen")
    assert {r["model"]: r["n_states"] for r in chosen.collect()} == {"A": want, "B": want}


def test_likelihood_of_a_far_away_return(spark):
    """A return that no state explains leaves the sum finite."""
    df = spark.createDataFrame([(1, "A", 0.0), (2, "A", 1e6), (3, "A", 0.0)], "date int, ticker string, r double")
    models = spark.createDataFrame([("A", 2, [1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]], [0.0, 0.1], [0.01, 0.01])],
                                   "ticker string, n_states int, start array<double>, transition array<array<double>>, means array<double>, sds array<double>")
    assert math.isfinite(moments.forward_loglik(df, models).first()["loglik"])


def test_blended_moments(spark):
    mu = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (0, "b", 0.0), (1, "b", 2.0)], "state int, asset string, mu double")
    cov = spark.createDataFrame([(s, i, j, 1.0 + s) for s in (0, 1) for i in "ab" for j in "ab"], "state int, asset_i string, asset_j string, cov double")
    probs = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.1), (2, 0, 0.25), (2, 1, 0.75)], "date int, state int, p double")
    m, c = moments.blended_moments(mu, cov, probs)
    assert vector(m).to_dict() == {"a": 2.5, "b": 1.5} and set(matrix(c).to_numpy().ravel()) == {1.75}
    _, wide = moments.blended_moments(mu, cov, probs, between=True)
    assert np.allclose(matrix(wide), 1.75 + 0.25 * 1.5**2 + 0.75 * 0.5**2)


def test_state_count(spark):
    fits = spark.createDataFrame([("m", 2, 100.0), ("m", 3, 104.0), ("m", 4, 150.0)], "model string, n_states int, loglik double")
    got = {r["n_states"]: (r["score"], r["chosen"]) for r in moments.choose_state_count(fits, 500, 2).collect()}
    for n, ll in ((2, 100.0), (3, 104.0), (4, 150.0)):
        k = n * (n - 1) + n * 2 + n * 3
        assert got[n][0] == pytest.approx(-2 * ll + k * math.log(500))
    assert [n for n, v in got.items() if v[1]] == [min(got, key=lambda n: got[n][0])]


# Risk


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(11)
    data = {p: rng.normal(0.001, 0.02 + 0.01 * p, 137) for p in range(1, 5)}
    rows = [(p, i, float(v)) for p, x in data.items() for i, v in enumerate(x)]
    return data, spark.createDataFrame(rows, "portfolio long, date int, r double").cache()


def test_risk_measures(series):
    data, df = series
    got = risk.risk_table(df).toPandas().set_index("portfolio")
    down = risk.risk_table(df, downside_rows_only=True).toPandas().set_index("portfolio")
    for p, r in data.items():
        n, m, s = len(r), r.mean(), np.sort(r)
        d = r - m
        wealth = np.cumprod(1 + r)
        dd = 1 - wealth / np.maximum.accumulate(wealth)
        cut = max(1, math.floor(0.05 * n))
        want = {
            "variance": r.var(ddof=1), "standard_deviation": r.std(ddof=1), "semi_variance": (np.minimum(d, 0) ** 2).mean(),
            "mean_absolute_deviation": np.abs(d).mean(), "first_lower_partial_moment": np.maximum(-d, 0).mean(),
            "gini_mean_difference": np.abs(r[:, None] - r).sum() / (n * (n - 1)), "fourth_central_moment": (d**4).mean(),
            "fourth_lower_partial_moment": (np.minimum(d, 0) ** 4).mean(), "value_at_risk": -s[math.ceil(0.05 * n) - 1],
            "cvar": -s[:cut].mean(), "worst_realization": -s[0], "entropic_risk": math.log(np.exp(-r).mean() / 0.05),
            "max_drawdown": dd.max(), "average_drawdown": dd.mean(), "ulcer_index": math.sqrt((dd**2).mean()),
            "cdar": np.sort(dd)[::-1][:cut].mean(), "skew": (d**3).mean() / r.std(ddof=1) ** 3,
            "entropic_value_at_risk": min(math.log(np.exp(-z * r).mean() / 0.05) / z for z in risk.Z_GRID),
        }
        for name, v in want.items():
            assert got.loc[p, name] == pytest.approx(v, rel=1e-9, abs=1e-12), name
        assert got.loc[p, "entropic_value_at_risk"] >= got.loc[p, "cvar"]
        assert down.loc[p, "semi_variance"] == pytest.approx((d[d < 0] ** 2).mean())
        assert not got.loc[p, "ruined"]


def test_ruin_is_flagged(spark):
    df = spark.createDataFrame([(1, 1, 0.1), (1, 2, -1.0), (1, 3, 0.2)], "portfolio int, date int, r double")
    assert risk.risk_table(df).first()["ruined"]


def test_blended_risk_uses_the_full_sample_for_thin_states(spark, series):
    data, df = series
    probs = spark.createDataFrame([(i, s, p) for i in range(137) for s, p in ((0, 0.9 if i > 3 else 0.2), (1, 0.1 if i > 3 else 0.8))], "date int, state int, p double")
    got = {r["portfolio"]: r["blended_risk"] for r in risk.blended_risk(df, probs, ["variance", "worst_realization"]).collect()}
    for p, r in data.items():
        assert got[p] == pytest.approx(0.9 * r[4:].var(ddof=1) + 0.1 * max(-r.min(), 0))
    with pytest.raises(ConfigurationError):
        risk.blended_risk(df, probs, ["entropic_value_at_risk", "variance"])


def test_risk_contributions_add_up(spark, factor_returns):
    wide, _, df = factor_returns
    w = portfolios.candidates(df.selectExpr("ticker asset").distinct(), 5)
    got = risk.risk_contributions(moments.covariance(df), w).toPandas()
    assert np.allclose(got.groupby("portfolio")["share"].sum(), 1)
    x = w.toPandas().pivot(index="portfolio", columns="asset", values="w")
    assert np.allclose(got.groupby("portfolio")["contribution"].sum(), [math.sqrt(v @ np.cov(wide.T) @ v) for v in x.to_numpy()])
    assert np.allclose(x.sum(axis=1), 1) and (x.to_numpy() >= 0).all()


def test_candidate_box(spark):
    assets = spark.createDataFrame([(a,) for a in "abcde"], "asset string")
    free = portfolios.candidates(assets, 50).toPandas()
    boxed = portfolios.candidates(assets, 50, lower=0.05, upper=0.4).toPandas()
    assert boxed["w"].between(0.05, 0.4).all() and 0 < boxed["portfolio"].nunique() < free["portfolio"].nunique() == 50


def test_bootstrap_distances_over_blocks(spark, factor_returns, monkeypatch):
    from panelwright.functions import pairs

    wide, _, df = factor_returns
    one = portfolios.bootstrap_distances(df, 6, 10).toPandas().set_index("replicate")["distance"].sort_index()
    monkeypatch.setattr(pairs, "BLOCK", 4)
    many = portfolios.bootstrap_distances(df, 6, 10).toPandas().set_index("replicate")["distance"].sort_index()
    assert np.allclose(one, many)
    axis = spark.createDataFrame([(i,) for i in range(1, 251)], "idx int")
    counts = portfolios.bootstrap_counts(axis, 6, 10).toPandas()
    assert (counts.groupby("replicate")["c"].sum() == 250).all()
    for rep, part in counts.groupby("replicate"):
        rows = np.repeat(part["idx"].to_numpy() - 1, part["c"])
        gap = np.cov(wide.to_numpy()[rows].T) - np.cov(wide.T)
        assert one[rep] == pytest.approx(np.linalg.norm(gap))


def test_backtest_weights_come_from_training_rows(factor_returns):
    wide, _, df = factor_returns
    f = folds.walk_forward(df, 50, 100)
    got = backtest.cross_val_predict(df, f).toPandas().set_index(["fold", "date"])["r"]
    for k in range(3):
        inv = 1 / wide.iloc[k * 50 : k * 50 + 100].std()
        w = inv / inv.sum()
        test = wide.iloc[k * 50 + 100 : k * 50 + 150] @ w
        assert np.allclose(got[k].sort_index(), test)


# Rebalancing

weights_and_rates = st.integers(2, 6).flatmap(
    lambda n: st.tuples(
        st.lists(st.floats(0.01, 1.0), min_size=n, max_size=n),
        st.lists(st.floats(0.01, 1.0), min_size=n, max_size=n),
        st.lists(st.floats(-0.99, 5.0), min_size=n, max_size=n),
    )
)


@settings(max_examples=6, deadline=None)
@given(st.lists(weights_and_rates, min_size=1, max_size=6))
def test_rebalancing_invariants(spark, cases):
    cur, tgt, rets = [], [], []
    for p, (a, b, r) in enumerate(cases):
        for i, (x, y, z) in enumerate(zip(a, b, r)):
            cur.append((p, f"a{p}_{i}", x / sum(a)))
            tgt.append((p, f"a{p}_{i}", y / sum(b)))
            rets.append((f"a{p}_{i}", z))
    schema = "portfolio int, asset string, w double"
    c, t = spark.createDataFrame(cur, schema), spark.createDataFrame(tgt, schema)
    d = rebalance.drifted(c, spark.createDataFrame(rets, "asset string, r double")).toPandas()
    assert np.allclose(d.groupby("portfolio")["w"].sum(), 1) and (d["w"] >= 0).all()
    turn = rebalance.turnover(c, t).toPandas()["turnover"]
    assert turn.between(0, 1 + 1e-12).all()
    assert (rebalance.rebalancing_cost(c, t, 0.001).toPandas()["cost"] >= 0).all()


def test_threshold_is_strict_and_zero_target_never_fires(spark):
    schema = "portfolio int, asset string, w double"
    short = [(3, "a", 1.2), (3, "b", -0.2)]
    c = spark.createDataFrame([(1, "a", 0.55), (1, "b", 0.45), (2, "a", 0.5), (2, "b", 0.5), *short], schema)
    t = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 1.0), (2, "b", 0.0), (3, "a", 1.1), (3, "b", -0.1)], schema)
    fires = lambda rule: {r["portfolio"]: r["fires"] for r in rebalance.threshold_rule(c, t, rule).collect()}
    assert fires(DriftRule(0.06)) == {1: False, 2: True, 3: True}
    assert fires(DriftRule(0.6, relative=True)) == {1: False, 2: False, 3: False}


def test_business_days(spark):
    days = pd.date_range("2023-12-20", periods=40)
    rows = [(str(a.date()), str(b.date()), int(np.busday_count(a.date(), b.date()))) for a in days[::3] for b in days if b >= a]
    df = spark.createDataFrame(rows, "a string, b string, n int").selectExpr("to_date(a) a", "to_date(b) b", "n")
    assert df.where(rebalance.weekdays_between(F.col("a"), F.col("b")) != F.col("n")).count() == 0


# Views


def test_posterior_equals_the_joint_formula(spark, factor_returns):
    wide, _, df = factor_returns
    mu, cov = wide.mean().to_numpy(), np.cov(wide.T)
    p = np.zeros((3, 10))
    p[0, 0], p[1, 2], p[1, 3], p[2, 5] = 1, 1, -1, 1
    q, omega, tau = np.array([0.01, 0.002, -0.004]), np.array([1e-5, 4e-5, 0.0]), 0.05
    v = tau * cov @ p.T
    a = p @ v + np.diag(omega)
    want_mu = mu + v @ np.linalg.solve(a, q - p @ mu) + 0.001
    want_cov = cov + tau * cov - v @ np.linalg.solve(a, v.T)
    rows = [(i, f"A{j}", float(p[i, j])) for i in range(3) for j in range(10) if p[i, j]]
    pick = spark.createDataFrame(rows, "view int, asset string, p double")
    targets = spark.createDataFrame([(i, float(q[i]), float(omega[i])) for i in range(3)], "view int, q double, omega double")
    m, c = views.posterior(moments.mean(df), moments.covariance(df), pick, targets, tau, 0.001)
    assert np.allclose(vector(m), want_mu) and np.allclose(matrix(c), want_cov, atol=1e-14)


def test_track_record_needs_complete_rows(spark):
    rng = np.random.default_rng(0)
    f, r = rng.normal(size=(20, 3)), rng.normal(size=(20, 3))
    cells = [(i, j, float(f[i, j]), float(r[i, j])) for i in range(20) for j in range(3) if (i, j) != (4, 1)]
    df = spark.createDataFrame(cells, "date int, view int, forecast double, realized double")
    got = {x["view"]: x["omega"] for x in views.track_record_uncertainty(df.select("date", "view", "forecast"), df.select("date", "view", "realized")).collect()}
    keep = np.delete(np.arange(20), 4)
    assert got == pytest.approx({j: (f - r)[keep, j].var(ddof=1) for j in range(3)})
    few = df.where("date < 4")
    assert views.track_record_uncertainty(few.select("date", "view", "forecast"), few.select("date", "view", "realized")).count() == 0


def test_tilting_reaches_the_mean(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.02, 500)
    s = spark.createDataFrame([(i, float(v), 1 / 500) for i, v in enumerate(x)], "s int, x double, p0 double")
    p = views.tilt_to_mean(s, 0.01).toPandas().sort_values("s")["p"].to_numpy()
    assert p.sum() == pytest.approx(1) and p @ x == pytest.approx(0.01, abs=1e-10)
    slope = np.polyfit(x, np.log(p), 1)
    assert np.allclose(np.log(p), np.polyval(slope, x))
    with pytest.raises(ConfigurationError):
        views.tilt_to_mean(s, 1.0)
    with pytest.raises(DataError):
        views.tilt_to_mean(s, 0.01, steps=1)


def test_stress_patch_only_without_a_severe_scenario(spark):
    rows = [("a", 2.0, "X", 0.05), ("a", 2.0, "Y", -0.05), ("b", -1.0, "X", -0.02), ("b", -1.0, "Y", -0.03)]
    df = spark.createDataFrame(rows, "scenario string, probability double, asset string, shock double")
    got = {(r["scenario"], r["asset"]): (r["probability"], r["shock"]) for r in views.clamped_scenarios(df).collect()}
    assert got == {("a", "X"): (1 - 1e-4, -0.1), ("a", "Y"): (1 - 1e-4, -0.1), ("b", "X"): (1e-4, -0.02), ("b", "Y"): (1e-4, -0.03)}
    bad = df.unionByName(spark.createDataFrame([("c", 0.1, "X", -2.0)], df.schema))
    kept = {(r["scenario"], r["asset"]): r["shock"] for r in views.clamped_scenarios(bad).collect()}
    assert kept[("a", "X")] == 0.05 and kept[("c", "X")] == -0.9999


def test_sentiment(spark):
    rows = [("T", "2024-01-10 00:00:00", 1.0), ("T", "2024-01-05 00:00:00", 2.0), ("T", "2024-01-11 00:00:00", 0.5)]
    df = spark.createDataFrame(rows, "ticker string, p string, score double").selectExpr("ticker", "to_timestamp(p) published", "score")
    s = views.sentiment_signal(df, "2024-01-10 00:00:00")
    assert s.first()["signal"] == pytest.approx(1 + 2 * 0.5 + 0.5)
    v = spark.createDataFrame([("T", 1, 0.2), ("T", -1, 0.2), ("U", 1, 0.2)], "ticker string, direction int, alpha double")
    sig = spark.createDataFrame([("T", 0.3)], "ticker string, signal double")
    got = [(r["direction"], round(r["alpha"], 6)) for r in views.adjusted_confidence(v, sig).orderBy("ticker", "direction").collect()]
    assert got == [(-1, 0.14), (1, 0.26), (1, 0.2)]


def test_indicators_need_a_year(spark):
    rng = np.random.default_rng(2)
    close = pd.Series(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 300))), index=pd.bdate_range("2023-01-02", periods=300))
    df = spark.createDataFrame(long(close.to_frame("A"), "close").assign(), "date date, ticker string, close double")
    got = views.indicators(df).first()
    c = close.tolist()
    d = np.diff(c[-15:])
    assert got["momentum_12_1"] == pytest.approx(c[-22] / c[-253] - 1) and got["momentum_1m"] == pytest.approx(c[-1] / c[-22] - 1)
    assert got["rsi"] == pytest.approx(100 - 100 / (1 + d[d > 0].sum() / -d[d < 0].sum()))
    assert got["from_high"] == pytest.approx(c[-1] / max(c[-252:]) - 1)
    short = views.indicators(df.where("date < date'2023-12-01'")).first()
    assert short["momentum_12_1"] is None and short["momentum_1m"] is None and short["rsi"] is not None


def test_calendar_rule_by_frequency(spark):
    rows = [(1, "2024-01-01", "2024-01-29"), (2, "2024-01-01", "2024-01-30"), (3, "2023-01-02", "2024-01-02"), (4, None, "2024-01-02")]
    r = spark.createDataFrame(rows, "portfolio int, last_review string, today string").select(
        "portfolio", F.col("last_review").cast("date"), F.col("today").cast("date"))
    got = {(x.portfolio, x.frequency): (x.elapsed, x.due) for x in rebalance.calendar_rule(r).collect()}
    assert got[1, "monthly"] == (20, False) and got[2, "monthly"] == (21, True) and got[2, "quarterly"] == (21, False)
    assert got[3, "semiannual"] == (261, True) and got[3, "annual"] == (261, True) and got[4, "annual"] == (None, True) and len(got) == 16
    assert DriftRule.every("quarterly", 0.1) == DriftRule(0.1, False, 63)
    for call in (lambda: rebalance.calendar_rule(r, ["weekly"]), lambda: DriftRule.every("weekly")):
        with pytest.raises(ConfigurationError):
            call()


@pytest.mark.parametrize("method", ["james_stein", "bayes_stein"])
def test_shrunk_means_take_every_return(spark, method):
    """Gaps on every date: no date is complete, and each return still counts."""
    rng = np.random.default_rng(9)
    x = 0.01 * rng.normal(size=(240, 1)) + rng.normal(0.001 * np.arange(6), 0.02, (240, 6))
    x[np.arange(240), rng.integers(0, 6, 240)] = np.nan
    wide = pd.DataFrame(x, columns=list("ABCDEF"), index=pd.bdate_range("2024-01-01", periods=240))
    rows = wide.rename_axis(index="date", columns="ticker").stack().rename("r").reset_index()
    mu, cov = wide.mean(), wide.cov().to_numpy()
    gap = mu - mu.mean()
    if method == "james_stein":
        beta = (np.trace(cov) - 2 * np.linalg.eigvalsh(cov)[-1]) / (gap @ gap) / 240
    else:
        beta = 8 / (8 + 240 * gap @ np.linalg.solve(cov, gap))
    df = spark.createDataFrame(rows.dropna(), "date timestamp, ticker string, r double")
    got = moments.shrunk_mean(df, method).toPandas().set_index("asset")["mu"]
    assert np.allclose(got.loc[list("ABCDEF")], (1 - beta) * mu + beta * mu.mean(), rtol=1e-9)


def test_shrunk_mean_twins_read_every_week():
    from panelwright.catalog import COMPLETE

    assert not COMPLETE & {"e2_shrunk_mean_james_stein", "e2_shrunk_mean_bayes_stein"}
