"""Factor validation, folds, mimicking portfolios and alpha against re-computation."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from panels import long
from panelwright.operators import alpha, folds, mimicking, research
from panelwright.errors import ConfigurationError


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(42)
    dates = pd.date_range("2019-01-31", periods=48, freq="ME")
    names = [f"T{i:02d}" for i in range(30)]
    scores = {f: pd.DataFrame(np.round(rng.normal(size=(48, 30)), 1), index=dates, columns=names) for f in ("value", "momentum")}
    scores["momentum"] = scores["momentum"].mask(rng.random((48, 30)) < 0.1)
    fwd = pd.DataFrame(rng.normal(0.002, 0.04, (48, 30)), index=dates, columns=names).mask(rng.random((48, 30)) < 0.05)
    rows = pd.concat([long(s, "x").assign(factor=f) for f, s in scores.items()])[["date", "ticker", "factor", "x"]]
    s = spark.createDataFrame(rows, "date date, ticker string, factor string, x double").cache()
    f = spark.createDataFrame(long(fwd, "fwd"), "date date, ticker string, fwd double").cache()
    return scores, fwd, s, f


def test_rank_ic(panel):
    scores, fwd, s, f = panel
    got = research.ic_series(s, f).toPandas().set_index(["factor", "date"])["ic"]
    for name, frame in scores.items():
        for d in frame.index:
            both = pd.DataFrame({"x": frame.loc[d], "y": fwd.loc[d]}).dropna().rank()
            assert got[(name, d.date())] == pytest.approx(both["x"].corr(both["y"]))


def newey_west(x, lags):
    d = x - x.mean()
    v = (d**2).mean()
    for k in range(1, min(lags, len(x) - 1) + 1):
        v += 2 * (1 - k / (lags + 1)) * (d[k:] * d[:-k]).mean()
    return max(v, 1e-12)


def test_newey_west_divides_by_its_own_terms(spark):
    rng = np.random.default_rng(0)
    data = {"a": rng.normal(0.05, 0.02, 60), "b": rng.normal(0, 0.15, 9), "c": np.array([0.1, 0.2])}
    rows = [(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)]
    got = research.ic_stats(spark.createDataFrame(rows, "factor string, date int, ic double"), 6).toPandas().set_index("factor")
    for k in ("a", "b"):
        x = data[k]
        v = newey_west(x, 6)
        assert got.loc[k, "variance_nw"] == pytest.approx(v)
        assert got.loc[k, "t_stat"] == pytest.approx(x.mean() / math.sqrt(v / len(x)))
    assert got.loc["c", "t_stat"] == 0 and got.loc["c", "p_value"] == 1


def test_adjusted_p_values(spark):
    p = [0.001, 0.04, 0.03, 0.8, 0.012]
    df = spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(p)], "factor string, p_value double")
    got = research.adjust_p_values(df).toPandas().set_index("factor").loc[[f"f{i}" for i in range(5)]]
    order = np.argsort(p)
    s = np.array(p)[order]
    holm, bh = np.empty(5), np.empty(5)
    holm[order] = np.maximum.accumulate(np.minimum(1, s * (5 - np.arange(5))))
    bh[order] = np.minimum.accumulate(np.minimum(1, s * 5 / np.arange(1, 6))[::-1])[::-1]
    assert np.allclose(got["p_holm"], holm) and np.allclose(got["p_bh"], bh)
    flags = research.bh_rejections(df).toPandas().set_index("factor")["rejected"]
    assert flags["f0"] and not flags["f3"]
    assert (flags.loc[got.index] == got["significant_bh"]).all()


def test_quantile_spread_merges_equal_edges(panel):
    scores, fwd, s, f = panel
    got = research.quantile_spread(research.paired(s, f)).toPandas().set_index(["factor", "date"])["spread"]
    for name, frame in scores.items():
        for d in frame.index:
            both = pd.DataFrame({"x": frame.loc[d], "y": fwd.loc[d]}).dropna()
            means = both["y"].groupby(pd.qcut(both["x"], 5, labels=False, duplicates="drop")).mean()
            assert got[(name, d.date())] == pytest.approx(means.iloc[-1] - means.iloc[0])


def test_variance_inflation_and_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    x[:, 3] = x[:, 0] + 0.3 * x[:, 1] + 0.2 * rng.normal(size=300)
    names = list("abcd")
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    got = {r["factor"]: r["vif"] for r in research.variance_inflation(df, names).collect()}
    for i, n in enumerate(names):
        others = np.column_stack([np.ones(300), np.delete(x, i, axis=1)])
        res = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        assert got[n] == pytest.approx(((x[:, i] - x[:, i].mean()) ** 2).sum() / (res**2).sum())
    assert {r["factor"] for r in research.redundant_factors(df, names, 5.0).collect()} == {"a", "d"}
    one = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert {r["vif"] for r in research.variance_inflation(one, ["a", "b"]).collect()} == {1.0}
    pcs = research.factor_components(df, names).toPandas()
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1] / 4
    assert np.allclose(pcs.groupby("component")["explained"].first(), values)
    assert pcs["needed_95"].iloc[0] == int(np.searchsorted(np.cumsum(values), 0.95)) + 1
    with pytest.raises(ConfigurationError):
        research.factor_components(df, ["a"])


def test_mimicking_portfolios(panel):
    scores, fwd, s, f = panel
    pairs = research.paired(s, f)
    got = mimicking.long_short(pairs).toPandas().set_index(["factor", "date"])["factor_return"]
    value = mimicking.long_short(pairs, weighting="value").toPandas().set_index(["factor", "date"])["factor_return"]
    quint = mimicking.quantile_portfolios(pairs).toPandas().set_index(["factor", "date"])
    for name, frame in scores.items():
        for d in frame.index:
            both = pd.DataFrame({"x": frame.loc[d], "y": fwd.loc[d]}).dropna().sort_index(kind="stable").sort_values("x", kind="stable")
            k = max(1, math.ceil(len(both) * 0.3))
            lo, hi = both.iloc[:k], both.iloc[-k:]
            assert got[(name, d.date())] == pytest.approx(hi["y"].mean() - lo["y"].mean())
            assert value[(name, d.date())] == pytest.approx(np.average(hi["y"], weights=hi["x"].abs()) - np.average(lo["y"], weights=lo["x"].abs()))
            b = pd.qcut(np.arange(1, len(both) + 1), 5, labels=False)
            assert np.allclose(quint.loc[(name, d.date()), [f"q{i}" for i in range(1, 6)]].astype(float), both["y"].groupby(b).mean())
    with pytest.raises(ConfigurationError):
        mimicking.long_short(pairs, 0.6)


def dates_panel(spark, n):
    return spark.createDataFrame([(f"{d.date()}", "A") for d in pd.bdate_range("2020-01-01", periods=n)], "d string, ticker string").selectExpr("to_date(d) date", "ticker")


@pytest.mark.parametrize("n", [30, 48, 60, 61])
def test_rolling_folds(spark, n):
    got = folds.rolling_folds(dates_panel(spark, n)).toPandas()
    want = {}
    for i in range(max(0, (n - 36) // 6)):
        a, b = i * 6, i * 6 + 36
        if b < n:
            want[i] = (list(range(a + 1, b + 1)), list(range(b + 1, min(b + 12, n) + 1)))
    assert set(got["fold"]) == set(want)
    for i, (train, test) in want.items():
        part = got[got["fold"] == i]
        assert sorted(part[part["role"] == "train"]["idx"]) == train and sorted(part[part["role"] == "test"]["idx"]) == test


def test_combinatorial_folds(spark):
    n, blocks, k, purge, embargo = 53, 6, 2, 2, 3
    got = folds.combinatorial_folds(dates_panel(spark, n), blocks, k, purge, embargo).toPandas()
    assert got["fold"].nunique() == 15
    size = n // blocks
    bounds = [(i * size, (i + 1) * size if i < blocks - 1 else n) for i in range(blocks)]
    for fold, combo in enumerate(combinations(range(blocks), k)):
        test = {i for b in combo for i in range(*bounds[b])}
        bad = {t + o for t in test for o in range(-purge, purge + 1)} | {bounds[b][1] + o for b in combo for o in range(embargo)}
        part = got[got["fold"] == fold]
        assert set(part[part["role"] == "test"]["idx"] - 1) == test
        assert set(part[part["role"] == "train"]["idx"] - 1) == set(range(n)) - test - bad
    paths = folds.test_paths(spark.createDataFrame(got.astype({"date": str}))).toPandas()
    assert paths["path"].max() == 4 and (paths.groupby("path")["block"].agg(set) == set(range(6))).all()


def test_walk_forward_sizes(spark):
    got = folds.walk_forward(dates_panel(spark, 400), 63, 252, 5).toPandas()
    sizes = got.groupby(["fold", "role"]).size().unstack()
    assert sizes.values.tolist() == [[63, 252], [63, 252]]
    gap = got[got["role"] == "test"].groupby("fold")["idx"].min() - got[got["role"] == "train"].groupby("fold")["idx"].max()
    assert set(gap) == {6}


def test_fold_count_search_brute_force(spark):
    got = folds.fold_count_search(dates_panel(spark, 500), 300, 10, max_blocks=10).toPandas()
    best = min(((abs(500 / n * (n - k) - 300) / 300 + abs(math.comb(n, k) * k // n - 10) / 10, n, k) for n in range(3, 11) for k in range(2, n)))
    row = got[got["best"]].iloc[0]
    assert (row["n_blocks"], row["n_test"]) == best[1:]


def test_expected_returns_by_the_formula(spark):
    groups = spark.createDataFrame([("A", "value", 1.0), ("A", "momentum", 0.5), ("B", "value", -1.0), ("B", "momentum", None)], "ticker string, grp string, score double")
    betas = spark.createDataFrame([("A", 1.2)], "ticker string, beta double")
    got = {r["ticker"]: r["expected"] for r in alpha.expected_returns(groups, betas, {"market": 0.05, "value": 0.03, "momentum": 0.04}).collect()}
    assert got == pytest.approx({"A": 0.06 + 0.03 + 0.02, "B": 0.05 - 0.03})


def test_turnover_counts_names_that_leave(spark):
    rng = np.random.default_rng(3)
    w = pd.DataFrame(rng.random((8, 6)), columns=list("ABCDEF")).mask(rng.random((8, 6)) < 0.4)
    w = w.div(w.sum(axis=1), axis=0)
    rows = [(i, a, float(v)) for i, r in w.iterrows() for a, v in r.dropna().items()]
    got = alpha.turnover_series(spark.createDataFrame(rows, "as_of int, asset string, w double")).orderBy("as_of").toPandas()
    want = w.fillna(0).diff().abs().sum(axis=1)[1:] / 2
    assert np.allclose(got["turnover"], want)


def test_exposure_bounds(spark):
    s = spark.createDataFrame([("f", "A", 1.0), ("f", "B", -0.5)], "factor string, ticker string, x double")
    rows = alpha.exposure_rows(s, {"f": (-0.1, 0.3)}).collect()
    assert {(r["row"], r["ticker"]): (r["a"], r["b"]) for r in rows} == {
        ("lower", "A"): (-1.0, 0.1), ("upper", "A"): (1.0, 0.3), ("lower", "B"): (0.5, 0.1), ("upper", "B"): (-0.5, 0.3)}
    assert alpha.exposure_check(s, {"f": (-0.1, 0.3)}).first()["feasible"]
    assert not alpha.exposure_check(s, {"f": (0.3, 0.4)}).first()["feasible"]
    with pytest.raises(ConfigurationError):
        alpha.exposure_check(s, {"f": (0.5, 0.4)})
