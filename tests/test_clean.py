"""Cleaning and pre-selection against pandas re-computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panels import long
from panelwright.config import CleaningConfig
from panelwright.errors import DataError
from panelwright.operators import clean
from panelwright.sources import panel as P


def frame_of(df, value="r"):
    out = df.toPandas().pivot(index="date", columns="ticker", values=value)
    out.index = pd.to_datetime(out.index)
    return out


def to_spark(spark, wide, value="r"):
    return spark.createDataFrame(long(wide, value), f"date date, ticker string, {value} double")


def test_returns_use_the_previous_panel_date(spark):
    prices = pd.DataFrame({"A": [100, 110, 121.0], "B": [50, np.nan, 60.0]}, index=pd.bdate_range("2024-01-01", periods=3))
    got = frame_of(P.simple_returns(to_spark(spark, prices, "close")))
    assert got["A"].tolist()[1:] == pytest.approx([0.1, 0.1])
    assert got["B"].isna().all()


def test_validator_and_outliers(spark):
    r = pd.DataFrame({"A": [0.01, -0.01, 0.02, -0.02, 0.0, 0.01] * 5}, index=pd.bdate_range("2024-01-01", periods=30))
    train = to_spark(spark, r)
    stats = clean.outlier_stats(train)
    m, s = r["A"].mean(), r["A"].std()
    test = pd.DataFrame({"A": [m + 5 * s, m - 4 * s, m + 50 * s, m + s]}, index=pd.bdate_range("2025-01-01", periods=4))
    got = frame_of(clean.treat_outliers(to_spark(spark, test), stats))["A"].tolist()
    assert got[0] == pytest.approx(m + 3 * s) and got[1] == pytest.approx(m - 3 * s)
    assert np.isnan(got[2]) and got[3] == pytest.approx(m + s)
    bad = spark.createDataFrame([("A", float("inf")), ("A", float("nan")), ("A", -11.0), ("A", 9.0)], "ticker string, r double")
    assert [x["r"] for x in clean.validate(bad).collect()] == [None, None, None, 9.0]


def test_sector_imputation(spark):
    r = pd.DataFrame(
        {"A": [np.nan, 0.02], "B": [0.04, 0.01], "C": [0.10, np.nan], "D": [0.2, np.nan]}, index=pd.bdate_range("2024-01-01", periods=2)
    )
    sectors = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y"), ("D", "y")], "ticker string, sector string")
    got = frame_of(clean.impute_by_sector(to_spark(spark, r), sectors))
    assert got["A"].iloc[0] == pytest.approx(0.04)
    assert got["C"].iloc[1] == pytest.approx(0.015) and got["D"].iloc[1] == pytest.approx(0.015)


def test_regression_imputation_matches_least_squares(spark):
    rng = np.random.default_rng(17)
    f = rng.standard_t(6, 150) * 0.015
    load = {"P": 1.3, "Q": 0.9, "R": 0.45, "S": -0.8, "T": 0.1}
    full = pd.DataFrame({k: v * f + rng.normal(0, 0.004, 150) for k, v in load.items()}, index=pd.bdate_range("2022-03-01", periods=150))
    gaps = full.copy()
    for row, col in ((90, "P"), (121, "Q"), (140, "R")):
        gaps.iloc[row, gaps.columns.get_loc(col)] = np.nan
    df = to_spark(spark, gaps)
    sectors = spark.createDataFrame([(k, "s") for k in load], "ticker string, sector string")
    got = frame_of(clean.impute_by_regression(df, df, sectors))
    for row, col in ((90, "P"), (121, "Q"), (140, "R")):
        others = [c for c in gaps if c != col]
        rows = gaps.dropna()
        x = np.column_stack([np.ones(len(rows)), rows[others]])
        beta = np.linalg.lstsq(x, rows[col], rcond=None)[0]
        assert got[col].iloc[row] == pytest.approx(beta[0] + gaps[others].iloc[row] @ beta[1:], abs=1e-9)
    assert np.allclose(got.to_numpy()[gaps.notna()], gaps.to_numpy()[gaps.notna()])


def test_regression_imputation_falls_back(spark):
    r = pd.DataFrame(np.random.default_rng(1).normal(0, 1, (30, 3)), columns=list("ABC"), index=pd.bdate_range("2024-01-01", periods=30))
    r.iloc[4, 0] = np.nan
    df = to_spark(spark, r)
    sectors = spark.createDataFrame([(k, "s") for k in "ABC"], "ticker string, sector string")
    got = frame_of(clean.impute_by_regression(df, df, sectors))
    assert got["A"].iloc[4] == pytest.approx(r.iloc[4, 1:].mean())


def test_delisting_return(spark):
    r = pd.DataFrame({"A": [0.1, 0.2, np.nan], "B": [0.1, 0.2, 0.3]}, index=pd.bdate_range("2024-01-01", periods=3))
    df = to_spark(spark, r)
    d = spark.createDataFrame([("A", -0.5)], "ticker string, delisting_return double")
    got = frame_of(clean.apply_delisting_returns(df, d))
    assert got["A"].tolist()[:2] == [0.1, -0.5] and got["B"].tolist() == [0.1, 0.2, 0.3]
    with pytest.raises(DataError):
        clean.apply_delisting_returns(df, spark.createDataFrame([("Z", -0.5)], "ticker string, delisting_return double"))


@pytest.mark.parametrize("threshold,absolute", [(0.3, False), (0.15, False), (0.2, True)])
def test_correlated_assets_match_one_sorted_pass(spark, threshold, absolute):
    rng = np.random.default_rng(5)
    common = rng.normal(0, 1, (150, 3))
    x = common[:, rng.integers(0, 3, 14)] * rng.uniform(-1, 1.5, 14) + rng.normal(0, 1, (150, 14))
    r = pd.DataFrame(x, columns=[f"T{i:02d}" for i in range(14)], index=pd.bdate_range("2024-01-01", periods=150))
    corr = r.corr().abs() if absolute else r.corr()
    mean = corr.mean()
    names = list(r.columns)
    order = sorted(((corr.iloc[i, j], names[i], names[j]) for i in range(14) for j in range(i + 1, 14) if corr.iloc[i, j] > threshold), reverse=True)
    gone = set()
    for _, a, b in order:
        if a not in gone and b not in gone:
            gone.add(a if mean[a] > mean[b] else b)
    got = {x["ticker"] for x in clean.correlated_assets(to_spark(spark, r), threshold, absolute).collect()}
    assert got == gone and gone


def test_pareto_front_with_ties(spark):
    rng = np.random.default_rng(8)
    pts = [(f"t{i}", float(m), float(s)) for i, (m, s) in enumerate(zip(rng.integers(0, 12, 150) / 100, rng.integers(1, 15, 150) / 100))]
    keep = {t for t, m, s in pts if not any(m2 >= m and s2 <= s and (m2 > m or s2 < s) for _, m2, s2 in pts)}
    df = spark.createDataFrame(pts, "ticker string, mean double, sd double")
    assert {x["ticker"] for x in clean.pareto_front(df).collect()} == keep


def test_pre_selection_learns_on_train_only(spark, returns):
    sectors = spark.createDataFrame([(f"N{i:02d}", f"s{i % 4}") for i in range(18)], "ticker string, sector string")
    days = sorted({x["date"] for x in returns.select("date").distinct().collect()})
    train = returns.where(F.col("date") < F.lit(days[150]))
    fitted = clean.fit_pre_selection(train, sectors, CleaningConfig(top_k=6))
    best = frame_of(train).mean().sort_values(ascending=False).index[:6]
    assert {x["ticker"] for x in fitted.assets.collect()} == set(best)
    test = frame_of(fitted.transform(returns.where(F.col("date") >= F.lit(days[150]))))
    assert test.shape == (len(days) - 150, 6) and test.notna().all().all()


def test_survivorship_flag(spark):
    r = pd.DataFrame({"A": [0.1] * 14, "B": [0.2] * 14}, index=pd.bdate_range("2024-01-01", periods=14))
    flag = lambda w: clean.no_terminal_zero_returns(to_spark(spark, w)).first()["suspected"]
    assert flag(r) is True
    zero = r.copy()
    zero.iloc[-1, 0] = 0.0
    assert flag(zero) is False and flag(r.iloc[:5]) is False


def test_delisting_price(spark):
    prices = to_spark(spark, pd.DataFrame({"A": [10.0, 11.0, np.nan], "B": [5.0, 6.0, 7.0]}, index=pd.bdate_range("2024-01-01", periods=3)), "close")
    d = spark.createDataFrame([("A", "2024-01-03", None), ("B", "2024-01-03", -0.9)], "ticker string, d string, delisting_return double").selectExpr("ticker", "to_date(d) delisted_at", "delisting_return")
    got = frame_of(P.append_delisting_prices(prices, d), "close")
    assert got["A"].iloc[2] == pytest.approx(11 * 0.7)
    assert got["B"].iloc[2] == 7.0


def test_correlated_groups_match_one_sorted_pass(spark, monkeypatch):
    """Equal series, chains across groups and gaps: as one pass over the sorted pairs, and a group of equal series takes one round, not one per asset."""
    rng = np.random.default_rng(8)
    base = rng.normal(0, 1, (60, 4))
    x = np.column_stack([base[:, [k]].repeat(12, axis=1) for k in range(4)] + [base @ rng.normal(0, 1, (4, 16)) + 0.3 * rng.normal(0, 1, (60, 16))])
    r = pd.DataFrame(x, columns=[f"T{i:02d}" for i in rng.permutation(x.shape[1])], index=pd.bdate_range("2024-01-01", periods=60))
    r = r[sorted(r.columns)]
    r.iloc[:5, 7] = np.nan
    names, corr = list(r.columns), r.corr().round(12).to_numpy()
    mean = corr.mean(axis=1)
    pairs = sorted(((corr[i, j], names[i], names[j], i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if corr[i, j] > 0.5), reverse=True)
    want = set()
    for _, a, b, i, j in pairs:
        if a not in want and b not in want:
            want.add(a if round(mean[i] - mean[j], 12) > 0 else b)
    rounds = []
    decided = clean._decided
    monkeypatch.setattr(clean, "_decided", lambda p: rounds.append(1) or decided(p))
    for limit in (clean.GROUP_PAIRS, 40):
        monkeypatch.setattr(clean, "GROUP_PAIRS", limit)
        rounds.clear()
        got = {x["ticker"] for x in clean.correlated_assets(to_spark(spark, r), 0.5).collect()}
        assert got == want and len(want) > 40
        if limit > 40:
            assert len(rounds) < 8
