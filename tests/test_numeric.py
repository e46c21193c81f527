"""Distribution functions, distributed ranks and pair sums against numpy and pandas."""

import math
import re
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from panels import long
from panelwright.functions import dist, pairs
from panelwright.functions.stats import normal_quantile, t_two_sided
from panelwright.operators import moments


def test_normal_quantile(spark):
    ps = [1e-12, 1e-5, 0.01, 0.0749, 0.076, 0.3, 0.5, 0.7, 0.95, 0.999999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect()
    for r in got:
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-9, rel=1e-9)


def test_t_two_sided(spark):
    def brute(t, nu):
        xs = np.linspace(0, abs(t), 40001)
        c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
        return 1 - 2 * np.trapezoid(c * (1 + xs**2 / nu) ** (-(nu + 1) / 2), xs)

    cases = [(t, nu) for t in (0.0, 0.3, -1.5, 2.2, 5.0) for nu in (1, 2, 3, 4, 7, 10, 59, 60)]
    got = spark.createDataFrame(cases, "t double, nu int").select("t", "nu", t_two_sided(F.col("t"), F.col("nu")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(brute(r["t"], r["nu"]), abs=1e-7)


@pytest.fixture(scope="module")
def skewed(spark):
    """Three groups; one holds most rows and a third of them share one value."""
    rng = np.random.default_rng(3)
    n = 3000
    x = np.where(rng.random(n) < 0.34, 0.25, rng.normal(0, 1, n) ** 3)
    x[::17] = np.round(x[::17], 1)
    x[5], x[6] = 0.0, -1e-300
    frame = pd.DataFrame({"g": rng.choice(["a", "a", "a", "b", "c"], n), "name": [f"n{i:05d}" for i in range(n)], "x": x})
    frame.loc[::23, "x"] = np.nan
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "g string, name string, x double")
    return frame, df.cache()


def test_average_rank(skewed):
    frame, df = skewed
    got = dist.with_average_rank(df, ["g"], "x", "rk", "n").toPandas().set_index("name")
    want = frame.dropna().set_index("name")
    ranks = want.groupby("g")["x"].rank(method="average")
    assert len(got) == len(want)
    assert np.allclose(got.loc[want.index, "rk"], ranks)
    assert (got.loc[want.index, "n"] == want.groupby("g")["x"].transform("size")).all()


@pytest.mark.parametrize("rows", [100_000, 50])
def test_row_number(skewed, monkeypatch, rows):
    monkeypatch.setattr(dist, "RANGE_ROWS", rows)
    frame, df = skewed
    got = dist.with_row_number(df, ["g"], "x", "name", "rn", "n").toPandas()
    for _, part in got.groupby("g"):
        order = part.sort_values(["x", "name"])
        assert list(order["rn"]) == list(range(1, len(part) + 1))
        assert (part["n"] == len(part)).all()


def test_text_code_keeps_the_order(spark):
    words = ["", "A", "AB", "ABCDEF", "ABCDEFG", "B", "S1", "S10", "S2", "Zé", "Zz", "é"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", dist._text_code(F.col("w")).alias("c")).orderBy("w").collect()
    codes = [r["c"] for r in got]
    assert codes == sorted(codes) and codes[0] >= 1


@pytest.fixture
def clustered(spark, monkeypatch):
    """Distinct values inside a billionth of each other, a value that many share, and clusters within clusters."""
    monkeypatch.setattr(dist, "RANGE_ROWS", 60)
    monkeypatch.setattr(dist, "SPLIT", 8)
    rng = np.random.default_rng(9)
    x = np.concatenate([1 + 1e-9 * rng.random(900), 1 + 1e-9 * 2.0 ** -rng.integers(1, 20, 900), np.full(700, 1 + 5e-10), [np.nextafter(1, 2), 1.0], -rng.random(200), [0.0, 5e-324, 1e300]])
    frame = pd.DataFrame({"g": np.where(rng.random(len(x)) < 0.9, "a", "b"), "name": [f"a common beginning {i:05d}" for i in rng.permutation(len(x))], "x": x})
    return frame, spark.createDataFrame(frame, "g string, name string, x double").repartition(5)


def test_ranges_are_small_or_of_one_value(clustered):
    frame, df = clustered
    rows, path, ranges = dist.in_ranges(df, ["g"], F.col("x"))
    found = ranges.collect()
    assert len(path) > 3 and all(r["_cnt"] <= 60 or r["_flat"] for r in found) and sum(r["_cnt"] for r in found) == len(frame)
    assert rows.join(ranges, ["g", *path]).count() == len(frame)
    # shared values are dealt on by the text, whose first eighteen bytes are the same
    named = dist.in_ranges(df, ["g"], F.col("x"), *[dist._text_code(F.col("name"), at) for at in (1, 7, 13, 19)])[2]
    assert named.agg(F.max("_cnt")).first()[0] <= 60


def test_ranks_of_clustered_values(clustered):
    frame, df = clustered
    by = frame.set_index("name")
    ranks = dist.with_average_rank(df, ["g"], "x", "rk", "n").toPandas().set_index("name")
    assert np.array_equal(ranks.loc[by.index, "rk"], by.groupby("g")["x"].rank(method="average"))
    order = frame.sort_values(["g", "x", "name"])
    numbers = dist.with_row_number(df, ["g"], "x", "name", "rn", "n").toPandas().set_index("name")
    assert np.array_equal(numbers.loc[order["name"], "rn"], order.groupby("g").cumcount() + 1)
    got = dist.group_quantiles(df, ["g"], "x", {"a": 0.1, "b": 0.37, "c": 0.9}).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        assert np.allclose(got.loc[g, ["a", "b", "c"]].to_numpy(float), np.quantile(part["x"], [0.1, 0.37, 0.9]), rtol=1e-15)


def test_pareto_front_of_clustered_points(spark, clustered):
    from panelwright.operators.clean import pareto_front

    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"ticker": [f"p{i}" for i in range(600)], "mean": rng.integers(0, 40, 600) / 8, "sd": np.where(rng.random(600) < 0.5, 0.25, 0.25 + 1e-12 * rng.integers(1, 99, 600))})
    beaten = [((frame["mean"] >= r.mean_) & (frame["sd"] <= r.sd) & ((frame["mean"] > r.mean_) | (frame["sd"] < r.sd))).any() for r in frame.rename(columns={"mean": "mean_"}).itertuples()]
    got = {r["ticker"] for r in pareto_front(spark.createDataFrame(frame)).collect()}
    assert got == set(frame["ticker"][~np.array(beaten)])


def test_group_quantiles(skewed):
    frame, df = skewed
    probs = {"q0": 0.0, "q01": 0.01, "q25": 0.25, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    got = dist.group_quantiles(df, ["g"], "x", probs, "n").toPandas().set_index("g")
    for g, part in frame.dropna().groupby("g"):
        for name, p in probs.items():
            assert got.loc[g, name] == pytest.approx(np.quantile(part["x"], p), rel=1e-12, abs=1e-12)


def test_quantiles_without_keys(skewed):
    frame, df = skewed
    got = dist.group_quantiles(df, [], "x", {"q": 0.8}).first()["q"]
    assert got == pytest.approx(frame["x"].dropna().quantile(0.8))


def test_pair_moments_over_blocks_and_gaps(spark, wide_returns, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 6)
    gaps = wide_returns.mask(np.random.default_rng(1).random(wide_returns.shape) < 0.1)
    df = spark.createDataFrame(long(gaps), "date date, ticker string, r double")
    kernel = pairs.blocked_pairs(df, pairs._sum_kernel, pairs.SUMS, chunk=37)
    got = pairs.mirrored(pairs.with_moments(kernel)).toPandas()
    assert len(got) == wide_returns.shape[1] ** 2
    cov = got.pivot(index="asset_i", columns="asset_j", values="cov")
    corr = got.pivot(index="asset_i", columns="asset_j", values="corr")
    assert np.allclose(cov, gaps.cov(), atol=1e-12)
    assert np.allclose(corr, gaps.corr(), atol=1e-9)


def test_covariance_of_all_pairs_takes_little_room(spark, tmp_path):
    """Names stand in runs that the files hold in next to no room."""
    rng = np.random.default_rng(9)
    wide = pd.DataFrame(rng.normal(0, 0.1, (30, 300)), index=pd.bdate_range("2021-06-01", periods=30), columns=[f"S{i}" for i in range(300)])
    wide = wide.mask(rng.random(wide.shape) < 0.1)
    wide.iloc[:15, 7] = wide.iloc[15:, 200] = np.nan  # these never meet
    got = moments.covariance(spark.createDataFrame(long(wide), "date date, ticker string, r double")).select("asset_i", "asset_j", "n", "cov")
    got.coalesce(1).write.parquet(f"{tmp_path}/cov")
    file = pq.ParquetFile(next(tmp_path.glob("cov/*.parquet")))
    rows = file.read().to_pandas().set_index(["asset_i", "asset_j"])
    seen = wide.notna().astype(int)
    n = (seen.T @ seen).stack()
    n = n[n > 0]
    assert rows.index.is_unique and len(rows) == len(n) == 300 * 300 - 2 and (rows["n"] == n.loc[rows.index]).all()
    assert np.allclose(rows["cov"], wide.cov().stack(future_stack=True).loc[rows.index], atol=1e-12)
    assert (rows["cov"].to_numpy() == rows["cov"].loc[[(j, i) for i, j in rows.index]].to_numpy()).all()
    room = {}
    for g in range(file.metadata.num_row_groups):
        for c in map(file.metadata.row_group(g).column, range(4)):
            room[c.path_in_schema] = room.get(c.path_in_schema, 0) + c.total_compressed_size / len(rows)
    assert room["asset_i"] + room["asset_j"] < 0.5 and sum(room.values()) < 7


def test_mirrored_keeps_diagonal_once(spark):
    df = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 2.0)], "asset_i string, asset_j string, v double")
    assert sorted(map(tuple, pairs.mirrored(df).collect())) == [("a", "a", 1.0), ("a", "b", 2.0), ("b", "a", 2.0)]


def test_rectangular_product_over_blocks_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 4)
    monkeypatch.setattr(pairs, "CHUNK", 7)
    rng = np.random.default_rng(6)
    w = pd.DataFrame({"fold": rng.integers(0, 3, 300), "name": rng.choice(["p", "q", "r", "s"], 300), "ticker": rng.choice([f"t{i}" for i in range(20)], 300), "a": rng.normal(size=300)})
    w = w.drop_duplicates(["fold", "name", "ticker"])
    x = pd.DataFrame([(f"t{i}", d, rng.normal()) for i in range(2, 25) for d in range(30) if rng.random() < 0.3], columns=["ticker", "day", "b"])
    df, dx = spark.createDataFrame(w), spark.createDataFrame(x)
    df = df.unionByName(spark.createDataFrame([(0, "lonely", "none", 1.0), (1, "p", None, 1.0), (2, "q", "t3x", None)], df.schema))
    dx = dx.unionByName(spark.createDataFrame([("t5", 99, None)], dx.schema))
    product = pairs.rectangular(df, dx, ["fold", "name"], "ticker", "day", "r")
    want = w.merge(x, on="ticker").assign(r=lambda f: f["a"] * f["b"]).groupby(["fold", "name", "day"])["r"].sum()
    got = product.toPandas().set_index(["fold", "name", "day"])["r"]
    assert len(got) == len(want) and np.allclose(got.loc[want.index], want, atol=1e-12)
    plan = product._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"_i#\d+ = _i#\d+", plan) and not re.search(r"ticker#\d+ = ticker#\d+", plan)  # sides meet block by block only
    assert pairs.rectangular(df.limit(0), dx, ["fold", "name"], "ticker", "day", "r").count() == 0


def test_pairs_are_not_shuffled(spark, wide_returns, monkeypatch):
    """Sums over several chunks of dates leave the tasks as finished pairs."""
    monkeypatch.setattr(pairs, "BLOCK", 6)
    monkeypatch.setattr(pairs, "CELLS", 900)
    gaps = wide_returns.mask(np.random.default_rng(2).random(wide_returns.shape) < 0.2)
    df = spark.createDataFrame(long(gaps), "date date, ticker string, r double")
    got = pairs.with_moments(pairs.blocked_pairs(df, pairs._sum_kernel, pairs.SUMS, chunk=50))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "asset_i" in plan and not re.search(r"(hashpartitioning|HashAggregate)\([^\n]*asset_i", plan)
    rows = got.toPandas().set_index(["asset_i", "asset_j"])["cov"]
    want = gaps.cov().stack()
    assert len(rows) == 18 * 19 // 2 and np.allclose(rows, want.loc[rows.index], atol=1e-12)


@pytest.mark.parametrize("points", sorted(pairs.PLANES))
def test_two_blocks_meet_on_one_line(points):
    line = pairs.PLANES[points]
    assert sorted((a - b) % points for a in line for b in line if a != b) == list(range(1, points))


@pytest.mark.parametrize("block, lines, copies", [(100, 57, 1), (8, 57, 2), (4, 57, 3), (1, 13, 4), (1, 57, 6)])
def test_blocks_are_copied_to_the_lines_through_them_only(spark, wide_returns, monkeypatch, block, lines, copies):
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(pairs, "LINES", lines)
    gaps = wide_returns.mask(np.random.default_rng(3).random(wide_returns.shape) < 0.2)
    df = spark.createDataFrame(long(gaps), "date date, ticker string, r double")
    rows = pairs.line_tasks(df, "r").collect()
    held = [p["block"] for r in rows for p in r.points]
    assert set(np.unique(held, return_counts=True)[1].tolist()) == {copies}
    got = pairs.with_moments(pairs.pair_sums(df)).toPandas().set_index(["asset_i", "asset_j"])["cov"]
    want = gaps.cov().stack()
    assert len(got) == 18 * 19 // 2 and got.index.is_unique and np.allclose(got, want.loc[got.index], atol=1e-12)
    above, mean = pairs.correlations_above(df, 0.1)
    corr = gaps.corr()
    assert {(r.asset_i, r.asset_j) for r in above.collect()} == {(i, j) for i in corr for j in corr if i < j and corr.loc[i, j] > 0.1}
    mean = mean.toPandas().set_index("asset")["m"]
    assert np.allclose(mean, corr.mean().loc[mean.index], atol=1e-9)
