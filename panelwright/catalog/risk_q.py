"""Risk measures, weight rules, candidate tables, distances, backtests and rebalancing."""

from pyspark.sql import functions as F

from panelwright.catalog.base import part, query, rd, sql
from panelwright.catalog import research_q  # noqa: F401  (its SQL parts are read here)
from panelwright.catalog.moments_q import probabilities
from panelwright.catalog.sources_q import day
from panelwright.config import DriftRule
from panelwright.functions.columns import rounded
from panelwright.functions.dist import attach_one
from panelwright.functions.pairs import asset_axis
from panelwright.operators import backtest as T, folds as O, moments as E, portfolios as W, rebalance as Q, risk as K
from panelwright.operators.risk import MEASURES, Z_GRID
from panelwright.session import cut

N_CANDIDATES = 1000


def asset_list(t):
    return t.weekly_returns.select(F.col("ticker").alias("asset")).distinct()


def numbered_assets(t):
    """(ticker, pos, n): the assets numbered from 0, and how many there are."""
    pos = asset_axis(t.weekly_returns)
    return attach_one(pos, pos.agg(F.count("*").alias("n")))


def candidate_weights(t, n=N_CANDIDATES):
    return W.candidates(asset_list(t), n)


part("apos", "SELECT ticker AS asset, row_number() OVER (ORDER BY ticker) - 1 AS pos FROM (SELECT DISTINCT ticker FROM bret)", "bret")
part("craw", f"""SELECT i AS portfolio, asset, pos, ((x * x) % 999983) % 1000 + 1 AS raw FROM (SELECT i, asset, pos, (i * 7919 + pos * 104729 + 15485863) % 1000003 AS x FROM apos, range(1, {N_CANDIDATES + 1}) g(i))""", "apos")
part("cw", "SELECT portfolio, asset, raw / sum(raw) OVER (PARTITION BY portfolio) AS w FROM craw", "craw")
part("pr", "SELECT portfolio, date, sum(w * r) AS r FROM cw JOIN bret ON ticker = asset GROUP BY 1, 2", "cw", "bret")


@query("k1_portfolio_returns", sql(f"SELECT portfolio, CAST(date AS VARCHAR) AS date, {rd('r')} AS r FROM pr", "pr"))
def k1(t):
    return rounded(K.portfolio_returns(t.weekly_returns, candidate_weights(t)).select("portfolio", day(), "r"))


def _ent(loss):
    return "least(" + ", ".join(f"ln(avg(exp({z} * {loss})) / 0.05) / {z}" for z in Z_GRID) + ")"


part("pw", """SELECT *, 1 - wealth / max(wealth) OVER (PARTITION BY portfolio ORDER BY date) AS dd FROM (SELECT *, avg(r) OVER (PARTITION BY portfolio) AS m, count(*) OVER (PARTITION BY portfolio) AS n,
  row_number() OVER (PARTITION BY portfolio ORDER BY r, date) AS rn, exp(sum(ln(1 + r)) OVER (PARTITION BY portfolio ORDER BY date)) AS wealth FROM pr)""", "pr")
part("pd", "SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY dd DESC, date) AS dn, greatest(1, floor(round(0.05 * n, 9))) AS worst, greatest(1, ceil(round(0.05 * n, 9))) AS at_ FROM pw", "pw")
part("rt", f"""SELECT *, sqrt(variance) AS standard_deviation, sqrt(semi_variance) AS semi_deviation, m3 / pow(variance, 1.5) AS skew, fourth_central_moment / (variance * variance) AS kurtosis FROM (
  SELECT portfolio, avg(r) AS mean, var_samp(r) AS variance, avg(least(r - m, 0) * least(r - m, 0)) AS semi_variance, avg(abs(r - m)) AS mean_absolute_deviation,
  avg(greatest(m - r, 0)) AS first_lower_partial_moment, 2 * sum((2 * rn - n - 1) * r) / max(n * (n - 1)) AS gini_mean_difference, avg(pow(r - m, 3)) AS m3, avg(pow(r - m, 4)) AS fourth_central_moment,
  avg(pow(least(r - m, 0), 4)) AS fourth_lower_partial_moment, max(-r) FILTER (rn = at_) AS value_at_risk, avg(-r) FILTER (rn <= worst) AS cvar, {_ent('(-r)')} AS entropic_value_at_risk,
  ln(avg(exp(-r)) / 0.05) AS entropic_risk, greatest(-min(r), 0) AS worst_realization, max(dd) AS max_drawdown, avg(dd) AS average_drawdown, avg(dd) FILTER (dn <= worst) AS cdar,
  max(dd) FILTER (dn = at_) AS drawdown_at_risk, {_ent('dd')} AS entropic_drawdown_at_risk, sqrt(avg(dd * dd)) AS ulcer_index FROM pd GROUP BY 1)""", "pd")
DISPERSION = ["variance", "standard_deviation", "semi_variance", "semi_deviation", "mean_absolute_deviation", "first_lower_partial_moment",
              "gini_mean_difference", "fourth_central_moment", "fourth_lower_partial_moment", "skew", "kurtosis"]
TAILS = ["value_at_risk", "cvar", "entropic_value_at_risk", "entropic_risk", "worst_realization"]
DRAWDOWNS = ["max_drawdown", "average_drawdown", "cdar", "drawdown_at_risk", "entropic_drawdown_at_risk", "ulcer_index"]


def risks(t):
    return K.risk_table(K.portfolio_returns(t.weekly_returns, candidate_weights(t)))


def _family(name, cols):
    @query(name, sql("SELECT portfolio, " + ", ".join(f"{rd(c)} AS {c}" for c in cols) + " FROM rt", "rt"))
    def run(t):
        return rounded(risks(t).select("portfolio", *cols))


_family("k2_dispersion", DISPERSION)
_family("k3_tails", TAILS)
_family("k4_drawdowns", DRAWDOWNS)
RATIOS = [m for m in MEASURES if m not in ("variance", "semi_variance")]


@query("k5_ratios", sql("SELECT portfolio, " + rd("mean") + " AS mean, " + ", ".join(f"{rd(f'(mean - 0.001) / {m}')} AS {m}_ratio" for m in RATIOS)
    + f", {rd('(mean - 0.001) / standard_deviation * sqrt(252)')} AS annualized_sharpe, {rd('(mean - 0.001) / semi_deviation * sqrt(252)')} AS annualized_sortino, {rd('mean / cdar')} AS score FROM rt", "rt"))
def k5(t):
    return rounded(K.ratio_table(risks(t), 0.001, extra=F.col("mean") / F.col("cdar")))


part("bench", "SELECT date, avg(r) AS b FROM bret GROUP BY 1", "bret")


def bench(t):
    return t.weekly_returns.groupBy("date").agg(F.avg("r").alias("b"))


@query("k6_information_ratio", sql(f"SELECT portfolio, {rd('avg(r - b) * 252 / (stddev_samp(r - b) * sqrt(252))')} AS information_ratio FROM pr JOIN bench USING (date) GROUP BY 1", "pr", "bench"))
def k6(t):
    return rounded(K.information_ratio(K.portfolio_returns(t.weekly_returns, candidate_weights(t)), bench(t)))


part("sth", "SELECT date, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS state FROM st", "st")
part("stw2", """SELECT portfolio, state, n, r, m, row_number() OVER (PARTITION BY portfolio, state ORDER BY r, date) AS rn FROM (SELECT portfolio, state, date, r, avg(r) OVER p AS m, count(*) OVER p AS n
  FROM pr JOIN sth USING (date) WINDOW p AS (PARTITION BY portfolio, state))""", "pr", "sth")


@query("k7_regime_blended_risk", sql(f"""SELECT portfolio, {rd('sum(p * risk)')} AS blended_risk FROM (SELECT portfolio, state, CASE state WHEN 0 THEN CASE WHEN count(*) FILTER (r < m) < 2 THEN 0 ELSE sqrt(sum(least(r - m, 0) * least(r - m, 0)) / count(*) FILTER (r < m)) END
  ELSE avg(-r) FILTER (rn <= greatest(1, floor(round(0.05 * n, 9)))) END AS risk FROM stw2 GROUP BY 1, 2) JOIN lastp USING (state) GROUP BY 1""", "stw2", "lastp"))
def k7(t):
    rows = K.portfolio_returns(t.weekly_returns, candidate_weights(t))
    return rounded(K.blended_risk(rows, probabilities(t), ["semi_deviation", "cvar"]))


@query("k8_regime_budget", sql(f"""SELECT asset, {rd('sum(p * b) / sum(sum(p * b)) OVER ()')} AS budget FROM (SELECT asset, 0 AS state, pos + 1 AS b FROM apos UNION ALL SELECT asset, 1, count(*) OVER () - pos FROM apos) JOIN lastp USING (state) GROUP BY 1""", "apos", "lastp"))
def k8(t):
    pos = numbered_assets(t)
    both = F.array(F.struct(F.lit(0).alias("state"), (F.col("pos") + 1).alias("b")), F.struct(F.lit(1).alias("state"), (F.col("n") - F.col("pos")).alias("b")))
    budgets = pos.select(F.col("ticker").alias("asset"), F.explode(both).alias("x")).select("asset", "x.state", "x.b")
    return rounded(K.regime_budget(budgets, probabilities(t)))


part("rc0", "SELECT portfolio, asset_i AS asset, sum(cov * w) AS cw, max(CASE WHEN asset_i = asset_j THEN cov END) AS v FROM bcov JOIN cw ON cw.asset = asset_j GROUP BY 1, 2", "bcov", "cw")
part("rc", "SELECT portfolio, asset, w, cw, v, sum(w * cw) OVER (PARTITION BY portfolio) AS pv, sum(w * sqrt(v)) OVER (PARTITION BY portfolio) AS ws, count(*) OVER (PARTITION BY portfolio) AS k FROM rc0 JOIN cw USING (portfolio, asset)", "rc0", "cw")


@query("k9_risk_contributions", sql(f"SELECT portfolio, asset, {rd('w * cw / sqrt(pv)')} AS contribution, {rd('w * cw / pv')} AS share, {rd('ws / sqrt(pv)')} AS diversification_ratio, {rd('w * cw / pv - 1.0 / k')} AS gap FROM rc", "rc"))
def k9(t):
    cov = E.covariance(t.weekly_returns)
    return rounded(K.risk_contributions(cov, candidate_weights(t)).select("portfolio", "asset", "contribution", "share", "diversification_ratio", "gap"))


@query("k10_equal_weight", sql(f"SELECT ticker AS asset, {rd('1.0 / count(*) OVER ()')} AS w FROM (SELECT DISTINCT ticker FROM px)", "px"))
def k10(t):
    return rounded(W.equal_weight(t.panel))


@query("k11_inverse_volatility", sql(f"SELECT asset, {rd('1 / s / sum(1 / s) OVER ()')} AS w FROM (SELECT ticker AS asset, stddev_samp(r) AS s FROM ret GROUP BY 1)", "ret"))
def k11(t):
    return rounded(W.inverse_volatility(t.returns))


def _objective(name, objective, expr):
    @query(name, sql(f"SELECT asset, {rd('w')} AS w, portfolio FROM cw WHERE portfolio = (SELECT portfolio FROM rt ORDER BY round({expr}, 12) DESC, portfolio LIMIT 1)", "cw", "rt"))
    def run(t):
        w = cut(candidate_weights(t))
        return rounded(W.best_candidate(W.score_candidates(t.weekly_returns, w, objective), w).select("asset", "w", "portfolio"))


_objective("k12_min_variance", W.Objective("min_risk", "variance"), "-variance")
_objective("k12_max_return", W.Objective("max_return"), "mean")
_objective("k12_max_utility_cvar", W.Objective("max_utility", "cvar", risk_aversion=0.5), "mean - 0.5 * cvar")
_objective("k12_max_ratio_ulcer", W.Objective("max_ratio", "ulcer_index", risk_free=0.001), "(mean - 0.001) / ulcer_index")
_objective("k12_min_drawdown_at_risk", W.Objective("min_risk", "cdar"), "-cdar")


@query("k12_constrained", sql(f"""SELECT portfolio, {rd('mean')} AS mean, {rd('variance')} AS risk, {rd('mean - 0.002 * moved - 0.001 - 0.5 * variance - 0.01 - 0.05 * n2')} AS score FROM rt
  JOIN (SELECT portfolio, sum(w * w) AS n2, sum(abs(w - 1.0 / n)) AS moved, sum(w * (2 * pos - n + 1) / (n - 1)) AS ex FROM cw JOIN (SELECT *, count(*) OVER () AS n FROM apos) USING (asset) GROUP BY 1) USING (portfolio)
  JOIN (SELECT portfolio, stddev_samp(r - b) AS te FROM pr JOIN bench USING (date) GROUP BY 1) USING (portfolio) WHERE te <= 0.14 AND ex BETWEEN -0.1 AND 0.1""", "rt", "cw", "apos", "pr", "bench"))
def k12_constrained(t):
    r = t.weekly_returns
    pos, n = numbered_assets(t), F.col("n")
    z = pos.select(F.lit("slope").alias("factor"), "ticker", ((2 * F.col("pos") - n + 1) / (n - 1)).alias("x"))
    prev = pos.select(F.col("ticker").alias("asset"), (1.0 / n).alias("w"))
    o = W.Objective("max_utility", "variance", risk_aversion=0.5, l1=0.01, l2=0.05, cost=0.002, fee=0.001)
    return rounded(W.score_candidates(r, cut(candidate_weights(t)), o, prev, z, {"slope": (-0.1, 0.1)}, bench(t), 0.14))


part("fb", "SELECT portfolio, mean, variance, CAST(least(9, floor((mean - lo) / ((hi - lo) / 10))) AS INTEGER) AS bucket FROM rt, (SELECT min(mean) AS lo, max(mean) AS hi FROM rt)", "rt")


@query("k12_frontier", sql(f"SELECT bucket, portfolio, {rd('mean')} AS mean, {rd('variance')} AS risk FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY round(variance, 12), portfolio) AS rn FROM fb) WHERE rn = 1", "fb"))
def k12_frontier(t):
    return rounded(W.frontier(W.score_candidates(t.weekly_returns, candidate_weights(t), W.Objective())))


@query("k13_benchmark_tracker", sql(f"""SELECT portfolio, asset, {rd('w')} AS w FROM cw WHERE portfolio = (SELECT portfolio FROM pr JOIN bench USING (date) GROUP BY 1 ORDER BY round(stddev_samp(r - b), 12), portfolio LIMIT 1)""", "cw", "pr", "bench"))
def k13(t):
    return rounded(W.best_tracker(t.weekly_returns, cut(candidate_weights(t)), bench(t)))


@query("k14_robust_scores", sql(f"""SELECT portfolio, {rd('wm - 1.645 * sqrt(wv / t)')} AS worst_mean, {rd('cvar + 0.01 / 0.05 * sqrt(nn)')} AS worst_cvar FROM (SELECT portfolio, sum(w * m) AS wm, sum(w * w * v) AS wv, sum(w * w) AS nn, any_value(t) AS t
  FROM cw JOIN (SELECT ticker AS asset, avg(r) AS m, var_samp(r) AS v FROM bret GROUP BY 1) USING (asset), (SELECT count(DISTINCT date) AS t FROM bret) GROUP BY 1) JOIN rt USING (portfolio)""", "cw", "bret", "rt"))
def k14(t):
    return rounded(W.robust_scores(t.weekly_returns, candidate_weights(t), epsilon=0.01))


part("bsk", """SELECT r.i AS rep, idx - 1 AS k, t, (r.i * 7919 + (idx - 1) * 104729 + 15485863) % 1000003 AS h1, (r.i * 6151 + (idx - 1) * 49157 + 15485863) % 1000003 AS h2
  FROM (SELECT DISTINCT idx FROM bidx), (SELECT max(idx) AS t FROM bidx), range(1, 501) r(i)""", "bidx")
part("bsi", """SELECT rep, (fr + k - at_) % t + 1 AS idx FROM (SELECT rep, k, t, last_value(CASE WHEN fresh THEN k END IGNORE NULLS) OVER w AS at_, last_value(CASE WHEN fresh THEN ((h2 * h2) % 999983) % t END IGNORE NULLS) OVER w AS fr
  FROM (SELECT *, k = 0 OR ((h1 * h1) % 999983) % 21 = 0 AS fresh FROM bsk) WINDOW w AS (PARTITION BY rep ORDER BY k))""", "bsk")
part("bscov", "SELECT rep, a.ticker AS asset_i, b.ticker AS asset_j, covar_samp(a.r, b.r) AS cov FROM bsi JOIN bidx a USING (idx) JOIN bidx b USING (idx) GROUP BY 1, 2, 3", "bsi", "bidx")
part("bsd", "SELECT rep, sqrt(sum((s.cov - c.cov) * (s.cov - c.cov))) AS distance FROM bscov s JOIN bcov c USING (asset_i, asset_j) GROUP BY 1", "bscov", "bcov")


@query("k15_bootstrap_distances", sql(f"SELECT rep AS replicate, {rd('distance')} AS distance FROM bsd", "bsd"), complete=True)
def k15d(t):
    return rounded(W.bootstrap_distances(t.weekly_returns))


@query("k15_bootstrap_radius", sql(f"SELECT {rd('quantile_cont(distance, 0.95)')} AS delta FROM bsd", "bsd"), complete=True)
def k15(t):
    return rounded(W.bootstrap_radius(t.weekly_returns))


part("brk", "SELECT date, ticker, rank() OVER (PARTITION BY ticker ORDER BY r) + (count(*) OVER (PARTITION BY ticker, r) - 1) / 2.0 AS k, r FROM bret", "bret")
part("bsp", "SELECT a.ticker AS asset_i, b.ticker AS asset_j, corr(a.k, b.k) AS c FROM brk a JOIN brk b USING (date) WHERE a.ticker <= b.ticker GROUP BY 1, 2", "brk")
part("sgp", "SELECT a.ticker, a.idx * 10000 + b.idx AS tu, sign(b.r - a.r) AS s FROM bidx a JOIN bidx b ON a.ticker = b.ticker AND a.idx < b.idx", "bidx")
part("bkt", "SELECT a.ticker AS asset_i, b.ticker AS asset_j, sum(a.s * b.s) / sqrt(sum(a.s * a.s) * sum(b.s * b.s)) AS c FROM sgp a JOIN sgp b USING (tu) WHERE a.ticker <= b.ticker GROUP BY 1, 2", "sgp")
part("dm0", "SELECT a.ticker, a.idx AS t, b.idx AS u, abs(a.r - b.r) AS d FROM bidx a JOIN bidx b ON a.ticker = b.ticker", "bidx")
part("dm", "SELECT ticker, t * 10000 + u AS tu, d - avg(d) OVER (PARTITION BY ticker, t) - avg(d) OVER (PARTITION BY ticker, u) + avg(d) OVER (PARTITION BY ticker) AS d FROM dm0", "dm0")
part("bdc", "SELECT a.ticker AS asset_i, b.ticker AS asset_j, sqrt(greatest(sum(a.d * b.d), 0) / sqrt(sum(a.d * a.d) * sum(b.d * b.d))) AS c FROM dm a JOIN dm b USING (tu) WHERE a.ticker <= b.ticker GROUP BY 1, 2", "dm")
part("mib", "SELECT date, ticker, least(9, floor((r - lo) / ((hi - lo) / 10))) AS b FROM bret JOIN (SELECT ticker, min(r) AS lo, max(r) AS hi FROM bret GROUP BY 1) USING (ticker)", "bret")
part("mij", "SELECT a.ticker AS asset_i, b.ticker AS asset_j, a.b AS bi, b.b AS bj, count(*) AS c FROM mib a JOIN mib b USING (date) WHERE a.ticker <= b.ticker GROUP BY 1, 2, 3, 4", "mib")
part("mi", """SELECT asset_i, asset_j, sum(p * ln(p / (pi * pj))) AS c, -sum(p * ln(p)) AS h FROM (SELECT *, c / sum(c) OVER w AS p, sum(c) OVER (PARTITION BY asset_i, asset_j, bi) / sum(c) OVER w AS pi,
  sum(c) OVER (PARTITION BY asset_i, asset_j, bj) / sum(c) OVER w AS pj FROM mij WINDOW w AS (PARTITION BY asset_i, asset_j)) GROUP BY 1, 2""", "mij")
HALF = "sqrt(greatest(0.5 * (1 - c), 0))"


def _distance(method, source, dist=HALF):
    needs = source.split()[-1]
    @query(f"k16_distance_{method}", sql(f"SELECT asset_i, asset_j, {rd('c')} AS codependence, {rd(dist)} AS distance FROM ({source})", needs), complete=method == "distance_correlation")
    def run(t):
        # Distances near 0 are roots of rounding noise, so six digits of the square would be needed there.
        return rounded(W.distance_table(t.weekly_returns, method).withColumn(
            "distance", F.when(F.col("asset_i") == F.col("asset_j"), 0.0).otherwise(F.col("distance"))))


ZERO = "CASE WHEN asset_i = asset_j THEN 0 ELSE {} END"
part("bpe", "SELECT asset_i, asset_j, corr AS c FROM bcov WHERE asset_i <= asset_j", "bcov")
part("bco", "SELECT asset_i, asset_j, cov AS c, corr FROM bcov WHERE asset_i <= asset_j", "bcov")
_distance("pearson", "FROM bpe", ZERO.format(HALF))
_distance("spearman", "FROM bsp", ZERO.format(HALF))
_distance("kendall", "FROM bkt", ZERO.format(HALF))
_distance("covariance", "FROM bco", ZERO.format("sqrt(greatest(0.5 * (1 - corr), 0))"))
_distance("distance_correlation", "FROM bdc", ZERO.format("sqrt(greatest(1 - c, 0))"))
_distance("mutual_information", "FROM mi", ZERO.format("greatest((h - c) / h, 0)"))


def clusters(t):
    return t.weekly_returns.select("ticker").distinct().select("ticker", F.substring("ticker", 1, 7).alias("cluster"))


part("innr", "SELECT substr(ticker, 1, 7) AS cluster, ticker AS asset, 1 / s / sum(1 / s) OVER (PARTITION BY substr(ticker, 1, 7)) AS w FROM (SELECT ticker, stddev_samp(r) AS s FROM bret GROUP BY 1)", "bret")
part("outr", "SELECT cluster, 1 / s / sum(1 / s) OVER () AS v FROM (SELECT cluster, stddev_samp(r) AS s FROM (SELECT cluster, date, sum(w * r) AS r FROM innr JOIN bret ON ticker = asset GROUP BY 1, 2) GROUP BY 1)", "innr", "bret")


@query("k17_nested_weights", sql(f"SELECT asset, {rd('w * v')} AS w FROM innr JOIN outr USING (cluster)", "innr", "outr"))
def k17(t):
    return rounded(W.nested_weights(t.weekly_returns, clusters(t)))


part("stk", "SELECT portfolio, 1 / s / sum(1 / s) OVER () AS v FROM (SELECT portfolio, stddev_samp(r) AS s FROM pr GROUP BY 1)", "pr")


@query("k17_stacked_weights", sql(f"SELECT asset, {rd('sum(w * v)')} AS w FROM cw JOIN stk USING (portfolio) GROUP BY 1", "cw", "stk"))
def k17s(t):
    return rounded(W.stacked_weights(t.weekly_returns, candidate_weights(t)))


# Backtests

part("wf", """SELECT fold, 'train' AS role, idx, date FROM (SELECT DISTINCT idx, date FROM bidx), range(0, 20) g(fold) WHERE fold < (SELECT max(idx) - 106 FROM bidx) // 26 AND idx BETWEEN fold * 26 + 1 AND fold * 26 + 104
  UNION ALL SELECT fold, 'test', idx, date FROM (SELECT DISTINCT idx, date FROM bidx), range(0, 20) g(fold) WHERE fold < (SELECT max(idx) - 106 FROM bidx) // 26 AND idx BETWEEN fold * 26 + 107 AND fold * 26 + 132""", "bidx")


def walks(t):
    return O.walk_forward(t.weekly_returns, 26, 104, 2)


@query("t1_walk_forward", sql("SELECT fold, role, idx, CAST(date AS VARCHAR) AS date FROM wf", "wf"))
def t1(t):
    return walks(t).select("fold", "role", "idx", day())


@query("t1_walk_forward_expanding", sql("""SELECT role, count(*) AS n, count(DISTINCT fold) AS folds, sum(idx) AS idx_sum FROM (
  SELECT fold, 'train' AS role, idx FROM (SELECT DISTINCT idx FROM bidx), range(0, 20) g(fold) WHERE fold < ceil((SELECT max(idx) - 104 FROM bidx) / 26) AND idx BETWEEN 1 AND fold * 26 + 104
  UNION ALL SELECT fold, 'test', idx FROM (SELECT DISTINCT idx FROM bidx), range(0, 20) g(fold) WHERE fold < ceil((SELECT max(idx) - 104 FROM bidx) / 26) AND idx BETWEEN fold * 26 + 105 AND fold * 26 + 130) GROUP BY 1""", "bidx"))
def t1x(t):
    f = O.walk_forward(t.weekly_returns, 26, 104, expanding=True, short_last=True)
    return f.groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("fold").alias("folds"), F.sum("idx").alias("idx_sum"))


def cpcv(t):
    return O.combinatorial_folds(t.panel, 6, 2, 2, 4)


@query("t2_test_paths", sql("SELECT row_number() OVER (PARTITION BY block ORDER BY fold) - 1 AS path, block, fold FROM (SELECT DISTINCT block, fold FROM cp WHERE role = 'test')", "cp"))
def t2(t):
    return O.test_paths(cpcv(t))


part("mcw", "SELECT fold, ticker, 1 / s / sum(1 / s) OVER (PARTITION BY fold) AS w FROM (SELECT fold, ticker, stddev_samp(r) AS s FROM ret JOIN cp USING (date) WHERE role = 'train' AND r IS NOT NULL GROUP BY 1, 2)", "ret", "cp")
part("mcr", "SELECT fold, block, date, sum(w * r) AS r FROM ret JOIN cp USING (date) JOIN mcw USING (fold, ticker) WHERE role = 'test' AND r IS NOT NULL GROUP BY 1, 2, 3", "ret", "cp", "mcw")


@query("t2_path_returns", sql(f"""SELECT path, CAST(date AS VARCHAR) AS date, {rd('r')} AS r FROM mcr JOIN (SELECT row_number() OVER (PARTITION BY block ORDER BY fold) - 1 AS path, block, fold FROM
  (SELECT DISTINCT block, fold FROM cp WHERE role = 'test')) USING (block, fold)""", "mcr", "cp"))
def t2r(t):
    f = cut(cpcv(t))
    r = T.cross_val_predict(t.returns, f)
    return rounded(T.path_returns(r, f, O.test_paths(f)).select("path", day(), "r"))


part("sub", """SELECT i AS draw, ticker FROM (SELECT i, ticker, row_number() OVER (PARTITION BY i ORDER BY substr(md5(ticker || '|' || CAST(i AS VARCHAR) || '|7'), 1, 12), ticker) AS rn
  FROM (SELECT DISTINCT ticker FROM bret), range(0, 5) g(i)) WHERE rn <= 8""", "bret")
part("starts", "SELECT i AS draw, CAST(('0x' || substr(md5('window|' || CAST(i AS VARCHAR) || '|7'), 1, 12)) AS BIGINT) % greatest(t - 200 + 1, 1) AS start, t FROM (SELECT max(idx) AS t FROM bidx), range(0, 5) g(i)", "bidx")
part("rsf", """SELECT draw, fold, role, idx FROM (SELECT draw, start, fold, unnest(['train', 'test']) AS role FROM starts, range(0, 20) g(fold) WHERE fold < (least(200, t) - 104) // 26)
  JOIN (SELECT DISTINCT idx FROM bidx) ON (role = 'train' AND idx BETWEEN start + fold * 26 + 1 AND start + fold * 26 + 104) OR (role = 'test' AND idx BETWEEN start + fold * 26 + 105 AND start + fold * 26 + 130)""", "starts", "bidx")


def random_folds(t):
    return O.random_subset_folds(t.weekly_returns, 5, 8, 200, 26, 104)


@query("t3_random_subsets", sql("SELECT draw, ticker, fold, role, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM rsf JOIN sub USING (draw) GROUP BY 1, 2, 3, 4", "rsf", "sub"))
def t3(t):
    return random_folds(t).groupBy("draw", "ticker", "fold", "role").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query("t4_fold_count_search", sql(f"""SELECT n AS n_blocks, k AS n_test, paths AS n_paths, {rd('t / n * (n - k)')} AS train_size, {rd('cost')} AS cost, row_number() OVER (ORDER BY round(cost, 9), n, k) = 1 AS best FROM (
  SELECT n, k, t, paths, abs(t / n * (n - k) - 60) / 60 + abs(paths - 8) / 8 AS cost FROM (SELECT n, k, (SELECT max(idx) FROM ax) AS t,
    CAST(round(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1))) AS BIGINT) * k // n AS paths FROM range(3, 21) a(n), range(2, 20) b(k) WHERE k < n))""", "ax"))
def t4(t):
    return rounded(O.fold_count_search(t.panel, 60, 8))


part("wfw", "SELECT fold, ticker, 1 / s / sum(1 / s) OVER (PARTITION BY fold) AS w FROM (SELECT fold, ticker, stddev_samp(r) AS s FROM bret JOIN wf USING (date) WHERE role = 'train' GROUP BY 1, 2)", "bret", "wf")
part("wfr", "SELECT fold, date, sum(w * r) AS r FROM bret JOIN wf USING (date) JOIN wfw USING (fold, ticker) WHERE role = 'test' GROUP BY 1, 2", "bret", "wf", "wfw")


@query("t5_cross_val_predict", sql(f"SELECT fold, CAST(date AS VARCHAR) AS date, {rd('r')} AS r FROM wfr", "wfr"))
def t5(t):
    return rounded(T.cross_val_predict(t.weekly_returns, walks(t)).select("fold", day(), "r"))


@query("t5_random_subset_predict", sql(f"""SELECT draw, fold, date, {rd('r')} AS r FROM (SELECT draw, fold, CAST(date AS VARCHAR) AS date, sum(w * r) AS r FROM rsf JOIN bidx USING (idx) JOIN
  (SELECT draw, fold, ticker, 1 / s / sum(1 / s) OVER (PARTITION BY draw, fold) AS w FROM (SELECT draw, fold, ticker, stddev_samp(r) AS s FROM rsf JOIN bidx USING (idx) JOIN sub USING (draw, ticker) WHERE role = 'train' GROUP BY 1, 2, 3))
  USING (draw, fold, ticker) WHERE role = 'test' GROUP BY 1, 2, 3)""", "rsf", "bidx", "sub"))
def t5r(t):
    return rounded(T.cross_val_predict(t.weekly_returns, random_folds(t), keys=("draw", "fold")).select("draw", "fold", day(), "r"))


part("gridp", "SELECT k.i * 3 + p.i AS param, [5, 10, 25][CAST(k.i + 1 AS INTEGER)] AS top_k, [0.0, 1.0, 2.0][CAST(p.i + 1 AS INTEGER)] AS power FROM range(0, 3) k(i), range(0, 3) p(i)")
part("gfit", """SELECT param, fold, ticker, pow(1 / s, power) / sum(pow(1 / s, power)) OVER (PARTITION BY param, fold) AS w FROM (SELECT param, fold, top_k, power, ticker, s, row_number() OVER (PARTITION BY param, fold ORDER BY round(m, 12) DESC, ticker) AS rn
  FROM gridp, (SELECT fold, ticker, avg(r) AS m, stddev_samp(r) AS s FROM bret JOIN wf USING (date) WHERE role = 'train' GROUP BY 1, 2)) WHERE rn <= top_k""", "gridp", "bret", "wf")
part("gsc", """SELECT param, avg(m / s) AS score FROM (SELECT param, fold, avg(r) AS m, stddev_samp(r) AS s FROM (SELECT param, fold, date, sum(w * r) AS r FROM bret JOIN wf USING (date) JOIN gfit USING (fold, ticker) WHERE role = 'test' GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""", "bret", "wf", "gfit")


@query("t6_grid_search", sql(f"SELECT param, CAST(top_k AS INTEGER) AS top_k, CAST(power AS DOUBLE) AS power, {rd('score')} AS score, row_number() OVER (ORDER BY round(score, 12) DESC, param) = 1 AS best FROM gsc JOIN gridp USING (param)", "gsc", "gridp"))
def t6(t):
    return rounded(T.search(t.weekly_returns, walks(t), T.grid(t.spark, [5, 10, 25], [0.0, 1.0, 2.0])))


part("gsamp", "SELECT param FROM gridp ORDER BY (((param * 7919 + 104729) % 1009) * ((param * 7919 + 104729) % 1009)) % 997, param LIMIT 4", "gridp")


@query("t6_randomized_search", sql(f"SELECT param, CAST(top_k AS INTEGER) AS top_k, CAST(power AS DOUBLE) AS power, {rd('score')} AS score, row_number() OVER (ORDER BY round(score, 12) DESC, param) = 1 AS best FROM gsc JOIN gridp USING (param) WHERE param IN (SELECT param FROM gsamp)", "gsc", "gridp", "gsamp"))
def t6r(t):
    params = T.sampled(T.grid(t.spark, [5, 10, 25], [0.0, 1.0, 2.0]), 4)
    return rounded(T.search(t.weekly_returns, walks(t), params))


part("wchg", "SELECT f.date, a.ticker, coalesce(a.w, 0) - coalesce(b.w, 0) AS dw FROM wfw a LEFT JOIN wfw b ON a.ticker = b.ticker AND a.fold = b.fold + 1 JOIN (SELECT fold, min(date) AS date FROM wfr GROUP BY 1) f ON f.fold = a.fold", "wfw", "wfr")


def walk_changes(t, folds):
    """Weight changes at the first test date of each fold."""
    from pyspark.sql import Window

    r = t.weekly_returns.join(folds.where("role = 'train'").select("fold", "date"), "date")
    w = W.inverse_volatility(r, ["fold"])
    prev = F.coalesce(F.lag("w").over(Window.partitionBy("asset").orderBy("fold")), F.lit(0.0))
    first = folds.where("role = 'test'").groupBy("fold").agg(F.min("date").alias("date"))
    return w.withColumn("dw", F.col("w") - prev).join(first, "fold").select("date", "asset", "dw")


@query("t7_net_returns", sql(f"SELECT CAST(date AS VARCHAR) AS date, {rd('r - coalesce(c, 0)')} AS r FROM wfr LEFT JOIN (SELECT date, sum(abs(dw)) * 25 / 10000 AS c FROM wchg GROUP BY 1) USING (date)", "wfr", "wchg"))
def t7(t):
    f = cut(walks(t))
    gross = T.cross_val_predict(t.weekly_returns, f).select("date", "r")
    return rounded(T.net_returns(gross, walk_changes(t, f), 25).select(day(), "r"))


@query("t8_summary", sql(f"""SELECT portfolio, {rd('mean')} AS mean, {rd('mean * 252')} AS annualized_mean, {rd('variance')} AS variance, {rd('standard_deviation')} AS standard_deviation, {rd('mean / standard_deviation')} AS sharpe_ratio,
  {rd('mean / semi_deviation')} AS sortino_ratio, {rd('max_drawdown')} AS max_drawdown, {rd('cvar')} AS cvar FROM rt""", "rt"))
def t8(t):
    return rounded(K.summary(K.portfolio_returns(t.weekly_returns, candidate_weights(t))))


# Rebalancing: every candidate drifts through the last week; the next candidate is its target.


def last_week(t):
    last = t.weekly_returns.agg(F.max("date").alias("last"))
    from panelwright.functions.dist import attach_one

    return attach_one(t.weekly_returns, last).where("date = last").select(F.col("ticker").alias("asset"), "r")


def drifted(t):
    return Q.drifted(candidate_weights(t), last_week(t))


def targets(t):
    """Candidate p + 1 is the target of portfolio p; every ninth asset is missing from it."""
    w = candidate_weights(t).withColumn("portfolio", F.col("portfolio") - 1)
    return w.where((F.substring("asset", 7, 9).cast("long") + F.col("portfolio")) % 9 != 0).where("portfolio >= 1")


part("lastr", "SELECT ticker AS asset, r FROM bret WHERE date = (SELECT max(date) FROM bret)", "bret")
part("dw", "SELECT portfolio, asset, w * (1 + r) / sum(w * (1 + r)) OVER (PARTITION BY portfolio) AS w FROM cw JOIN lastr USING (asset)", "cw", "lastr")
part("tg", "SELECT portfolio - 1 AS portfolio, asset, w FROM cw WHERE portfolio >= 2 AND (CAST(substr(asset, 7) AS BIGINT) + portfolio - 1) % 9 <> 0", "cw")
part("al", "SELECT coalesce(a.portfolio, b.portfolio) AS portfolio, coalesce(a.asset, b.asset) AS asset, coalesce(a.w, 0) AS c, coalesce(b.w, 0) AS t FROM dw a FULL JOIN tg b ON a.portfolio = b.portfolio AND a.asset = b.asset", "dw", "tg")


@query("q1_drifted_weights", sql(f"SELECT portfolio, asset, {rd('w')} AS w FROM dw", "dw"))
def q1(t):
    return rounded(drifted(t))


@query("q2_turnover", sql(f"SELECT portfolio, {rd('sum(abs(c - t)) / 2')} AS turnover FROM al GROUP BY 1", "al"))
def q2(t):
    return rounded(Q.turnover(drifted(t), targets(t)))


@query("q3_rebalancing_cost", sql(f"SELECT portfolio, {rd('sum((pos + 1) / 1000.0 * abs(c - t))')} AS cost FROM al JOIN apos USING (asset) GROUP BY 1", "al", "apos"))
def q3(t):
    from panelwright.functions.pairs import asset_axis

    rates = asset_axis(t.weekly_returns).select(F.col("ticker").alias("asset"), ((F.col("pos") + 1) / 1000.0).alias("rate"))
    return rounded(Q.rebalancing_cost(drifted(t), targets(t), rates))


@query("q4_threshold_rule", sql("SELECT portfolio, bool_or(abs(c - t) > 0.06) AS fires FROM al GROUP BY 1", "al"))
def q4(t):
    return Q.threshold_rule(drifted(t), targets(t), DriftRule(0.06))


@query("q4_relative_threshold_rule", sql("SELECT portfolio, bool_or(t > 0 AND abs(c - t) / t > 60) AS fires FROM al GROUP BY 1", "al"))
def q4r(t):
    return Q.threshold_rule(drifted(t), targets(t), DriftRule(60.0, relative=True))


def reviews(t):
    p = candidate_weights(t).select("portfolio").distinct()
    today = F.lit("2001-11-05").cast("date")
    return p.select("portfolio", F.date_sub(today, (F.col("portfolio") % 60).cast("int")).alias("last_review"), today.alias("today"))


part("hyb", """SELECT portfolio, (SELECT count(*) FROM range(0, CAST(portfolio % 60 AS BIGINT)) d(i) WHERE isodow(DATE '2001-11-05' - CAST(portfolio % 60 AS INTEGER) + CAST(i AS INTEGER)) <= 5) AS elapsed FROM (SELECT DISTINCT portfolio FROM cw)""", "cw")


@query("q5_hybrid_rule", sql("SELECT portfolio, elapsed, elapsed >= 21 AS due, elapsed >= 21 AND fires AS fires FROM hyb JOIN (SELECT portfolio, bool_or(abs(c - t) > 0.06) AS fires FROM al GROUP BY 1) USING (portfolio)", "hyb", "al"))
def q5(t):
    return Q.hybrid_rule(drifted(t), targets(t), reviews(t), DriftRule(0.06, period_days=21))


part("cal", """SELECT portfolio, (SELECT count(*) FROM range(0, CAST(portfolio * 7 % 400 AS BIGINT)) d(i) WHERE isodow(today - CAST(portfolio * 7 % 400 AS INTEGER) + CAST(i AS INTEGER)) <= 5) AS elapsed
  FROM (SELECT DISTINCT portfolio FROM cw), (SELECT CAST(max(date) AS DATE) AS today FROM bret)""", "cw", "bret")


@query("q5_calendar_rule", sql("""SELECT portfolio, frequency, elapsed, elapsed >= days AS due FROM cal, (VALUES ('monthly', 21), ('quarterly', 63), ('semiannual', 126), ('annual', 252)) f(frequency, days)""", "cal"))
def q5c(t):
    today = t.weekly_returns.agg(F.max("date").cast("date").alias("today"))
    p = attach_one(candidate_weights(t).select("portfolio").distinct(), today)
    return Q.calendar_rule(p.select("portfolio", F.date_sub("today", (F.col("portfolio") * 7 % 400).cast("int")).alias("last_review"), "today"))


part("prev", "SELECT tg.portfolio, tg.asset, tg.w AS t, coalesce(dw.w, 0) / sum(coalesce(dw.w, 0)) OVER (PARTITION BY tg.portfolio) AS c FROM tg LEFT JOIN dw ON dw.portfolio = tg.portfolio AND dw.asset = tg.asset", "tg", "dw")


@query("q6_rebalance_decision", sql(f"SELECT portfolio, {rd('sum(abs(c - t)) / 2')} AS turnover, elapsed >= 21 AND bool_or(abs(c - t) > 0.06) AS rebalance FROM prev JOIN hyb USING (portfolio) GROUP BY portfolio, elapsed", "prev", "hyb"))
def q6(t):
    return rounded(Q.decide(drifted(t), targets(t), DriftRule(0.06, period_days=21), reviews(t)))
