"""Means, covariances, regimes and horizon scaling on the weekly brand panel."""

from pyspark.sql import functions as F

from panelwright.catalog.base import part, query, rd, recursive, sql
from panelwright.catalog.sources_q import day
from panelwright.functions.columns import rounded
from panelwright.operators import moments as E
from panelwright.session import cut

MU = f"SELECT asset, {rd('mu')} AS mu FROM "
COV = f"SELECT asset_i, asset_j, {rd('cov')} AS cov FROM "

part("bn", "SELECT count(DISTINCT ticker) AS n, count(DISTINCT date) AS t FROM bret", "bret")
part("bidx", "SELECT ticker, date, r, dense_rank() OVER (ORDER BY date) AS idx FROM bret", "bret")
part("bmu", "SELECT ticker AS asset, avg(r) AS mu FROM bret GROUP BY 1", "bret")
part("bp", "SELECT a.ticker AS asset_i, b.ticker AS asset_j, a.r AS x, b.r AS y, a.date FROM bret a JOIN bret b USING (date)", "bret")
part("bcov", "SELECT asset_i, asset_j, covar_samp(x, y) AS cov, corr(x, y) AS corr FROM bp GROUP BY 1, 2", "bp")
part("bc", "SELECT date, ticker, r - avg(r) OVER (PARTITION BY ticker) AS x FROM bret", "bret")
part("bs", "SELECT a.ticker AS asset_i, b.ticker AS asset_j, avg(a.x * b.x) AS s, avg(a.x * b.x * a.x * b.x) AS p2, avg(a.x * a.x * a.x * b.x) AS p31, avg(a.x * b.x * b.x * b.x) AS p13 FROM bc a JOIN bc b USING (date) GROUP BY 1, 2", "bc")


def out(df):
    return rounded(df.select("asset_i", "asset_j", "cov"))


@query("e1_mean", sql(MU + "bmu", "bmu"))
def e1(t):
    return rounded(E.mean(t.weekly_returns))


def _shrunk(method):
    @query(f"e2_shrunk_mean_{method}", complete=method == "bodnar_okhrin")
    def run(t):
        return rounded(E.shrunk_mean(t.weekly_returns, method))


for _m in ("james_stein", "bayes_stein", "bodnar_okhrin"):
    _shrunk(_m)

part("ewm", "SELECT ticker AS asset, sum(pow(0.8, t - idx) * r) / sum(pow(0.8, t - idx)) AS mu FROM bidx, bn GROUP BY 1", "bidx", "bn")


@query("e3_ew_mean", sql(MU + "ewm", "ewm"))
def e3(t):
    return rounded(E.ew_mean(t.weekly_returns))


@query("e4_equilibrium_mean", sql(f"SELECT asset_i AS asset, {rd('2.5 * sum(cov / n)')} AS mu FROM bcov, bn GROUP BY 1", "bcov", "bn"))
def e4(t):
    return rounded(E.equilibrium_mean(E.covariance(t.weekly_returns), risk_aversion=2.5))


part("lwk", """SELECT m, CASE WHEN gap > 0 THEN least(noise, gap) / gap ELSE 0 END AS k FROM (SELECT tr / n AS m, (pp - ss) / (n * t) AS noise, (ss - 2 * (tr / n) * tr + n * (tr / n) * (tr / n)) / n AS gap
  FROM (SELECT sum(s) FILTER (asset_i = asset_j) AS tr, sum(s * s) AS ss, sum(p2) AS pp FROM bs), bn)""", "bs", "bn")
part("lw", "SELECT asset_i, asset_j, (1 - k) * s + CASE WHEN asset_i = asset_j THEN k * m ELSE 0 END AS cov FROM bs, lwk", "bs", "lwk")


@query("e5_prior_mean", sql(f"SELECT asset, {rd('exp((mu + 0.5 * cov) * 4) - 1')} AS mu FROM bmu JOIN lw ON asset_i = asset AND asset_j = asset", "bmu", "lw"), complete=True)
def e5(t):
    return rounded(E.prior(t.weekly_returns, "empirical", "ledoit_wolf", 4)[0])


@query("e5_prior_covariance", sql(f"""SELECT asset_i, asset_j, {rd('exp((a.mu + b.mu + 0.5 * (c.cov + d.cov)) * 4) * (exp(lw.cov * 4) - 1)')} AS cov FROM lw JOIN bmu a ON a.asset = asset_i JOIN bmu b ON b.asset = asset_j
  JOIN (SELECT asset_i AS asset, cov FROM lw WHERE asset_i = asset_j) c ON c.asset = asset_i JOIN (SELECT asset_i AS asset, cov FROM lw WHERE asset_i = asset_j) d ON d.asset = asset_j""", "lw", "bmu"), complete=True)
def e5c(t):
    return out(E.prior(t.weekly_returns, "empirical", "ledoit_wolf", 4)[1])


@query("e6_covariance", sql(f"SELECT asset_i, asset_j, {rd('cov')} AS cov, {rd('corr')} AS corr FROM bcov", "bcov"))
def e6(t):
    return rounded(E.covariance(t.weekly_returns).select("asset_i", "asset_j", "cov", "corr"))


@query("e6_supplier_covariance", sql(f"""SELECT a.ticker AS asset_i, b.ticker AS asset_j, count(*) AS n, {rd('covar_samp(a.r, b.r)')} AS cov FROM ret a JOIN ret b USING (date) WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2""", "ret"))
def e6s(t):
    return rounded(E.covariance(t.returns).select("asset_i", "asset_j", "n", "cov"))


@query("e7_ledoit_wolf", sql(COV + "lw", "lw"), complete=True)
def e7(t):
    return out(E.ledoit_wolf(t.weekly_returns))


part("lwc", """SELECT asset_i, asset_j, k * f + (1 - k) * s AS cov FROM (SELECT *, greatest(0, least(1, (sum(p2 - s * s) OVER () - sum(CASE WHEN asset_i = asset_j THEN p2 - s * s
    ELSE rho / 2 * (sqrt(vj / vi) * (p31 - vi * s) + sqrt(vi / vj) * (p13 - vj * s)) END) OVER ()) / sum((f - s) * (f - s)) OVER () / t)) AS k FROM (
  SELECT *, CASE WHEN asset_i = asset_j THEN s ELSE rho * sqrt(vi * vj) END AS f FROM (SELECT bs.*, vi, vj, t, avg(s / sqrt(vi * vj)) FILTER (asset_i <> asset_j) OVER () AS rho FROM bs
    JOIN (SELECT asset_i, s AS vi FROM bs WHERE asset_i = asset_j) USING (asset_i) JOIN (SELECT asset_j, s AS vj FROM bs WHERE asset_i = asset_j) USING (asset_j), bn)))""", "bs", "bn")


@query("e7_constant_correlation", sql(COV + "lwc", "lwc"), complete=True)
def e7c(t):
    return out(E.ledoit_wolf_constant_correlation(t.weekly_returns))


part("oas", """SELECT asset_i, asset_j, (1 - k) * s + CASE WHEN asset_i = asset_j THEN k * m ELSE 0 END AS cov FROM bs, (SELECT m, least((a + m * m) / ((t + 1) * (a - m * m / n)), 1) AS k FROM
  (SELECT sum(s) FILTER (asset_i = asset_j) / any_value(n) AS m, sum(s * s) / (any_value(n) * any_value(n)) AS a, any_value(n) AS n, any_value(t) AS t FROM bs, bn))""", "bs", "bn")


@query("e8_oracle_approximating", sql(COV + "oas", "oas"), complete=True)
def e8(t):
    return out(E.oracle_approximating(t.weekly_returns))


@query("e9_constant_shrinkage", sql(f"""SELECT asset_i, asset_j, {rd('0.9 * s + CASE WHEN asset_i = asset_j THEN 0.1 * m ELSE 0 END')} AS cov FROM bs, (SELECT sum(s) FILTER (asset_i = asset_j) / any_value(n) AS m FROM bs, bn)""", "bs", "bn"), complete=True)
def e9(t):
    return out(E.constant_shrinkage(t.weekly_returns))


@query("e10_ew_covariance", sql(f"""SELECT a.ticker AS asset_i, b.ticker AS asset_j, {rd('sum(pow(0.8, t - a.idx) * a.r * b.r) / sum(pow(0.8, t - a.idx))')} AS cov FROM bidx a JOIN bidx b USING (date), bn GROUP BY 1, 2""", "bidx", "bn"), complete=True)
def e10(t):
    return out(E.ew_covariance(t.weekly_returns))


part("sgn", "SELECT date, ticker, sd, CASE WHEN abs(r) > 0.5 * sd THEN sign(r) ELSE 0 END AS g FROM (SELECT *, stddev_samp(r) OVER (PARTITION BY ticker) AS sd FROM bret)", "bret")


@query("e11_gerber", sql(f"SELECT a.ticker AS asset_i, b.ticker AS asset_j, {rd('coalesce(sum(a.g * b.g) / nullif(sum(abs(a.g * b.g)), 0), 0) * any_value(a.sd) * any_value(b.sd)')} AS cov FROM sgn a JOIN sgn b USING (date) GROUP BY 1, 2", "sgn"))
def e11(t):
    return out(E.gerber(t.weekly_returns))


@query("e12_denoised", complete=True)
def e12(t):
    return out(E.denoised(t.weekly_returns))


@query("e13_detoned", complete=True)
def e13(t):
    return out(E.detoned(t.weekly_returns))


part("iv", "SELECT ticker AS asset, avg(abs(r)) * 1.25 AS iv FROM bret GROUP BY 1", "bret")


@query("e14_implied", sql(f"""SELECT asset_i, asset_j, {rd('corr * a.iv * b.iv')} AS cov FROM bcov JOIN iv a ON a.asset = asset_i JOIN iv b ON b.asset = asset_j""", "bcov", "iv"))
def e14(t):
    iv = t.weekly_returns.groupBy(F.col("ticker").alias("asset")).agg((F.avg(F.abs("r")) * 1.25).alias("iv"))
    return out(E.implied(t.weekly_returns, iv))


def factor_columns(t):
    """Weekly market return and the spread of the first over the last brands."""
    r = t.weekly_returns
    lead = F.avg(F.when(F.col("ticker") < "Brand#2", F.col("r"))) - F.avg(F.when(F.col("ticker") >= "Brand#2", F.col("r")))
    return cut(r.groupBy("date").agg(F.avg("r").alias("f1"), F.coalesce(lead, F.lit(0.0)).alias("f2")))


part("ff", "SELECT date, avg(r) AS f1, coalesce(avg(r) FILTER (ticker < 'Brand#2') - avg(r) FILTER (ticker >= 'Brand#2'), 0) AS f2 FROM bret GROUP BY 1", "bret")
part("fl0", """SELECT ticker, count(*) AS n, avg(r) AS mr, avg(f1) AS m1, avg(f2) AS m2, covar_samp(r, f1) AS c1, covar_samp(r, f2) AS c2, var_samp(f1) AS v1, var_samp(f2) AS v2, covar_samp(f1, f2) AS c12, var_samp(r) AS vr
  FROM bret JOIN ff USING (date) GROUP BY 1""", "bret", "ff")
part("fl", """SELECT *, (vr - b1 * c1 - b2 * c2) * (n - 1) / (n - 3) AS rv FROM (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM fl0)""", "fl0")


@query("e15_factor_model", sql(f"""SELECT a.ticker AS asset_i, b.ticker AS asset_j, {rd('a.b1 * b.b1 * a.v1 + a.b2 * b.b2 * a.v2 + (a.b1 * b.b2 + a.b2 * b.b1) * a.c12 + CASE WHEN a.ticker = b.ticker THEN a.rv ELSE 0 END')} AS cov
  FROM fl a JOIN fl b ON true""", "fl"), complete=True)
def e15(t):
    return out(E.factor_model(t.weekly_returns, factor_columns(t), ["f1", "f2"])[1])


part("lmu", "SELECT ticker AS asset, avg(ln(1 + r)) AS mu, var_samp(ln(1 + r)) AS v FROM bret GROUP BY 1", "bret")
part("lcov", "SELECT asset_i, asset_j, covar_samp(ln(1 + x), ln(1 + y)) AS cov FROM bp GROUP BY 1, 2", "bp")


def log_moments(t):
    r = t.weekly_returns.withColumn("r", F.ln(1 + F.col("r")))
    return E.mean(r), cut(E.covariance(r))


@query("e16_horizon", sql(f"""SELECT asset_i, asset_j, {rd('exp((a.mu + b.mu + 0.5 * (a.v + b.v)) * 4) * (exp(cov * 4) - 1)')} AS cov FROM lcov JOIN lmu a ON a.asset = asset_i JOIN lmu b ON b.asset = asset_j""", "lcov", "lmu"))
def e16(t):
    return out(E.to_horizon(*log_moments(t), 4)[1])


@query("e16_horizon_mean", sql(f"SELECT asset, {rd('exp((mu + 0.5 * v) * 4) - 1')} AS mu FROM lmu", "lmu"))
def e16m(t):
    return rounded(E.to_horizon(*log_moments(t), 4, "linear")[0])


# Regimes: state 1 where the market fell; its probability is the share of falling weeks among the last four.


def states(t):
    from pyspark.sql import Window

    m = t.weekly_returns.groupBy("date").agg(F.avg("r").alias("m"))
    w = Window.orderBy("date").rowsBetween(-3, 0)
    p1 = m.select("date", (F.col("m") < 0).cast("int").alias("s"), F.avg((F.col("m") < 0).cast("double")).over(w).alias("p"))
    return cut(p1)


def probabilities(t):
    s = states(t)
    return s.select("date", F.explode(F.array(F.struct(F.lit(0).alias("state"), (1 - F.col("p")).alias("p")), F.struct(F.lit(1).alias("state"), F.col("p").alias("p")))).alias("x")).select("date", "x.state", "x.p")


part("st", "SELECT date, CASE WHEN m < 0 THEN 1 ELSE 0 END AS s, avg(CASE WHEN m < 0 THEN 1.0 ELSE 0.0 END) OVER (ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS p FROM (SELECT date, avg(r) AS m FROM bret GROUP BY 1)", "bret")
part("lastp", "SELECT 1 AS state, p FROM st WHERE date = (SELECT max(date) FROM st) UNION ALL SELECT 0, 1 - p FROM st WHERE date = (SELECT max(date) FROM st)", "st")
part("rmu", "SELECT s AS state, ticker AS asset, avg(r) AS mu FROM bret JOIN st USING (date) GROUP BY 1, 2", "bret", "st")
part("rcov", "SELECT s AS state, asset_i, asset_j, covar_samp(x, y) AS cov FROM bp JOIN st USING (date) GROUP BY 1, 2, 3", "bp", "st")
part("blmu", "SELECT asset, sum(p * mu) AS mu FROM rmu JOIN lastp USING (state) GROUP BY 1", "rmu", "lastp")


def regime_tables(t):
    s = states(t)
    r = t.weekly_returns.join(s.select("date", F.col("s").alias("state")), "date")
    mu = r.groupBy("state", F.col("ticker").alias("asset")).agg(F.avg("r").alias("mu"))
    cov = None
    for k in (0, 1):
        c = E.covariance(r.where(F.col("state") == k)).select(F.lit(k).alias("state"), "asset_i", "asset_j", "cov")
        cov = c if cov is None else cov.unionByName(c)
    return mu, cov


@query("e17_blended_covariance", sql(f"""SELECT asset_i, asset_j, {rd('sum(p * (cov + (a.mu - c.mu) * (b.mu - d.mu)))')} AS cov FROM rcov JOIN lastp USING (state) JOIN rmu a ON a.state = rcov.state AND a.asset = asset_i
  JOIN rmu b ON b.state = rcov.state AND b.asset = asset_j JOIN blmu c ON c.asset = asset_i JOIN blmu d ON d.asset = asset_j GROUP BY 1, 2""", "rcov", "lastp", "rmu", "blmu"))
def e17(t):
    mu, cov = regime_tables(t)
    return out(E.blended_moments(mu, cov, probabilities(t), between=True)[1])


@query("e17_blended_mean", sql(MU + "blmu", "blmu"))
def e17m(t):
    mu, cov = regime_tables(t)
    return rounded(E.blended_moments(mu, cov, probabilities(t))[0])


part("hp", "SELECT ticker, avg(r) AS m, stddev_samp(r) AS s FROM bret GROUP BY 1", "bret")
part("emit", """SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) AS idx, date, exp(-0.5 * pow((r - (m + 0.5 * s)) / (0.7 * s), 2)) / 0.7 AS e0, exp(-0.5 * pow((r - (m - 0.5 * s)) / (1.2 * s), 2)) / 1.2 AS e1 FROM bidx JOIN hp USING (ticker)""", "bidx", "hp")


@query("e18_regime_filter", "WITH RECURSIVE " + sql(f"""SELECT ticker, CAST(date AS VARCHAR) AS date, 0 AS state, {rd('p')} AS p FROM fwdp UNION ALL SELECT ticker, CAST(date AS VARCHAR), 1, {rd('1 - p')} FROM fwdp""", "emit").removeprefix("WITH ").replace("\nSELECT ticker, CAST(date", """,
fwdp AS (SELECT ticker, idx, date, 0.6 * e0 / (0.6 * e0 + 0.4 * e1) AS p FROM emit WHERE idx = 1
  UNION ALL SELECT e.ticker, e.idx, e.date, (f.p * 0.9 + (1 - f.p) * 0.2) * e0 / ((f.p * 0.9 + (1 - f.p) * 0.2) * e0 + (f.p * 0.1 + (1 - f.p) * 0.8) * e1) FROM fwdp f JOIN emit e ON e.ticker = f.ticker AND e.idx = f.idx + 1)
SELECT ticker, CAST(date""", 1))
def e18(t):
    r = t.weekly_returns
    m, s = F.avg("r"), F.stddev_samp("r")
    st = r.groupBy("ticker").agg(F.array(m + 0.5 * s, m - 0.5 * s).alias("means"), F.array(0.7 * s, 1.2 * s).alias("sds"))
    p = E.regime_filter(r, [0.6, 0.4], [[0.9, 0.1], [0.2, 0.8]], st)
    return rounded(p.select("ticker", day(), "state", "p"))


STATE_COUNTS = (2, 3, 4)
part("rgk", """SELECT *, CAST(floor(place * CAST(k AS DOUBLE) / n) AS INTEGER) AS s FROM (SELECT ticker, date, r, row_number() OVER (PARTITION BY ticker ORDER BY r, date) - 1 AS place,
  row_number() OVER (PARTITION BY ticker ORDER BY date) AS idx, count(*) OVER (PARTITION BY ticker) AS n, stddev_pop(r) OVER (PARTITION BY ticker) AS sd FROM bret), range(2, 5) g(k) WHERE sd > 0 AND n >= k""", "bret")
part("rgs", "SELECT ticker, k, s, avg(r) AS m, greatest(stddev_pop(r), 0.25 * max(sd)) AS sd FROM rgk GROUP BY 1, 2, 3", "rgk")
part("rgm", "SELECT a.ticker, a.k, a.s AS i, b.s AS j, count(*) AS c FROM rgk a JOIN rgk b ON b.ticker = a.ticker AND b.k = a.k AND b.idx = a.idx + 1 GROUP BY 1, 2, 3, 4", "rgk")
part("rgt", """SELECT a.ticker, a.k, a.s AS i, b.s AS j, (coalesce(c, 0) + 1) / sum(coalesce(c, 0) + 1) OVER (PARTITION BY a.ticker, a.k, a.s) AS q
  FROM rgs a JOIN rgs b ON b.ticker = a.ticker AND b.k = a.k LEFT JOIN rgm ON rgm.ticker = a.ticker AND rgm.k = a.k AND i = a.s AND j = b.s""", "rgs", "rgm")
part("rgp", "SELECT rgs.ticker, rgs.k, rgs.s, m, sd, list(q ORDER BY i) AS q FROM rgs JOIN rgt ON rgt.ticker = rgs.ticker AND rgt.k = rgs.k AND j = rgs.s GROUP BY 1, 2, 3, 4, 5", "rgs", "rgt")
part("rge", """SELECT r.ticker, r.k, r.idx, list(exp(-0.5 * pow((r.r - m) / p.sd, 2)) / (p.sd * sqrt(2 * pi())) ORDER BY p.s) AS e, any_value(r.n) AS n, list(q ORDER BY p.s) AS q
  FROM rgk r JOIN rgp p ON p.ticker = r.ticker AND p.k = r.k GROUP BY 1, 2, 3""", "rgk", "rgp")
part("rgf", """SELECT ticker, k, idx, n, list_transform(u, lambda v: v / list_sum(u)) AS f, ln(list_sum(u)) AS ll FROM (SELECT *, list_transform(e, lambda v: v / k) AS u FROM rge WHERE idx = 1) UNION ALL
  SELECT ticker, k, idx, n, list_transform(u, lambda v: v / list_sum(u)), ll + ln(list_sum(u)) FROM (SELECT x.ticker, x.k, x.idx, x.n, ll, list_transform(generate_series(1, CAST(x.k AS BIGINT)), lambda j: x.e[j] * list_dot_product(f, x.q[j])) AS u
    FROM rgf JOIN rge x ON x.ticker = rgf.ticker AND x.k = rgf.k AND x.idx = rgf.idx + 1)""")
part("scored", "SELECT ticker AS model, CAST(k AS INTEGER) AS n_states, -2 * ll + (k * (k - 1) + 2 * k) * ln(n) AS score FROM rgf WHERE idx = n")


@query("e19_state_count", recursive(f"SELECT model, n_states, {rd('score')} AS score, row_number() OVER (PARTITION BY model ORDER BY score, n_states) = 1 AS chosen FROM scored", "rge", "rgf", "scored"))
def e19(t):
    fits = E.forward_loglik(t.weekly_returns, E.bucket_regimes(t.weekly_returns, STATE_COUNTS))
    return rounded(E.choose_state_count(fits.withColumnRenamed("ticker", "model")))
