"""Views, posterior moments, scenarios, sentiment, indicators and stress."""

from pyspark.sql import functions as F

from panelwright.catalog.base import part, query, rd, sql
from panelwright.catalog.ingest_q import articles
from panelwright.catalog.research_q import ics
from panelwright.catalog.risk_q import asset_list, candidate_weights
from panelwright.functions.columns import rounded
from panelwright.functions.pairs import asset_axis
from panelwright.operators import moments as E, views as B
from panelwright.session import cut

N = "CAST(substr(asset, 7) AS BIGINT)"


def num(c="asset"):
    return F.substring(c, 7, 9).cast("long")


def views(t):
    """Three views: each brand number modulo 3 picks one, long or short by its tens digit; view 0 adds up."""
    a = asset_list(t)
    return a.select((num() % 3).alias("view"), "asset", F.when(num() >= 12, -0.25).otherwise(0.25).alias("p"))


part("vw", f"SELECT {N} % 3 AS view, asset, CASE WHEN {N} >= 12 THEN -0.25 ELSE 0.25 END AS p FROM apos", "apos")
part("pvp", "SELECT a.view, sum(a.p * cov * b.p) AS pvp FROM bcov JOIN vw a ON a.asset = asset_i JOIN vw b ON b.asset = asset_j AND a.view = b.view GROUP BY 1", "bcov", "vw")


def confidence(t):
    return t.spark.range(3).select(F.col("id").alias("view"), (0.25 + 0.2 * F.col("id")).alias("alpha"))


part("om", "SELECT view, (1 / (0.25 + 0.2 * view) - 1) * 0.05 * pvp AS omega FROM pvp", "pvp")


def prior(t):
    r = t.weekly_returns
    return cut(E.mean(r)), cut(E.covariance(r).select("asset_i", "asset_j", "cov"))


def post(t):
    mu, cov = prior(t)
    v = cut(views(t))
    targets = B.view_uncertainty(cov, v, 0.05, confidence(t)).withColumn("q", 0.02 * (F.col("view") + 1))
    return B.posterior(mu, cov, v, targets, 0.05, 0.001)


# The SQL twin uses the joint formula with the 3 x 3 system solved by Cramer's rule.
part("vv", "SELECT view, asset_i AS asset, 0.05 * sum(cov * p) AS v FROM bcov JOIN vw ON vw.asset = asset_j GROUP BY 1, 2", "bcov", "vw")
part("vm", "SELECT a.view AS i, b.view AS j, sum(a.p * b.v) + CASE WHEN a.view = b.view THEN any_value(omega) ELSE 0 END AS m FROM vw a JOIN vv b ON a.asset = b.asset JOIN om ON om.view = a.view GROUP BY 1, 2", "vw", "vv", "om")
part("vb2", "SELECT view AS i, 0.02 * (view + 1) - sum(p * mu) AS b FROM vw JOIN bmu USING (asset) GROUP BY 1", "vw", "bmu")
part("m3", "SELECT " + ", ".join(f"max(m) FILTER (i = {i} AND j = {j}) AS m{i}{j}" for i in range(3) for j in range(3)) + " FROM vm", "vm")


def _cofactor(i, j):
    r, c = [x for x in range(3) if x != i], [x for x in range(3) if x != j]
    s = "" if (i + j) % 2 == 0 else "-"
    return f"{s}(m{r[0]}{c[0]} * m{r[1]}{c[1]} - m{r[0]}{c[1]} * m{r[1]}{c[0]})"


part("minv", " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {_cofactor(j, i)} / (m00 * {_cofactor(0, 0)} + m01 * {_cofactor(0, 1)} + m02 * {_cofactor(0, 2)}) AS k FROM m3" for i in range(3) for j in range(3)), "m3")


@query("b1_posterior_mean", sql(f"SELECT asset, {rd('mu + d + 0.001')} AS mu FROM bmu JOIN (SELECT vv.asset, sum(v * k * b) AS d FROM vv JOIN minv ON minv.i = vv.view JOIN vb2 ON vb2.i = minv.j GROUP BY 1) USING (asset)", "bmu", "vv", "minv", "vb2"))
def b1(t):
    return rounded(post(t)[0])


@query("b1_posterior_covariance", sql(f"SELECT asset_i, asset_j, {rd('1.05 * cov - d')} AS cov FROM bcov JOIN (SELECT a.asset AS asset_i, b.asset AS asset_j, sum(a.v * k * b.v) AS d FROM vv a JOIN minv ON minv.i = a.view JOIN vv b ON b.view = minv.j GROUP BY 1, 2) USING (asset_i, asset_j)", "bcov", "vv", "minv"))
def b1c(t):
    return rounded(post(t)[1])


@query("b2_view_uncertainty", sql(f"SELECT view, {rd('0.05 * pvp')} AS proportional, {rd('omega')} AS by_confidence FROM pvp JOIN om USING (view)", "pvp", "om"))
def b2(t):
    _, cov = prior(t)
    v = cut(views(t))
    a = B.view_uncertainty(cov, v).withColumnRenamed("omega", "proportional")
    return rounded(a.join(B.view_uncertainty(cov, v, 0.05, confidence(t)).withColumnRenamed("omega", "by_confidence"), "view"))


part("fc", "SELECT date, CAST(substr(ticker, 7) AS BIGINT) % 3 AS view, avg(r) AS realized FROM bret GROUP BY 1, 2", "bret")


@query("b3_track_record_uncertainty", sql(f"""SELECT view, {rd('var_samp(f - realized)')} AS omega FROM (SELECT date, view, realized, lag(realized) OVER (PARTITION BY view ORDER BY date) AS f FROM fc) WHERE f IS NOT NULL AND realized IS NOT NULL GROUP BY 1""", "fc"))
def b3(t):
    from pyspark.sql import Window

    real = t.weekly_returns.groupBy("date", (num("ticker") % 3).alias("view")).agg(F.avg("r").alias("realized"))
    fc = real.select("date", "view", F.lag("realized").over(Window.partitionBy("view").orderBy("date")).alias("forecast"))
    return rounded(B.track_record_uncertainty(fc, real))


@query("b4_picking_rows", sql(f"""SELECT asset, {rd('sum(value) / 10000 * CASE WHEN asset % 2 = 0 THEN 1 ELSE -1 END')} AS expected, {rd('greatest(least(coalesce(max(CASE WHEN user_id % 5 <> 0 THEN value / 20 END), 0.5), 1 - 1e-6), 1e-6)')} AS alpha
  FROM (SELECT user_id AS asset, * FROM events WHERE event_type = 'view') WHERE asset IN (SELECT s_suppkey FROM supplier) GROUP BY asset"""))
def b4(t):
    raw = t.events.where("event_type = 'view'").groupBy(F.col("user_id").alias("asset")).agg(
        F.sum("value").alias("magnitude_bps"), F.max(F.when(F.col("user_id") % 5 != 0, F.col("value") / 20)).alias("confidence"))
    raw = raw.withColumn("direction", F.when(F.col("asset") % 2 == 0, 1).otherwise(-1))
    return rounded(B.picking_rows(raw, t.raw("supplier").select(F.col("s_suppkey").alias("asset"))))


@query("b5_relative_views", sql(f"SELECT asset, 'mean' AS kind, {rd('mu + 0.01 * (pos + 1)')} AS value FROM bmu JOIN apos USING (asset) UNION ALL SELECT asset, 'variance', {rd('cov * (1 + 0.1 * pos)')} FROM bcov JOIN apos ON asset = asset_i WHERE asset_i = asset_j", "bmu", "apos", "bcov"))
def b5(t):
    mu, cov = prior(t)
    pos = asset_axis(t.weekly_returns).select(F.col("ticker").alias("asset"), "pos")
    return rounded(B.relative_views(mu, cov, pos.select("asset", (0.01 * (F.col("pos") + 1)).alias("x")), pos.select("asset", (1 + 0.1 * F.col("pos")).alias("x"))))


def scenarios(t):
    """Weeks as scenarios of the market return, equal base probabilities."""
    m = t.weekly_returns.groupBy(F.datediff("date", F.lit("1995-01-02").cast("date")).alias("s")).agg(F.avg("r").alias("x"))
    n = m.agg(F.count(F.lit(1)).alias("n"))
    from panelwright.functions.dist import attach_one

    return cut(attach_one(m, n).select("s", "x", (1.0 / F.col("n")).alias("p0")))


part("sc", "SELECT date_diff('day', DATE '1995-01-02', date) AS s, avg(r) AS x, 1.0 / count(*) OVER () AS p0 FROM bret GROUP BY date", "bret")
part("scm", "SELECT avg(x) - 0.5 * stddev_samp(x) AS target FROM sc", "sc")
# Bisection on the tilt, 60 halvings: another road than the Newton steps.
BISECT = """, bis AS (SELECT 0 AS k, -200.0::DOUBLE AS lo, 200.0::DOUBLE AS hi UNION ALL SELECT k + 1, CASE WHEN f < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN f < target THEN hi ELSE (lo + hi) / 2 END FROM
  (SELECT k, lo, hi, target, (SELECT sum(exp((lo + hi) / 2 * x) * x) / sum(exp((lo + hi) / 2 * x)) FROM sc) AS f FROM bis, scm WHERE k < 70)),
lam AS (SELECT (lo + hi) / 2 AS l FROM bis ORDER BY k DESC LIMIT 1), tilt_p AS (SELECT s, x, p0, exp(l * x) / sum(exp(l * x)) OVER () AS p FROM sc, lam)"""


def tilt_sql(body):
    return "WITH RECURSIVE " + sql("@", "sc", "scm", "bret").removeprefix("WITH ").replace("\n@", BISECT) + "\n" + body


def tilted(t):
    s = scenarios(t)
    target = s.agg((F.avg("x") - 0.5 * F.stddev_samp("x"))).first()[0]
    return s, cut(B.tilt_to_mean(s, target))


@query("b6_tilted_probabilities", tilt_sql(f"SELECT s, {rd('p')} AS p FROM tilt_p"))
def b6(t):
    return rounded(tilted(t)[1])


def asset_scenarios(t):
    return t.weekly_returns.select(F.datediff("date", F.lit("1995-01-02").cast("date")).alias("s"), F.col("ticker").alias("asset"), "r")


@query("b6_scenario_moments", tilt_sql(f"""SELECT asset, {rd('m')} AS mean, {rd('sum(p * (r - m) * (r - m))')} AS variance, {rd('sum(p * pow(r - m, 3)) / pow(sum(p * pow(r - m, 2)), 1.5)')} AS skew,
  {rd('sum(p * pow(r - m, 4)) / pow(sum(p * pow(r - m, 2)), 2)')} AS kurtosis, {rd('-sum(greatest(0, least(p, 0.05 - (cp - p))) * r) / 0.05')} AS cvar FROM (SELECT ticker AS asset, r, p, sum(p * r) OVER (PARTITION BY ticker) AS m,
  sum(p) OVER (PARTITION BY ticker ORDER BY r, s ROWS UNBOUNDED PRECEDING) AS cp FROM bret JOIN tilt_p ON s = date_diff('day', DATE '1995-01-02', date)) GROUP BY asset, m"""))
def b6m(t):
    _, p = tilted(t)
    return rounded(B.scenario_moments(asset_scenarios(t), p))


@query("b6_scenario_correlation", tilt_sql(f"""SELECT a.ticker AS asset_i, b.ticker AS asset_j, {rd('sum(a.p * (a.r - a.m) * (b.r - b.m)) / sqrt(sum(a.p * (a.r - a.m) * (a.r - a.m)) * sum(a.p * (b.r - b.m) * (b.r - b.m)))')} AS corr
  FROM (SELECT *, sum(p * r) OVER (PARTITION BY ticker) AS m FROM bret JOIN tilt_p ON s = date_diff('day', DATE '1995-01-02', date)) a JOIN (SELECT *, sum(p * r) OVER (PARTITION BY ticker) AS m FROM bret JOIN tilt_p ON s = date_diff('day', DATE '1995-01-02', date)) b
  USING (s) WHERE a.ticker <= b.ticker GROUP BY 1, 2"""), complete=True)
def b6c(t):
    _, p = tilted(t)
    return rounded(B.scenario_correlation(asset_scenarios(t), p))


@query("b6_divergence", tilt_sql(f"SELECT {rd('sum(p * ln(p / p0))')} AS kl FROM tilt_p"))
def b6k(t):
    s, p = tilted(t)
    return rounded(B.divergence(p, s))


def experts(t):
    """Two experts: one weighs recent scenarios more, one the bad ones."""
    s = scenarios(t)
    from panelwright.functions.dist import attach_one

    raw = s.select("s", F.explode(F.array(F.struct(F.lit("recent").alias("expert"), F.exp(F.col("s") / 1000.0).alias("raw")),
                                          F.struct(F.lit("bear").alias("expert"), F.exp(-2 * F.col("x")).alias("raw")))).alias("e")).select("e.expert", "s", "e.raw")
    total = raw.groupBy("expert").agg(F.sum("raw").alias("t"))
    p = raw.join(total, "expert").select("expert", "s", (F.col("raw") / F.col("t")).alias("p"))
    v = t.spark.createDataFrame([("recent", 0.5), ("bear", 0.2)], "expert string, v double")
    return s, p, v


part("xp", "SELECT s, p0, exp(s / 1000.0) / sum(exp(s / 1000.0)) OVER () AS a, exp(-2 * x) / sum(exp(-2 * x)) OVER () AS b FROM sc", "sc")


@query("b7_opinion_pool", sql(f"""SELECT s, {rd('0.5 * a + 0.2 * b + 0.3 * p0')} AS linear, {rd('exp(0.5 * ln(a) + 0.2 * ln(b) + 0.3 * ln(p0)) / sum(exp(0.5 * ln(a) + 0.2 * ln(b) + 0.3 * ln(p0))) OVER ()')} AS logarithmic FROM xp""", "xp"))
def b7(t):
    s, p, v = experts(t)
    lin = B.pool_opinions(p, v, s).withColumnRenamed("p", "linear")
    return rounded(lin.join(B.pool_opinions(p, v, s, linear=False).withColumnRenamed("p", "logarithmic"), "s"))


@query("b8_expert_weights", sql(f"""SELECT expert, {rd('raw / sum(raw) OVER ()')} AS v FROM (SELECT factor AS expert, greatest(avg(ic) / stddev_samp(ic), 0) + 1e-6 AS raw FROM ic GROUP BY 1)""", "ic"))
def b8(t):
    return rounded(B.expert_weights(ics(t).withColumnRenamed("factor", "expert")))


part("artl", "SELECT country AS ticker, published, quality - toxic AS score FROM art JOIN labels ON doc_id = article_id", "art")


def scored_articles(t):
    lab = t.raw("labels")
    return articles(t).join(lab, F.col("doc_id") == F.col("article_id")).select(F.col("country").alias("ticker"), "published", (F.col("quality") - F.col("toxic")).cast("double").alias("score"))


part("sig", "SELECT ticker, sum(score * exp(-ln(2.0) * greatest(0, epoch(TIMESTAMP '2024-03-15 00:00:00' - published) / 86400.0) / 5)) AS signal FROM artl GROUP BY 1", "artl")


@query("b9_sentiment_signal", sql(f"SELECT ticker, {rd('signal')} AS signal FROM sig", "sig"))
def b9(t):
    return rounded(B.sentiment_signal(scored_articles(t), "2024-03-15 00:00:00"))


part("dirs", "SELECT ticker, d AS direction FROM (SELECT DISTINCT lang AS ticker FROM documents), (VALUES (1), (-1)) v(d)")


@query("b10_adjusted_confidence", sql(f"""SELECT ticker, direction, {rd('least(greatest(0.4 * CASE WHEN s = 0 THEN 1 WHEN (s > 0) = (direction > 0) THEN 1 + abs(s) ELSE 1 - abs(s) END, 0.01), 0.99)')} AS alpha
  FROM (SELECT ticker, direction, coalesce(signal, 0) / 100 AS s FROM dirs LEFT JOIN sig USING (ticker))""", "dirs", "sig"))
def b10(t):
    v = t.raw("documents").select(F.col("lang").alias("ticker")).distinct().select("ticker", F.explode(F.array(F.lit(1), F.lit(-1))).alias("direction"), F.lit(0.4).alias("alpha"))
    s = B.sentiment_signal(scored_articles(t), "2024-03-15 00:00:00").withColumn("signal", F.col("signal") / 100)
    return rounded(B.adjusted_confidence(v, s))


part("ind0", "SELECT ticker, close, close - lag(close) OVER (PARTITION BY ticker ORDER BY date) AS mv, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM px", "px")
part("ind", """SELECT ticker, n, l, m1, y1, h, w, CASE WHEN nm >= 14 THEN CASE WHEN ls = 0 THEN 100 ELSE 100 - 100 / (1 + g / ls) END END AS rsi FROM (SELECT ticker, count(*) AS n, max(close) FILTER (k = 1) AS l, max(close) FILTER (k = 2) AS m1, max(close) FILTER (k = 13) AS y1,
  max(close) FILTER (k <= 12) AS h, min(close) FILTER (k <= 12) AS w, count(mv) FILTER (k <= 14) AS nm, coalesce(sum(mv) FILTER (k <= 14 AND mv > 0), 0) / 14 AS g, coalesce(-sum(mv) FILTER (k <= 14 AND mv < 0), 0) / 14 AS ls FROM ind0 GROUP BY 1)""", "ind0")


@query("b11_indicators", sql(f"""SELECT ticker, {rd('m1 / y1 - 1')} AS momentum_12_1, {rd('CASE WHEN n > 12 THEN l / m1 - 1 END')} AS momentum_1m, {rd('rsi')} AS rsi, {rd('l / h - 1')} AS from_high, {rd('l / w - 1')} AS from_low,
  {rd('c / current_price - 1')} AS upside FROM ind JOIN fund USING (ticker) JOIN (SELECT ticker, avg(close) AS c FROM px GROUP BY 1) USING (ticker)""", "ind", "fund", "px"))
def b11(t):
    ind = B.indicators(t.panel, 1, 12)
    target = t.panel.groupBy("ticker").agg(F.avg("close").alias("target_price")).join(t.fundamentals.select("ticker", "current_price"), "ticker")
    up = B.target_upside(target).select("ticker", "upside")
    return rounded(ind.join(up, "ticker"))


part("sb", "SELECT sector, count(*) AS n, sum(s_acctbal) AS b FROM listing GROUP BY 1", "listing")


@query("b12_sector_budgets", sql(f"""SELECT ticker AS asset, {rd('greatest(b, 0) / n / sum(greatest(b, 0) / n) OVER ()')} AS budget FROM listing JOIN sb USING (sector)""", "listing", "sb"))
def b12(t):
    budgets = t.listing.groupBy("sector").agg(F.greatest(F.sum("s_acctbal"), F.lit(0.0)).alias("b"))
    return rounded(B.sector_budgets(budgets, t.listing.select(F.col("ticker").alias("asset"), "sector")))


@query("b12_group_weights", sql(f"""SELECT country, CAST(date AS VARCHAR) AS date, {rd('greatest(0.1, coalesce(gdp_growth, 0)) / avg(greatest(0.1, coalesce(gdp_growth, 0))) OVER (PARTITION BY date)')} AS w FROM macro""", "macro"))
def b12g(t):
    raw = t.macro.select("country", F.date_format("date", "yyyy-MM-dd").alias("date"), F.coalesce("gdp_growth", F.lit(0.0)).alias("w"))
    return rounded(B.normalized_group_weights(raw, ["date"]))


part("shk", """SELECT s AS scenario, s * 0.6 AS probability, asset, CASE WHEN s = 0 THEN mu / 3 - 0.12 ELSE mu * s - 0.02 END AS shock FROM bmu, range(0, 3) r(s)""", "bmu")
part("shc", "SELECT scenario, greatest(least(probability, 1 - 1e-4), 1e-4) AS probability, asset, greatest(least(shock, 0.9999), -0.9999) AS shock FROM shk", "shk")
part("shp", """SELECT scenario, probability, asset, CASE WHEN NOT (SELECT coalesce(bool_or(m <= -0.1), false) FROM (SELECT avg(shock) FILTER (shock < 0) AS m FROM shc GROUP BY scenario)) AND scenario = 0 THEN least(shock, -0.1) ELSE shock END AS shock FROM shc""", "shc")


@query("b13_stress", sql(f"SELECT portfolio, scenario, {rd('probability')} AS probability, {rd('sum(w * shock)')} AS loss FROM shp JOIN cw USING (asset) GROUP BY portfolio, scenario, probability", "shp", "cw"))
def b13(t):
    mu = E.mean(t.weekly_returns)
    s = F.col("scenario")
    shocks = mu.select("asset", "mu", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("scenario")).select(
        "scenario", (s * 0.6).alias("probability"), "asset", F.when(s == 0, F.col("mu") / 3 - 0.12).otherwise(F.col("mu") * s - 0.02).alias("shock"))
    return rounded(B.stressed_holdings(B.clamped_scenarios(shocks), candidate_weights(t)))
