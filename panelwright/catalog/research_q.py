"""Composite scores, regimes, selection, factor validation, mimicking portfolios, folds and alpha."""

from pyspark.sql import Window, functions as F

from panelwright.catalog.base import part, query, rd, sql
from panelwright.catalog.factors_q import KEY, all_standardized, wide_scores
from panelwright.catalog.sources_q import day
from panelwright.catalog.universe_q import members
from panelwright.config import CORE_GROUPS, FACTOR_GROUPS, GROUPS, REGIME_TILTS, SPREAD_BANDS, CompositeConfig, SelectionConfig
from panelwright.functions.columns import rounded
from panelwright.functions.dist import attach_one
from panelwright.operators import alpha as A, composite as C, folds as O, mimicking as M, regime as R, research as V, selection as L, standardize as Z
from panelwright.session import cut

GROUP_CASE = "CASE factor " + " ".join(f"WHEN '{f}' THEN '{g}'" for f, g in FACTOR_GROUPS.items()) + " END"
TIER_CASE = "CASE WHEN grp IN ('" + "', '".join(CORE_GROUPS) + "') THEN 1.0 ELSE 0.5 END"

# Information coefficients

part("pairs", "SELECT date, ticker, factor, x, fwd FROM sh JOIN fwd USING (date, ticker) WHERE x IS NOT NULL AND fwd IS NOT NULL", "sh", "fwd")
part("ics", """SELECT factor, date, CASE WHEN count(*) >= 3 THEN corr(rx, ry) END AS ic FROM (
  SELECT factor, date, rank() OVER (PARTITION BY factor, date ORDER BY x) + (count(*) OVER (PARTITION BY factor, date, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY factor, date ORDER BY fwd) + (count(*) OVER (PARTITION BY factor, date, fwd) - 1) / 2.0 AS ry FROM pairs) GROUP BY 1, 2""", "pairs")
part("ic", "SELECT * FROM ics WHERE ic IS NOT NULL", "ics")


def ics(t):
    return V.ic_series(t.score_history, t.forward_returns)


def pairs(t):
    return V.paired(t.score_history, t.forward_returns)


@query("v1_rank_ic", sql(f"SELECT CAST(date AS VARCHAR) AS date, factor, {rd('ic')} AS ic FROM ics", "ics"))
def v1(t):
    return rounded(V.rank_ic(pairs(t)).select(day(), "factor", "ic"))


@query("v2_ic_series", sql(f"SELECT CAST(date AS VARCHAR) AS date, factor, {rd('ic')} AS ic FROM ic", "ic"))
def v2(t):
    return rounded(ics(t).select(day(), "factor", "ic"))


@query("v3_icir", sql(f"SELECT factor, {rd('coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0)')} AS icir FROM ic GROUP BY 1", "ic"))
def v3(t):
    return rounded(V.icir(ics(t)))


def nw_parts(name, lags):
    terms = " + ".join(
        f"{2 * (1 - k / (lags + 1))!r} * coalesce((SELECT avg(a.d * b.d) FROM {name}_d a JOIN {name}_d b ON b.factor = a.factor AND b.rn = a.rn - {k} WHERE a.factor = s.factor), 0)"
        for k in range(1, lags + 1)
    )
    part(f"{name}_d", "SELECT factor, ic, ic - avg(ic) OVER (PARTITION BY factor) AS d, row_number() OVER (PARTITION BY factor ORDER BY date) AS rn FROM ic", "ic")
    part(f"{name}_s", f"SELECT factor, n, m, sd, greatest(g0 + {terms}, 1e-12) AS v FROM (SELECT factor, count(*) AS n, avg(ic) AS m, stddev_samp(ic) AS sd, avg(d * d) AS g0 FROM {name}_d GROUP BY 1) s", f"{name}_d")
    # The two-sided t probability by Simpson's rule over the density, 2,000 steps from 0 to |t|.
    dens = "pow(1 + (h * i) * (h * i) / nu, -(nu + 1) / 2.0)"
    part(name, f"""SELECT factor, n, m AS mean_ic, sd AS ic_std, v AS variance_nw, tt AS t_stat, m / sd AS icir, greatest(1 - 2 * exp(lgamma((nu + 1) / 2.0) - lgamma(nu / 2.0)) / sqrt(nu * pi()) * h / 3 *
      list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {dens})), 0) AS p_value
      FROM (SELECT *, n - 1 AS nu, m / sqrt(v / n) AS tt, abs(m / sqrt(v / n)) / 2000 AS h FROM {name}_s)""", f"{name}_s")


nw_parts("nw6", 6)
nw_parts("nw5", 5)


@query("v4_newey_west", sql(f"SELECT factor, {rd('t_stat')} AS t_stat, {rd('p_value')} AS p_value FROM nw6", "nw6"))
def v4(t):
    return rounded(V.ic_stats(cut(ics(t)), 6).select("factor", "t_stat", "p_value"))


@query("v5_ic_stats", sql(f"SELECT factor, n, {rd('mean_ic')} AS mean_ic, {rd('variance_nw')} AS variance_nw, {rd('t_stat')} AS t_stat, {rd('p_value')} AS p_value, {rd('icir')} AS icir FROM nw5", "nw5"))
def v5(t):
    return rounded(V.ic_stats(cut(ics(t)), 5).select("factor", "n", "mean_ic", "variance_nw", "t_stat", "p_value", "icir"))


part("adj", """SELECT *, max(least(1, p_value * (m_ - rn + 1))) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS p_holm,
  min(least(1, p_value * m_ / rn)) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p_bh
  FROM (SELECT *, row_number() OVER (ORDER BY p_value, factor) AS rn, count(*) OVER () AS m_ FROM nw5)""", "nw5")


@query("v6_adjusted_p_values", sql(f"SELECT factor, {rd('p_value')} AS p_value, {rd('p_holm')} AS p_holm, {rd('p_bh')} AS p_bh FROM adj", "adj"))
def v6(t):
    p = V.ic_stats(cut(ics(t)), 5).select("factor", "p_value")
    return rounded(V.adjust_p_values(p).select("factor", "p_value", "p_holm", "p_bh"))


@query("v7_factor_universe", sql(f"""SELECT factor, {rd('mean_ic')} AS mean_ic, {rd('icir')} AS icir, {rd('t_stat')} AS t_stat, {rd('p_value')} AS p_value,
  {rd('p_holm')} AS p_holm, {rd('p_bh')} AS p_bh, p_holm <= 0.05 AS significant_holm, p_bh <= 0.05 AS significant_bh FROM adj""", "adj"))
def v7(t):
    return rounded(V.factor_universe_report(cut(ics(t))).select(
        "factor", "mean_ic", "icir", "t_stat", "p_value", "p_holm", "p_bh", "significant_holm", "significant_bh"))


part("edges", """SELECT factor, date, count(*) AS n, list_distinct([quantile_cont(x, 0.2), quantile_cont(x, 0.4), quantile_cont(x, 0.6), quantile_cont(x, 0.8), quantile_cont(x, 1.0)]) AS e
  , min(x) AS e0 FROM pairs GROUP BY 1, 2""", "pairs")
part("buck", "SELECT p.*, n, len(list_filter(e, lambda v: v < x AND v > e0)) AS b FROM pairs p JOIN edges USING (factor, date)", "pairs", "edges")
part("spr", """SELECT factor, date, CASE WHEN max(n) >= 5 AND count(*) >= 2 THEN arg_max(m, b) - arg_min(m, b) END AS spread FROM
  (SELECT factor, date, b, max(n) AS n, avg(fwd) AS m FROM buck GROUP BY 1, 2, 3) GROUP BY 1, 2""", "buck")


@query("v8_quantile_spread", sql(f"SELECT CAST(date AS VARCHAR) AS date, factor, {rd('spread')} AS spread FROM spr", "spr"))
def v8(t):
    return rounded(V.quantile_spread(pairs(t)).select(day(), "factor", "spread"))


FOUR = ["momentum_12_1", "volatility", "amihud_illiquidity", "book_to_price"]
part("wide", "SELECT date, ticker, " + ", ".join(f"max(x) FILTER (factor = '{f}') AS f{i}" for i, f in enumerate(FOUR)) + " FROM sh GROUP BY 1, 2", "sh")
part("wideok", "SELECT * FROM wide WHERE f0 IS NOT NULL AND f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL", "wide")


def vif_sql():
    """R2 on three others by the closed 3x3 solution (Cramer's rule) over correlations."""
    rows = []
    for i in range(4):
        a, b, c = [j for j in range(4) if j != i]
        r = lambda p, q: f"corr(f{p}, f{q})"
        rows.append(f"SELECT '{FOUR[i]}' AS factor, {r(i, a)} AS ya, {r(i, b)} AS yb, {r(i, c)} AS yc, {r(a, b)} AS ab, {r(a, c)} AS ac, {r(b, c)} AS bc FROM wideok")
    det = "(1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc)"
    quad = ("(ya * ya * (1 - bc * bc) + yb * yb * (1 - ac * ac) + yc * yc * (1 - ab * ab)"
            " + 2 * ya * yb * (ac * bc - ab) + 2 * ya * yc * (ab * bc - ac) + 2 * yb * yc * (ab * ac - bc))")
    return f"SELECT factor, 1 / (1 - {quad} / {det}) AS vif FROM ({' UNION ALL '.join(rows)})"


part("vifs", vif_sql(), "wideok")


@query("v9_variance_inflation", sql(f"SELECT factor, {rd('vif')} AS vif FROM vifs", "vifs"))
def v9(t):
    return rounded(V.variance_inflation(*wide_scores(t)))


@query("v10_bh_rejections", sql("""SELECT factor, coalesce(rn <= (SELECT max(rn) FROM adj WHERE p_value <= 0.5 * rn / m_), false) AS rejected FROM adj""", "adj"))
def v10(t):
    return V.bh_rejections(V.ic_stats(cut(ics(t)), 5).select("factor", "p_value"), 0.5).select("factor", "rejected")


BAND_LO = "CASE factor " + " ".join(f"WHEN '{f}' THEN {SPREAD_BANDS[g][0]}" for f, g in FACTOR_GROUPS.items()) + " END"
BAND_HI = "CASE factor " + " ".join(f"WHEN '{f}' THEN {SPREAD_BANDS[g][1]}" for f, g in FACTOR_GROUPS.items()) + " END"
part("adj6", """SELECT *, max(least(1, p_value * (m_ - rn + 1))) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS p_holm,
  min(least(1, p_value * m_ / rn)) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p_bh
  FROM (SELECT *, row_number() OVER (ORDER BY p_value, factor) AS rn, count(*) OVER () AS m_ FROM nw6)""", "nw6")


@query("v11_validation_report", sql(f"""SELECT factor, {rd('mean_ic')} AS mean_ic, {rd('ic_std')} AS ic_std, {rd('t_stat')} AS t_stat, {rd('p_value')} AS p_value, abs(t_stat) >= 2 AS significant,
  {rd('spread')} AS spread, CASE WHEN spread IS NOT NULL THEN abs(spread) BETWEEN {BAND_LO} AND {BAND_HI} END AS within_band, p_holm <= 0.05 AS significant_holm, p_bh <= 0.05 AS significant_bh
  FROM adj6 LEFT JOIN (SELECT factor, spread FROM spr WHERE date = (SELECT max(date) FROM spr)) USING (factor)""", "adj6", "spr"))
def v11(t):
    fwd = t.forward_returns.where("fwd is not null")
    return rounded(V.validation_report(t.score_history, fwd))


@query("v12_factor_components")
def v12(t):
    return rounded(V.factor_components(*wide_scores(t)))


@query("v13_redundant_factors", sql(f"SELECT factor, {rd('vif')} AS vif FROM vifs WHERE vif > 1.1", "vifs"))
def v13(t):
    return rounded(V.redundant_factors(*wide_scores(t), 1.1))


# Composite scores

part("gs", f"SELECT ticker, grp, avg(x) AS score FROM (SELECT ticker, {GROUP_CASE} AS grp, x FROM alls) GROUP BY 1, 2", "alls")
part("gic", f"SELECT date, {GROUP_CASE} AS grp, ic FROM ic", "ic")


def groups(t):
    return C.group_scores(all_standardized(t))


def group_ic(t):
    from panelwright.operators.factors import group_of

    return ics(t).select("date", group_of(F.col("factor")).alias("grp"), "ic")


@query("c1_group_scores", sql(f"SELECT ticker, grp, {rd('score')} AS score FROM gs", "gs"))
def c1(t):
    return rounded(groups(t))


@query("c2_equal_weight", sql(f"SELECT ticker, {rd(f'sum({TIER_CASE} * coalesce(score, 0)) / sum({TIER_CASE})')} AS composite FROM gs GROUP BY 1", "gs"))
def c2(t):
    return rounded(C.equal_weight(groups(t)))


part("icw", f"""SELECT grp, {TIER_CASE} * coalesce(greatest(m, 0), 0) AS w FROM (SELECT DISTINCT grp FROM gs) LEFT JOIN (SELECT grp, avg(ic) AS m FROM gic
  WHERE date IN (SELECT DISTINCT date FROM gic ORDER BY date DESC LIMIT 36) GROUP BY 1) USING (grp)""", "gs", "gic")
part("icirw", f"""SELECT grp, {TIER_CASE} * coalesce(abs(m), 0) AS w FROM (SELECT DISTINCT grp FROM gs) LEFT JOIN
  (SELECT grp, avg(ic) / nullif(stddev_samp(ic), 0) AS m FROM gic GROUP BY 1) USING (grp)""", "gs", "gic")


@query("c3_ic_weighted", sql(f"SELECT ticker, {rd('sum(w * coalesce(score, 0)) / sum(w)')} AS composite FROM gs JOIN icw USING (grp) GROUP BY 1", "gs", "icw"))
def c3(t):
    return rounded(C.ic_weighted(groups(t), group_ic(t)))


@query("c4_icir_weighted", sql(f"SELECT ticker, {rd('sum(w * coalesce(score, 0)) / sum(w)')} AS composite FROM gs JOIN icirw USING (grp) GROUP BY 1", "gs", "icirw"))
def c4(t):
    return rounded(C.icir_weighted(groups(t), group_ic(t)))


def training_table(t):
    """Standardized monthly scores with the forward return."""
    z = cut(Z.standardize(t.score_history, KEY))
    wide = z.groupBy("date", "ticker").pivot("factor", FOUR).agg(F.first("x"))
    return wide.join(t.forward_returns, ["date", "ticker"])


def train_test(t):
    """All dates before the last one, and the last one, which is scored."""
    rows = cut(training_table(t))
    dated = attach_one(rows, rows.agg(F.max("date").alias("_last")))
    return dated.where("date < _last").drop("_last"), dated.where("date = _last").drop("_last")


@query("c5_ridge_fit")
def c5(t):
    train, _ = train_test(t)
    m = C.fit_ridge(train, FOUR)
    rows = [(f, float(c)) for f, c in zip(FOUR, m.coefficients)] + [("intercept", float(m.intercept))]
    return rounded(t.spark.createDataFrame(rows, "term string, coefficient double"))


@query("c6_tree_scores")
def c6(t):
    train, test = train_test(t)
    return rounded(C.predict_scores(C.fit_trees(train, FOUR), test, FOUR))


@query("c7_ridge_scores")
def c7(t):
    train, test = train_test(t)
    return rounded(C.predict_scores(C.fit_ridge(train, FOUR), test, FOUR))


def _dispatch(method, name):
    oracle = {
        "equal_weight": (f"sum({TIER_CASE} * coalesce(score, 0)) / sum({TIER_CASE})", "gs", ()),
        "ic_weighted": ("sum(w * coalesce(score, 0)) / sum(w)", "gs JOIN icw USING (grp)", ("icw",)),
        "icir_weighted": ("sum(w * coalesce(score, 0)) / sum(w)", "gs JOIN icirw USING (grp)", ("icirw",)),
    }[method]

    @query(name, sql(f"SELECT ticker, {rd(oracle[0])} AS composite FROM {oracle[1]} GROUP BY 1", "gs", *oracle[2]))
    def run(t):
        return rounded(C.composite(all_standardized(t), CompositeConfig(method=method), group_ic(t)))


for _m in ("equal_weight", "ic_weighted", "icir_weighted"):
    _dispatch(_m, f"c8_composite_{_m}")


def _fitted(t, method):
    """The dispatcher's fitted methods: long scores of the last date, trained on the dates before."""
    train, test = train_test(t)
    scores = test.unpivot("ticker", FOUR, "factor", "x")
    return rounded(C.composite(scores, CompositeConfig(method=method), training=train))


@query("c8_composite_ridge")
def c8_ridge(t):
    return _fitted(t, "ridge")


@query("c8_composite_trees")
def c8_trees(t):
    return _fitted(t, "trees")


# Regimes

part("mseq", "SELECT country, date, gdp_growth, unemployment_rate, yield_spread, row_number() OVER (PARTITION BY country ORDER BY date) AS rn FROM macro", "macro")
part("reg", """SELECT country, date, CASE WHEN rn <= 2 THEN CASE WHEN yield_spread > 1 THEN 'expansion' WHEN yield_spread > 0 THEN 'slowdown' WHEN yield_spread > -0.5 THEN 'recovery' ELSE 'recession' END
  WHEN u > pu AND g > 0 THEN 'slowdown' WHEN g > tr AND g > pg THEN 'expansion' WHEN g > tr THEN 'slowdown' WHEN g <= pg THEN 'recession' ELSE 'recovery' END AS regime FROM (
  SELECT country, date, rn, yield_spread, gdp_growth AS g, lag(gdp_growth) OVER w AS pg, unemployment_rate AS u, lag(unemployment_rate) OVER w AS pu,
  avg(gdp_growth) OVER (PARTITION BY country ORDER BY rn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS tr FROM mseq WINDOW w AS (PARTITION BY country ORDER BY rn))""", "mseq")


@query("r1_macro_regime", sql("SELECT country, CAST(date AS VARCHAR) AS date, regime FROM reg", "reg"))
def r1(t):
    return R.classify(t.macro).select("country", day(), "regime")


part("tilt", " UNION ALL ".join(f"SELECT '{r}' AS regime, '{g}' AS grp, {tl.get(g, 1.0)} AS tilt" for r, tl in REGIME_TILTS.items() for g in GROUPS))
part("tw", f"""SELECT country, date, regime, grp, w * tilt * sum(w) OVER p / sum(w * tilt) OVER p AS w FROM
  (SELECT *, {TIER_CASE} AS w FROM reg JOIN tilt USING (regime)) WINDOW p AS (PARTITION BY country, date)""", "reg", "tilt")


@query("r2_tilted_weights", sql(f"SELECT country, CAST(date AS VARCHAR) AS date, regime, grp, {rd('w')} AS w FROM tw", "tw"))
def r2(t):
    weights = C.tier_weights(t.spark, CompositeConfig()).withColumnRenamed("tier", "w")
    return rounded(R.tilted_weights(R.classify(t.macro), weights, ["country", "date"]).select("country", day(), "regime", "grp", "w"))


@query("r3_lagged_macro", sql(f"SELECT country, CAST(date AS VARCHAR) AS date, {rd('gdp_growth')} AS gdp_growth FROM macro WHERE date <= DATE '1998-06-30' - 63", "macro"))
def r3(t):
    return rounded(R.lagged_macro(t.macro, "1998-06-30").select("country", day(), "gdp_growth"))


# Selection

part("comp", f"SELECT ticker, sum({TIER_CASE} * coalesce(score, 0)) / sum({TIER_CASE}) AS score FROM gs GROUP BY 1", "gs")
part("rk", "SELECT ticker, score, row_number() OVER (ORDER BY score DESC, ticker) AS rn, ticker IN (SELECT ticker FROM mem) AS m FROM comp", "comp", "mem")


def scores(t):
    return cut(C.equal_weight(groups(t)).withColumnRenamed("composite", "score"))


@query("l1_fixed_count", sql("SELECT ticker FROM rk WHERE rn <= 20 OR (m AND rn <= 26)", "rk"))
def l1(t):
    return L.fixed_count(scores(t), 20, 0.3, members(t)).select("ticker")


@query("l2_quantile", sql("""SELECT ticker FROM rk WHERE score >= (SELECT quantile_cont(score, 0.8) FROM comp) OR (m AND score >= (SELECT quantile_cont(score, 0.7) FROM comp))""", "rk"))
def l2(t):
    return L.quantile(scores(t), 0.8, 0.7, members(t)).select("ticker")


part("sel", "SELECT ticker FROM rk WHERE rn <= 30 OR (m AND rn <= 33)", "rk")
part("bal", """SELECT r.sector, h, greatest(0, round_even((c / tot - 0.01) * n, 0)) AS lo, round_even((c / tot + 0.01) * n, 0) AS hi FROM
  (SELECT sector, count(*) AS c, sum(count(*)) OVER () AS tot FROM listing GROUP BY 1) r JOIN (SELECT sector, count(*) FILTER (ticker IN (SELECT ticker FROM sel)) AS h FROM listing GROUP BY 1) USING (sector),
  (SELECT count(*) AS n FROM sel)""", "listing", "sel")
part("balanced", """SELECT ticker FROM (SELECT ticker, s, h, lo, hi, row_number() OVER (PARTITION BY sector, s ORDER BY CASE WHEN s THEN score ELSE -score END, ticker) AS rn
  FROM (SELECT ticker, sector, score, ticker IN (SELECT ticker FROM sel) AS s FROM listing JOIN comp USING (ticker)) JOIN bal USING (sector))
  WHERE (s AND NOT (h > hi AND rn <= h - hi)) OR (NOT s AND h < lo AND rn <= lo - h)""", "listing", "comp", "bal")


@query("l3_sector_balance", sql("SELECT ticker FROM balanced", "balanced"))
def l3(t):
    s = scores(t)
    picked = L.fixed_count(s, 30, 0.1, members(t))
    return L.sector_balance(picked, s, t.listing.select("ticker", "sector"), 0.01)


@query("l4_selection_turnover", sql(f"""SELECT {rd('''(SELECT count(*) FROM mem FULL JOIN sel ON mem.ticker = sel.ticker WHERE mem.ticker IS NULL OR sel.ticker IS NULL) / (SELECT count(*) FROM listing)''')} AS turnover""", "mem", "sel", "listing"))
def l4(t):
    picked = L.fixed_count(scores(t), 30, 0.1, members(t))
    return rounded(L.turnover(members(t), picked, t.listing))


@query("l5_select_stocks", sql("SELECT ticker FROM balanced", "balanced"))
def l5(t):
    c = SelectionConfig(target_count=30, sector_balance=True, sector_tolerance=0.01)
    return L.select(scores(t), c, members(t), t.listing.select("ticker", "sector"))


part("momrk", "SELECT date, ticker, x, row_number() OVER (PARTITION BY date ORDER BY x DESC, ticker) AS rn FROM sh WHERE factor = 'momentum_12_1' AND x IS NOT NULL", "sh")


@query("l5_select_over_dates", "WITH RECURSIVE " + sql("""SELECT CAST(a.date AS VARCHAR) AS date, count(*) AS n, sum(CAST(substr(ticker, 2) AS BIGINT)) AS key_sum FROM walk JOIN ax a USING (idx) GROUP BY 1""", "momrk", "ax").removeprefix("WITH ").replace("\nSELECT CAST(a.date", """,
mi AS (SELECT m.*, idx FROM momrk m JOIN ax USING (date)),
walk AS (SELECT idx, ticker FROM mi WHERE rn <= 20 AND idx = (SELECT min(idx) FROM mi)
  UNION ALL SELECT mi.idx, mi.ticker FROM mi JOIN (SELECT max(idx) AS p, list(ticker) AS held FROM walk) w ON mi.idx = w.p + 1
  WHERE mi.rn <= 20 OR (mi.rn <= 30 AND list_contains(w.held, mi.ticker)))
SELECT CAST(a.date"""))
def l5_dates(t):
    s = t.score_history.where("factor = 'momentum_12_1'").select("date", "ticker", F.col("x").alias("score"))
    picked = L.over_dates(s, SelectionConfig(target_count=20, buffer_fraction=0.5))
    return picked.groupBy(day()).agg(F.count("*").alias("n"), F.sum(F.substring("ticker", 2, 20).cast("long")).alias("key_sum"))


# Mimicking portfolios

part("legs", """SELECT *, ceil(round(n * 0.3, 9)) AS k0 FROM (SELECT *, row_number() OVER (PARTITION BY factor, date ORDER BY x, ticker) AS rn, count(*) OVER (PARTITION BY factor, date) AS n FROM pairs)""", "pairs")
part("side", "SELECT *, CASE WHEN n >= 2 * greatest(1, k0) THEN CASE WHEN rn > n - greatest(1, k0) THEN 1 WHEN rn <= greatest(1, k0) THEN -1 END END AS side FROM legs", "legs")
part("legr", """SELECT factor, date, avg(fwd) FILTER (side = 1) AS l, avg(fwd) FILTER (side = -1) AS s,
  sum(fwd * abs(x)) FILTER (side = 1) / sum(abs(x)) FILTER (side = 1) AS lv, sum(fwd * abs(x)) FILTER (side = -1) / sum(abs(x)) FILTER (side = -1) AS sv FROM side GROUP BY 1, 2""", "side")


@query("m1_long_short", sql(f"SELECT CAST(date AS VARCHAR) AS date, factor, {rd('l - s')} AS factor_return FROM legr", "legr"))
def m1(t):
    return rounded(M.long_short(pairs(t)).select(day(), "factor", "factor_return"))


@query("m1_long_short_value_weighted", sql(f"SELECT CAST(date AS VARCHAR) AS date, factor, {rd('lv - sv')} AS factor_return FROM legr", "legr"))
def m1v(t):
    return rounded(M.long_short(pairs(t), weighting="value").select(day(), "factor", "factor_return"))


part("mk", "SELECT date, avg(fwd) AS m FROM fwd WHERE fwd IS NOT NULL GROUP BY 1", "fwd")


@query("m2_beta_neutral", sql(f"""SELECT CAST(date AS VARCHAR) AS date, factor, {rd('l - h * s')} AS factor_return FROM legr JOIN
  (SELECT factor, covar_samp(l, m) / covar_samp(s, m) AS h FROM legr JOIN mk USING (date) GROUP BY 1) USING (factor)""", "legr", "mk"))
def m2(t):
    return rounded(M.beta_neutral(pairs(t), t.market).select(day(), "factor", "factor_return"))


@query("m3_factor_correlation", sql(f"""SELECT a.factor AS factor_i, b.factor AS factor_j, {rd('corr(a.l - a.s, b.l - b.s)')} AS corr FROM legr a JOIN legr b USING (date) GROUP BY 1, 2""", "legr"))
def m3(t):
    return rounded(M.factor_correlation(M.long_short(pairs(t))))


part("qp", """SELECT factor, date, avg(fwd) FILTER (b = 1) AS q1, avg(fwd) FILTER (b = 2) AS q2, avg(fwd) FILTER (b = 3) AS q3, avg(fwd) FILTER (b = 4) AS q4, avg(fwd) FILTER (b = 5) AS q5 FROM (
  SELECT *, CASE WHEN n >= 5 THEN greatest(1, ((rn - 1) * 5 + n - 2) // (n - 1)) END AS b FROM legs) GROUP BY 1, 2""", "legs")


@query("m4_quantile_portfolios", sql(f"SELECT CAST(date AS VARCHAR) AS date, factor, {rd('q1')} AS q1, {rd('q2')} AS q2, {rd('q3')} AS q3, {rd('q4')} AS q4, {rd('q5')} AS q5, {rd('q5 - q1')} AS spread FROM qp", "qp"))
def m4(t):
    return rounded(M.quantile_portfolios(pairs(t)).select(day(), "factor", "q1", "q2", "q3", "q4", "q5", "spread"))


@query("m4_spread_summary", sql(f"""SELECT factor, {rd('252 * m')} AS annualized_mean, {rd('m / (s / sqrt(n))')} AS t_stat, {rd('m * sqrt(252) / s')} AS sharpe
  FROM (SELECT factor, count(q5 - q1) AS n, avg(q5 - q1) AS m, stddev_samp(q5 - q1) AS s FROM qp GROUP BY 1)""", "qp"))
def m4s(t):
    return rounded(M.spread_summary(M.quantile_portfolios(pairs(t))))


# Folds

part("rf", "SELECT CAST(i AS INTEGER) AS fold, n_dates AS t FROM (SELECT max(n_dates) AS n_dates FROM ax), range(0, 40) r(i) WHERE i < (n_dates - 36) // 6", "ax")
part("rfolds", """SELECT fold, 'train' AS role, idx, date FROM rf JOIN ax ON idx BETWEEN fold * 6 + 1 AND fold * 6 + 36
  UNION ALL SELECT fold, 'test', idx, date FROM rf JOIN ax ON idx BETWEEN fold * 6 + 37 AND least(fold * 6 + 48, t)""", "rf", "ax")


@query("o1_rolling_folds", sql("SELECT fold, role, idx, CAST(date AS VARCHAR) AS date FROM rfolds", "rfolds"))
def o1(t):
    return O.rolling_folds(t.panel).select("fold", "role", "idx", day())


part("blk", "SELECT idx - 1 AS i, date, least((idx - 1) // (n_dates // 6), 5) AS b, n_dates AS t FROM ax", "ax")
part("combo", "SELECT row_number() OVER (ORDER BY a, b) - 1 AS fold, a, b FROM (SELECT x.i AS a, y.i AS b FROM range(6) x(i), range(6) y(i) WHERE x.i < y.i)")
part("cp", """SELECT fold, CASE WHEN blk.b IN (c.a, c.b) THEN 'test' WHEN NOT EXISTS (SELECT 1 FROM blk o WHERE o.b IN (c.a, c.b) AND abs(o.i - blk.i) <= 2)
  AND NOT EXISTS (SELECT 1 FROM (SELECT b, max(i) AS last FROM blk GROUP BY 1) o WHERE o.b IN (c.a, c.b) AND blk.i BETWEEN o.last + 1 AND o.last + 4) THEN 'train' END AS role,
  blk.b AS block, i + 1 AS idx, date FROM combo c, blk""", "blk", "combo")


def cpcv(t):
    return O.combinatorial_folds(t.panel, 6, 2, 2, 4)


@query("o2_combinatorial_folds", sql("SELECT fold, role, block, idx, CAST(date AS VARCHAR) AS date FROM cp WHERE role IS NOT NULL", "cp"))
def o2(t):
    return cpcv(t).select("fold", "role", "block", "idx", day())


part("oos", """SELECT fold, factor, mean_ic, mean_spread FROM (SELECT fold, factor, avg(ic) AS mean_ic FROM rfolds JOIN ic USING (date) WHERE role = 'test' GROUP BY 1, 2) FULL JOIN
  (SELECT fold, factor, avg(spread) AS mean_spread FROM rfolds JOIN spr USING (date) WHERE role = 'test' GROUP BY 1, 2) USING (fold, factor)""", "rfolds", "ic", "spr")


def oos(t):
    p = cut(pairs(t))
    return O.out_of_sample(V.rank_ic(p).where("ic is not null"), V.quantile_spread(p), O.rolling_folds(t.panel))


@query("o3_out_of_sample", sql(f"SELECT fold, factor, {rd('mean_ic')} AS mean_ic, {rd('mean_spread')} AS mean_spread FROM oos", "oos"))
def o3(t):
    return rounded(oos(t))


@query("o3_out_of_sample_summary", sql(f"SELECT factor, {rd('avg(mean_ic)')} AS mean_oos_ic, {rd('coalesce(avg(mean_ic) / nullif(stddev_samp(mean_ic), 0), 0)')} AS icir FROM oos GROUP BY 1", "oos"))
def o3s(t):
    return rounded(O.out_of_sample_summary(oos(t)))


# Alpha

PREMIA = {"market": 0.05, "value": 0.03, "momentum": 0.04, "profitability": 0.02}


@query("a1_expected_returns", sql(f"""SELECT ticker, {rd("0.01 + 0.05 * coalesce(max(CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 5 <> 0 THEN -beta END), 1) + sum(CASE grp WHEN 'value' THEN 0.03 WHEN 'momentum' THEN 0.04 WHEN 'profitability' THEN 0.02 ELSE 0 END * coalesce(score, 0))")} AS expected
  FROM gs LEFT JOIN pf USING (ticker) GROUP BY 1""", "gs", "pf"))
def a1(t):
    from panelwright.catalog.factors_q import YEAR
    from panelwright.operators.factors import price_factors

    betas = price_factors(t.panel, YEAR).select("ticker", (-F.col("beta")).alias("beta")).where(F.substring("ticker", 2, 20).cast("long") % 5 != 0)
    return rounded(A.expected_returns(groups(t), betas, PREMIA, 0.01))


@query("a2_gross_alpha", sql(f"SELECT factor, {rd('avg(l - s) + 0.4 * 10 / 10000')} AS gross_alpha FROM legr GROUP BY 1", "legr"))
def a2(t):
    rows = M.long_short(pairs(t)).groupBy("factor").agg(F.avg("factor_return").alias("net_alpha"), F.lit(0.4).alias("avg_turnover"))
    return rounded(A.gross_alpha(rows).select("factor", "gross_alpha"))


def top_weights(t):
    """Monthly equal weights of the 20 best momentum names."""
    s = t.score_history.where("factor = 'momentum_12_1' and x is not null")
    w = Window.partitionBy("date").orderBy(F.col("x").desc(), "ticker")
    top = s.withColumn("rn", F.row_number().over(w)).where("rn <= 20")
    return top.select(F.col("date").alias("as_of"), F.col("ticker").alias("asset"), (F.col("rn") / 210.0).alias("w"))


part("tw20", "SELECT date, ticker, rn / 210.0 AS w FROM momrk WHERE rn <= 20", "momrk")
part("dk", "SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM tw20)", "tw20")
part("twk", "SELECT k, ticker, w FROM tw20 JOIN dk USING (date)", "tw20", "dk")
part("turn", """SELECT k, sum(abs(coalesce(w1, 0) - coalesce(w0, 0))) / 2 AS turnover FROM (SELECT coalesce(a.k, b.k + 1) AS k, a.w AS w1, b.w AS w0 FROM twk a
  FULL JOIN twk b ON a.ticker = b.ticker AND a.k = b.k + 1) WHERE k BETWEEN 2 AND (SELECT max(k) FROM dk) GROUP BY 1""", "twk", "dk")


@query("a3_net_alpha", sql(f"""SELECT {rd('g')} AS gross_alpha, {rd('tn')} AS avg_turnover, {rd('tn * 10 / 10000')} AS total_cost, {rd('g - tn * 10 / 10000')} AS net_alpha, {rd('(g - tn * 10 / 10000) / v')} AS net_icir
  FROM (SELECT avg(ic) * sqrt(252) AS g, stddev_samp(ic) * sqrt(252) AS v FROM ic WHERE factor = 'momentum_12_1'), (SELECT avg(turnover) AS tn FROM turn)""", "ic", "turn"))
def a3(t):
    return rounded(A.net_alpha(ics(t).where("factor = 'momentum_12_1'"), top_weights(t)))


@query("a4_factor_premia", sql(f"SELECT factor, {rd('avg(l - s) * 252')} AS premium FROM legr GROUP BY 1", "legr"))
def a4(t):
    return rounded(A.factor_premia(M.long_short(pairs(t))))


part("vb", "SELECT factor, ticker, x FROM sh WHERE date = (SELECT max(date) FROM sh) AND x IS NOT NULL AND ticker IN (SELECT ticker FROM investable)", "sh", "investable")


@query("a5_view_baskets", sql(f"""SELECT factor, ticker, leg, {rd('abs(premium)')} AS confidence FROM (SELECT factor, ticker, unnest(list_filter([CASE WHEN x >= hi THEN 'top' END, CASE WHEN x <= lo THEN 'bottom' END], lambda v: v IS NOT NULL)) AS leg
  FROM vb JOIN (SELECT factor, quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi FROM vb GROUP BY 1 HAVING count(*) >= 4) USING (factor))
  JOIN (SELECT factor, avg(l - s) * 252 AS premium FROM legr GROUP BY 1) USING (factor)""", "vb", "legr"))
def a5(t):
    from panelwright.catalog.universe_q import investable

    s = t.score_history
    s = attach_one(s, s.agg(F.max("date").alias("_last"))).where("date = _last").select("factor", "ticker", "x")
    return rounded(A.view_baskets(s, A.factor_premia(M.long_short(pairs(t))), investable(t)))


BOUNDS = {f: (-0.2, 0.2) for f in FACTOR_GROUPS}
BOUNDS["dividend_yield"] = (0.01, 0.2)


@query("a6_exposure_rows", sql(f"""SELECT factor, 'lower' AS row, ticker, {rd('-x')} AS a, CAST(CASE WHEN factor = 'dividend_yield' THEN -0.01 ELSE 0.2 END AS DOUBLE) AS b FROM alls
  UNION ALL SELECT factor, 'upper', ticker, {rd("x")}, CAST(0.2 AS DOUBLE) FROM alls""", "alls"))
def a6(t):
    return rounded(A.exposure_rows(all_standardized(t), BOUNDS))


@query("a6_exposure_check", sql(f"SELECT factor, {rd('avg(x)')} AS exposure, avg(x) >= CASE WHEN factor = 'dividend_yield' THEN 0.01 ELSE -0.2 END AND avg(x) <= 0.2 AS feasible FROM alls GROUP BY 1", "alls"))
def a6_check(t):
    return rounded(A.exposure_check(all_standardized(t), BOUNDS))
