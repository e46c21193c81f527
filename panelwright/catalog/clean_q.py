"""Returns, cleaning, imputation and pre-selection."""

from pyspark.sql import functions as F

from panelwright.catalog.base import part, query, rd, sql
from panelwright.catalog.sources_q import day, delistings
from panelwright.config import CleaningConfig
from panelwright.functions.columns import rounded
from panelwright.operators import clean as C
from panelwright.sources import panel as P

DR = f"CAST(date AS VARCHAR) AS date, ticker, {rd('r')} AS r"


def out(df):
    return rounded(df.select(day(), "ticker", "r"))


def sectors(t):
    """Every ninth name has no sector."""
    return t.listing.where(F.col("instrument_id") % 9 != 0).select("ticker", "sector")


part("sec", "SELECT ticker, sector FROM listing WHERE instrument_id % 9 <> 0", "listing")


def raw_returns(t):
    """Returns with a few broken values, as a feed would deliver them."""
    n = F.substring("ticker", 2, 20).cast("long") + F.month("date")
    r = F.when(n % 37 == 0, F.lit(float("inf"))).when(n % 41 == 0, F.lit(float("nan"))).when(n % 43 == 0, F.lit(-12.5)).otherwise(F.col("r"))
    return t.returns.withColumn("r", r)


part("rawret", """SELECT date, ticker, idx, n_dates, CASE WHEN n % 37 = 0 OR n % 41 = 0 OR n % 43 = 0 THEN NULL ELSE r END AS r FROM
  (SELECT *, CAST(substr(ticker, 2) AS BIGINT) + month(date) AS n FROM ret)""", "ret")
part("valid", "SELECT date, ticker, idx, n_dates, CASE WHEN abs(r) <= 10 THEN r END AS r FROM rawret", "rawret")


@query("p1_simple_returns", sql(f"SELECT {DR} FROM ret", "ret"))
def p1(t):
    return out(t.returns)


@query("p1_log_returns", sql(f"SELECT CAST(date AS VARCHAR) AS date, ticker, {rd('ln(1 + r)')} AS r FROM ret", "ret"))
def p1_log(t):
    return out(P.simple_returns(t.panel, log=True))


@query("p2_validate", sql(f"SELECT {DR} FROM valid", "valid"))
def p2(t):
    return out(C.validate(raw_returns(t)))


part("ostat", "SELECT ticker, avg(r) AS m, stddev_samp(r) AS s FROM valid WHERE idx <= 60 GROUP BY 1", "valid")
part("treated", """SELECT date, ticker, idx, n_dates, CASE WHEN r IS NULL OR s IS NULL OR s = 0 THEN r WHEN abs(r - m) / s >= 2.5 THEN NULL
  WHEN abs(r - m) / s >= 2 THEN least(greatest(r, m - 2 * s), m + 2 * s) ELSE r END AS r FROM valid LEFT JOIN ostat USING (ticker)""", "valid", "ostat")


def treated(t):
    v = C.validate(raw_returns(t))
    return C.treat_outliers(v, C.outlier_stats(v.where("idx <= 60")), 2.0, 2.5)


@query("p3_outliers", sql(f"SELECT {DR} FROM treated", "treated"))
def p3(t):
    return out(treated(t))


part("cells", """SELECT c.date, c.ticker, coalesce(sector, '') AS sector, t.r FROM (SELECT date, ticker FROM (SELECT DISTINCT date FROM treated), (SELECT DISTINCT ticker FROM treated)) c
  LEFT JOIN treated t ON t.date = c.date AND t.ticker = c.ticker LEFT JOIN sec ON sec.ticker = c.ticker""", "treated", "sec")
part("imputed", """SELECT date, ticker, coalesce(r, avg(r) OVER (PARTITION BY date, sector), avg(r) OVER (PARTITION BY date)) AS r FROM cells""", "cells")


@query("p4_sector_imputation", sql(f"SELECT {DR} FROM imputed", "imputed"))
def p4(t):
    return out(C.impute_by_sector(treated(t), sectors(t)))


def brand_gaps(t):
    """Weekly brand returns with every 29th cell missing."""
    n = F.substring("ticker", 7, 9).cast("long") + F.datediff("date", F.lit("1995-01-02")) / 7
    return t.weekly_returns.withColumn("r", F.when(n.cast("long") % 29 != 0, F.col("r")))


def brand_sectors(t):
    brands = t.raw("part").select(F.col("p_brand").alias("ticker")).distinct()
    return brands.withColumn("sector", F.substring("ticker", 1, 7))


@query("p5_regression_imputation")
def p5(t):
    r = brand_gaps(t)
    return out(C.impute_by_regression(r, r, brand_sectors(t)))


@query("p6_delisting_return", sql(f"""SELECT CAST(date AS VARCHAR) AS date, ticker, {rd('''CASE WHEN d.ticker IS NOT NULL AND date = last_date THEN dr ELSE r END''')} AS r
  FROM (SELECT *, max(date) FILTER (r IS NOT NULL) OVER (PARTITION BY ticker) AS last_date FROM ret) LEFT JOIN
  (SELECT ticker, coalesce(delisting_return, -0.3) AS dr FROM delist) d USING (ticker)""".replace("d.ticker", "dr"), "ret", "delist"))
def p6(t):
    d = delistings(t).withColumn("delisting_return", F.coalesce("delisting_return", F.lit(-0.3)))
    return out(C.apply_delisting_returns(t.returns, d))


@query("p7_complete_assets", sql("SELECT ticker FROM ret WHERE idx > 1 GROUP BY 1 HAVING count(r) = (SELECT max(n_dates) - 1 FROM ret)", "ret"))
def p7(t):
    return C.complete_assets(t.returns.where("idx > 1"))


@query("p8_varying_assets", sql("SELECT ticker FROM ret GROUP BY 1 HAVING var_samp(r) > 0.32", "ret"))
def p8(t):
    return C.varying_assets(t.returns, 0.32)


@query("p9_drop_correlated")
def p9(t):
    return C.correlated_assets(t.weekly_returns, 0.05)


@query("p10_best_assets", sql("SELECT ticker FROM (SELECT ticker, avg(r) AS m FROM ret GROUP BY 1) ORDER BY m DESC, ticker LIMIT 15", "ret"))
def p10(t):
    return C.best_assets(t.returns, 15)


part("msd", "SELECT ticker, avg(r) AS mean, stddev_samp(r) AS sd FROM ret GROUP BY 1", "ret")


@query("p11_pareto_front", sql(f"""SELECT ticker, {rd('mean')} AS mean, {rd('sd')} AS sd FROM msd a WHERE NOT EXISTS
  (SELECT 1 FROM msd b WHERE b.mean >= a.mean AND b.sd <= a.sd AND (b.mean > a.mean OR b.sd < a.sd))""", "msd"))
def p11(t):
    return rounded(C.pareto_front(C.mean_sd_points(t.returns)))


@query("p12_not_expiring", sql("""SELECT ticker FROM listing WHERE instrument_id % 5 = 0 OR DATE '2001-11-01' + CAST(instrument_id % 60 AS INTEGER) > DATE '2001-12-01'""", "listing"))
def p12(t):
    exp = t.listing.where("instrument_id % 5 <> 0").select("ticker", F.date_add(F.lit("2001-11-01").cast("date"), (F.col("instrument_id") % 60).cast("int")).alias("expiry"))
    return C.not_expiring(t.listing.select("ticker"), exp, "2001-11-01", 30)


part("tr_stat", "SELECT ticker, avg(r) AS m, stddev_samp(r) AS s FROM ret WHERE idx BETWEEN 2 AND 60 AND abs(r) <= 10 GROUP BY 1", "ret")
part("tr_all", """SELECT date, ticker, idx, CASE WHEN abs(r) > 10 OR r IS NULL THEN NULL WHEN abs(r - m) / s >= 10 THEN NULL
  WHEN abs(r - m) / s >= 3 THEN least(greatest(r, m - 3 * s), m + 3 * s) ELSE r END AS r FROM ret LEFT JOIN tr_stat USING (ticker) WHERE idx > 1""", "ret", "tr_stat")
part("tr_cells", """SELECT c.date, c.idx, c.ticker, coalesce(sector, '') AS sector, t.r FROM
  (SELECT date, idx, ticker FROM (SELECT DISTINCT date, idx FROM tr_all), (SELECT DISTINCT ticker FROM tr_all)) c
  LEFT JOIN tr_all t ON t.date = c.date AND t.ticker = c.ticker LEFT JOIN sec ON sec.ticker = c.ticker""", "tr_all", "sec")
part("tr_imp", "SELECT date, idx, ticker, coalesce(r, avg(r) OVER (PARTITION BY date, sector), avg(r) OVER (PARTITION BY date)) AS r FROM tr_cells", "tr_cells")
part("tr_pick", """SELECT ticker FROM tr_imp WHERE idx <= 60 GROUP BY 1 HAVING count(r) = 59 AND var_samp(r) > 1e-8 ORDER BY avg(r) DESC, ticker LIMIT 20""", "tr_imp")


def pre_selected(t, config=CleaningConfig(top_k=20)):
    r = t.returns.where("idx > 1")
    return C.fit_pre_selection(r.where("idx <= 60"), sectors(t), config), r


@query("p13_pre_selection", sql(f"SELECT {DR} FROM tr_imp WHERE idx > 60 AND ticker IN (SELECT ticker FROM tr_pick)", "tr_imp", "tr_pick"))
def p13(t):
    fitted, r = pre_selected(t)
    return out(fitted.transform(r.where("idx > 60")))


@query("p14_survivorship_flag", sql("""SELECT coalesce(max(n_dates) >= 12, false) AND NOT coalesce(bool_or(abs(r) <= 1e-10 AND idx > n_dates - 12), false) AS suspected FROM ret""", "ret"))
def p14(t):
    return C.no_terminal_zero_returns(t.returns)
