"""Panels, fundamentals, statements, macro rows and summaries."""

from pyspark.sql import functions as F

from panelwright.catalog.base import query, part, rd, sql
from panelwright.functions.columns import rounded
from panelwright.sources import panel as P
from panelwright.sources.tables import STATEMENT_ITEMS


def day(name="date"):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def lines_as_history(t):
    """Price rows per instrument (brand and supplier pair); several instruments share a ticker."""
    line = t.raw("lineitem").groupBy(
        "l_suppkey", "l_linenumber", F.to_date(F.date_trunc("month", "l_shipdate")).alias("date")
    ).agg(F.sum("l_extendedprice").alias("e"), F.sum("l_quantity").alias("volume"))
    return line.select(
        (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("instrument_id"),
        "date",
        F.when(F.col("volume") % 7 != 0, F.col("e") / F.col("volume")).alias("close"),
        "volume",
    )


def instruments(t):
    """Seven instruments per supplier; every eleventh supplier is delisted, every 13th has no ticker."""
    s = t.raw("supplier").select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k"))
    return s.select(
        (F.col("s_suppkey") * 10 + F.col("k")).alias("instrument_id"),
        F.when(F.col("s_suppkey") % 13 == 0, F.lit(" ")).otherwise(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).alias("ticker"),
        F.when(F.col("s_suppkey") % 11 == 0, F.to_date(F.lit("2000-06-30"))).alias("delisted_at"),
    )


part("hist", """SELECT l_suppkey * 10 + l_linenumber AS instrument_id, l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  CASE WHEN CAST(sum(l_quantity) AS BIGINT) % 7 <> 0 THEN sum(l_extendedprice) / sum(l_quantity) END AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY l_suppkey, l_linenumber, 3""")
part("panel1", """SELECT date, 'S' || CAST(l_suppkey AS VARCHAR) AS ticker, arg_min(close, instrument_id) FILTER (close IS NOT NULL) AS close,
  arg_min(volume, instrument_id) AS volume FROM hist WHERE l_suppkey % 13 <> 0 GROUP BY 1, 2""", "hist")


@query("s1_price_panel", sql(f"SELECT CAST(date AS VARCHAR) AS date, ticker, {rd('close')} AS close, {rd('volume')} AS volume FROM panel1", "panel1"))
def s1(t):
    return rounded(P.price_panel(lines_as_history(t), instruments(t)).select(day(), "ticker", "close", "volume"))


@query("s1_listed_only_panel", sql(f"""SELECT ticker, count(*) AS n_rows, {rd('sum(close)')} AS sum_close FROM panel1
  WHERE CAST(substr(ticker, 2) AS BIGINT) % 11 <> 0 GROUP BY 1""", "panel1"))
def s1_listed(t):
    p = P.price_panel(lines_as_history(t), instruments(t), include_delisted=False)
    return rounded(p.groupBy("ticker").agg(F.count("*").alias("n_rows"), F.sum("close").alias("sum_close")))


def delistings(t):
    l = t.listing
    return l.where(F.col("instrument_id") % 4 == 0).select(
        "ticker",
        F.date_add(F.lit("2000-01-01").cast("date"), F.when(F.col("instrument_id") % 8 == 0, 0).otherwise(14)).alias("delisted_at"),
        F.when(F.col("instrument_id") % 12 == 0, F.lit(-0.5)).alias("delisting_return"),
    )


part("delist", """SELECT ticker, DATE '2000-01-01' + CASE WHEN instrument_id % 8 = 0 THEN 0 ELSE 14 END AS delisted_at,
  CASE WHEN instrument_id % 12 = 0 THEN -0.5 END AS delisting_return FROM listing WHERE instrument_id % 4 = 0""", "listing")


@query("s2_delisting_price", sql(f"""SELECT CAST(date AS VARCHAR) AS date, ticker, {rd('close')} AS close FROM (
  SELECT date, ticker, close FROM px UNION ALL
  SELECT delisted_at, ticker, lc * (1 + coalesce(delisting_return, -0.3)) FROM (
    SELECT ticker, delisted_at, delisting_return, arg_max(close, date) AS lc FROM px JOIN delist USING (ticker) WHERE date <= delisted_at GROUP BY ALL) d
  WHERE NOT EXISTS (SELECT 1 FROM px WHERE px.ticker = d.ticker AND px.date = d.delisted_at))""", "px", "delist"))
def s2(t):
    return rounded(P.append_delisting_prices(t.panel, delistings(t)).select(day(), "ticker", "close"))


def gappy_fundamentals(t):
    """Fundamentals with some nulls and without every seventh ticker, so statements have work to do."""
    n = F.substring("ticker", 2, 20).cast("long")
    return t.fundamentals.where(n % 7 != 0).select(
        "ticker", "sector", F.when(n % 3 != 0, F.col("total_assets")).alias("total_assets"), F.when(n % 2 == 0, F.col("net_income")).alias("net_income")
    )


part("li", """SELECT ticker, line_item, arg_max(value, period_date) AS v FROM stm WHERE period_type = 'annual' GROUP BY 1, 2""", "stm")
part("liw", """SELECT ticker, max(v) FILTER (line_item = 'Total Assets') AS ta, max(v) FILTER (line_item = 'Net Income') AS ni,
  max(v) FILTER (line_item = 'Gross Profit') AS gp, max(v) FILTER (line_item = 'Operating Income') AS oi,
  max(v) FILTER (line_item = 'Stockholders Equity') AS te FROM li GROUP BY 1""", "li")


@query("s3_statement_fill", sql(f"""SELECT coalesce(f.ticker, liw.ticker) AS ticker, sector, {rd('coalesce(f.total_assets, ta)')} AS total_assets,
  {rd('coalesce(f.net_income, ni)')} AS net_income, {rd('gp')} AS gross_profit, {rd('oi')} AS operating_income, {rd('te')} AS total_equity
  FROM (SELECT ticker, sector, CASE WHEN n % 3 <> 0 THEN total_assets END AS total_assets, CASE WHEN n % 2 = 0 THEN net_income END AS net_income
    FROM (SELECT *, CAST(substr(ticker, 2) AS BIGINT) AS n FROM fund) WHERE n % 7 <> 0) f FULL JOIN liw ON f.ticker = liw.ticker""", "fund", "liw"))
def s3(t):
    return rounded(P.fill_from_statements(gappy_fundamentals(t), t.statements, STATEMENT_ITEMS))


part("growth", """SELECT ticker, (a0 - a1) / abs(a1) AS asset_growth FROM (SELECT ticker, max(value) FILTER (rn = 1) AS a0, max(value) FILTER (rn = 2) AS a1
  FROM (SELECT ticker, value, row_number() OVER (PARTITION BY ticker ORDER BY period_date DESC) AS rn FROM stm
    WHERE period_type = 'annual' AND line_item = 'Total Assets') GROUP BY 1) WHERE a1 <> 0""", "stm")


@query("s4_asset_growth", sql(f"SELECT ticker, {rd('asset_growth')} AS asset_growth FROM growth", "growth"))
def s4(t):
    return rounded(P.asset_growth(t.statements))


@query("s5_fundamentals", sql(f"""SELECT f.ticker, f.sector, {rd('f.market_cap')} AS market_cap, {rd('f.current_price')} AS current_price
  FROM fund f JOIN listing l USING (ticker) WHERE l.instrument_id % 13 <> 0""", "fund", "listing"))
def s5(t):
    profiles = t.fundamentals.withColumn("instrument_id", F.explode(F.array(*[F.substring("ticker", 2, 20).cast("long") * 10 + k for k in (1, 2, 3)])))
    return rounded(P.fundamentals_table(profiles.drop("ticker"), instruments(t), ["sector", "market_cap", "current_price"]))


@query("s6_analyst_counts", sql("""SELECT ticker, CAST(period AS VARCHAR) AS period, strong_buy, buy,
  CASE WHEN hold > 0 THEN hold ELSE 0 END AS hold, sell FROM ratings WHERE CAST(substr(ticker, 2) AS BIGINT) % 13 <> 0""", "ratings"))
def s6(t):
    rows = t.ratings.select(
        (F.substring("ticker", 2, 20).cast("long") * 10 + 1).alias("instrument_id"), day("period"), "strong_buy", "buy",
        F.when(F.col("hold") > 0, F.col("hold")).alias("hold"), "sell",
    )
    return P.keyed_by_ticker(rows, instruments(t), ["strong_buy", "buy", "hold", "sell"])


@query("s7_macro_row", sql(f"""SELECT country, {rd('gdp_growth')} AS gdp_growth, {rd('sr')} AS short_rate, {rd('coalesce(lr, y10)')} AS long_rate,
  {rd('coalesce(lr, y10) - sr')} AS yield_spread FROM (
    SELECT country, arg_max(gdp_growth, date) FILTER (gdp_growth IS NOT NULL) AS gdp_growth, arg_max(unemployment_rate, date) AS sr,
    arg_max(CASE WHEN yield_spread > 0.5 THEN yield_spread + 25 END, date) FILTER (yield_spread > 0.5) AS lr FROM macro WHERE country <> 'ASIA' GROUP BY 1) a
  FULL JOIN (SELECT country, arg_max(yield_spread + 22, date) AS y10 FROM macro GROUP BY 1) b USING (country)
  WHERE country <> 'ASIA' UNION ALL
  SELECT country, NULL, {rd('arg_max(unemployment_rate, date)')}, {rd('arg_max(yield_spread + 22, date)')}, {rd('arg_max(yield_spread + 22, date) - arg_max(unemployment_rate, date)')}
  FROM macro WHERE country = 'ASIA' GROUP BY 1""", "macro"))
def s7(t):
    m = t.macro
    ind = m.where("country <> 'ASIA'").select(
        "country", F.col("date").alias("reference_date"), "gdp_growth", F.col("unemployment_rate").alias("short_rate"),
        F.when(F.col("yield_spread") > 0.5, F.col("yield_spread") + 25).alias("long_rate"),
    )
    bonds = m.select(
        "country", F.col("date").alias("reference_date"),
        F.explode(F.create_map(F.lit("2Y"), F.col("unemployment_rate"), F.lit("10Y"), F.col("yield_spread") + 22)).alias("maturity", "yield"),
    )
    return rounded(P.macro_row(ind, bonds))


@query("s8_dataset_summary", sql("""SELECT 'tickers' AS item, count(DISTINCT ticker) AS n FROM px UNION ALL SELECT 'trading_days', count(DISTINCT date) FROM px
  UNION ALL SELECT 'sectors', count(DISTINCT sector) FROM fund UNION ALL SELECT 'rows_panel', count(*) FROM px UNION ALL SELECT 'rows_fundamentals', count(*) FROM fund
  UNION ALL SELECT 'rows_statements', count(*) FROM stm UNION ALL SELECT 'rows_insider', count(*) FROM insider""", "px", "fund", "stm", "insider"))
def s8(t):
    return P.dataset_summary(t.panel, t.fundamentals, {"statements": t.statements, "insider": t.insider})


@query("s14_range_read", sql(f"""SELECT instrument_id, CAST(date AS VARCHAR) AS date, {rd('close')} AS close FROM (
  SELECT * FROM hist WHERE instrument_id = 11 AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' ORDER BY date DESC LIMIT 20)""", "hist"))
def s14(t):
    return rounded(P.range_read(lines_as_history(t), 11, "1996-01-01", "2000-12-31", 20).select("instrument_id", day(), "close"))
