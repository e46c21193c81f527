"""Screens, instrument filters and the ordered rule check."""

from pyspark.sql import functions as F

from panelwright.catalog.base import part, query, rd, sql
from panelwright.config import Band, InstrumentRules, LiquidityTier, ScreenConfig
from panelwright.functions.columns import rounded
from panelwright.operators import universe as U

def num():
    return F.substring("ticker", 2, 20).cast("long")


SQLNUM = "CAST(substr(ticker, 2) AS BIGINT)"


def members(t):
    """Every third supplier is a current member."""
    return t.listing.where(F.col("instrument_id") % 3 == 0).select("ticker")


part("mem", "SELECT ticker FROM listing WHERE instrument_id % 3 = 0", "listing")
part("fm", "SELECT fund.*, ticker IN (SELECT ticker FROM mem) AS m FROM fund", "fund", "mem")
CAP = Band(32_500_000, 31_500_000)


@query("u1_hysteresis_screen", sql(f"""SELECT ticker, {rd('market_cap')} AS market_cap FROM fm
  WHERE market_cap >= 32500000 OR (m AND market_cap >= 31500000)""", "fm"))
def u1(t):
    return rounded(U.screen(t.fundamentals.select("ticker", "market_cap"), "market_cap", CAP, members(t)))


@query("u2_dollar_volume", sql(f"SELECT ticker, {rd('avg(close * volume)')} AS addv FROM pxi WHERE idx > n_dates - 12 GROUP BY 1", "pxi"))
def u2(t):
    return rounded(U.average_dollar_volume(t.panel, 12))


@query("u3_trading_frequency", sql(f"""SELECT ticker, {rd('count(*) FILTER (idx > n_dates - 24 AND volume > 0) / max(least(n_dates, 24))')} AS frequency
  FROM pxi GROUP BY 1""", "pxi"))
def u3(t):
    return rounded(U.trading_frequency(t.panel, 24))


@query("u4_listing_age", sql("SELECT ticker, count(close) AS age FROM px GROUP BY 1", "px"))
def u4(t):
    return U.listing_age(t.panel)


@query("u5_statement_count", sql("""SELECT ticker, count(*) AS n_statements FROM stw WHERE period_type = 'quarterly'
  AND period_date >= (SELECT max(period_date) FROM stw WHERE period_type = 'quarterly') - INTERVAL 730 DAY GROUP BY 1""", "stw"))
def u5(t):
    idx = t.statements.select("ticker", "period_type", "period_date").distinct()
    return U.statement_counts(idx, "quarterly", 730)


part("cuts", """SELECT exchange, CASE WHEN count(*) >= 10 THEN quantile_cont(market_cap, 0.10) ELSE 0 END AS en,
  CASE WHEN count(*) >= 10 THEN quantile_cont(market_cap, 0.075) ELSE 0 END AS ex FROM fund GROUP BY 1""", "fund")


@query("u6_cap_thresholds", sql(f"SELECT exchange, {rd('en')} AS entry_cut, {rd('ex')} AS exit_cut FROM cuts", "cuts"))
def u6(t):
    return rounded(U.cap_thresholds(t.fundamentals, {"entry_cut": 0.10, "exit_cut": 0.075}))


@query("u7_cap_percentile_screen", sql("SELECT ticker FROM fm JOIN cuts USING (exchange) WHERE market_cap >= en OR (m AND market_cap >= ex)", "fm", "cuts"))
def u7(t):
    caps = t.fundamentals.select("ticker", "exchange", "market_cap")
    return U.cap_percentile_screen(caps, Band(0.10, 0.075), members=members(t)).select("ticker")


SCREENS = ScreenConfig(
    market_cap=Band(31_000_000, 30_000_000), addv_long=Band(330_000, 320_000), addv_short=Band(260_000, 250_000),
    frequency=Band(0.95, 0.90), price_us=Band(1_000.0, 900.0), min_history=82, min_seasoning=60,
    min_annual=7, min_quarterly=28, window_long=12, window_short=3,
)
part("pstat", """SELECT ticker, avg(close * volume) FILTER (idx > n_dates - 12) AS a12, avg(close * volume) FILTER (idx > n_dates - 3) AS a3,
  count(*) FILTER (idx > n_dates - 12 AND volume > 0) / max(least(n_dates, 12)) AS freq, count(close) AS age FROM pxi GROUP BY 1""", "pxi")
part("stn", "SELECT ticker, count(*) FILTER (period_type = 'annual') AS na, count(*) FILTER (period_type = 'quarterly') AS nq FROM stw GROUP BY 1", "stw")
part("investable", """SELECT ticker FROM fm JOIN cuts USING (exchange) JOIN pstat USING (ticker) LEFT JOIN stn USING (ticker)
  WHERE (market_cap >= 31000000 OR (m AND market_cap >= 30000000)) AND (market_cap >= en OR (m AND market_cap >= ex))
  AND (a12 >= 330000 OR (m AND a12 >= 320000)) AND (a3 >= 260000 OR (m AND a3 >= 250000))
  AND (freq >= 0.95 OR (m AND freq >= 0.90)) AND (current_price >= 1000 OR (m AND current_price >= 900))
  AND age >= 82 AND (coalesce(na, 0) >= 7 OR coalesce(nq, 0) >= 28)""", "fm", "cuts", "pstat", "stn")


def investable(t):
    idx = t.statements.select("ticker", "period_type", "period_date").distinct()
    return U.investable(t.fundamentals, t.panel, idx, SCREENS, members(t))


@query("u8_investability", sql("SELECT ticker FROM investable", "investable"))
def u8(t):
    return investable(t)


RULES = InstrumentRules(
    min_price=2_000.0, max_price=9_000.0, min_market_cap=31_000_000, small_cap=32_000_000, large_cap=33_000_000,
    tiers={"large_cap": LiquidityTier(400_000, 180), "mid_cap": LiquidityTier(380_000, 170), "small_cap": LiquidityTier(350_000, 160)},
    min_history_rows=83,
)
CATEGORIES = {"cap": (("market_cap",), False), "price": (("current_price", "regular_price"), True),
              "yield": (("dividend_yield", "income_ratio"), True), "statement": (("total_assets", "income_ratio"), False)}


def quotes(t):
    """Instrument snapshot: some current prices are 0 (missing), some ratios null."""
    p = t.panel.groupBy("ticker").agg(
        F.avg("volume").alias("average_volume"), F.avg("close").alias("regular_price"), F.count("*").alias("n_rows")
    )
    return t.fundamentals.join(p, "ticker").select(
        "ticker", "market_cap", "dividend_yield", "total_assets", "average_volume", "n_rows",
        F.when(num() % 5 == 0, 0.0).otherwise(F.col("current_price")).alias("current_price"),
        F.when(num() % 10 != 0, F.col("regular_price")).alias("regular_price"),
        F.when(num() % 4 != 0, F.col("net_income") / F.col("total_assets")).alias("income_ratio"),
    )


part("quotes", f"""SELECT ticker, market_cap, dividend_yield, total_assets, v AS average_volume, n AS n_rows,
  CASE WHEN {SQLNUM} % 5 = 0 THEN 0.0 ELSE current_price END AS current_price, CASE WHEN {SQLNUM} % 10 <> 0 THEN c END AS regular_price,
  CASE WHEN {SQLNUM} % 4 <> 0 THEN net_income / total_assets END AS income_ratio
  FROM fund JOIN (SELECT ticker, avg(volume) AS v, avg(close) AS c, count(*) AS n FROM px GROUP BY 1) USING (ticker)""", "fund", "px")
part("reasons", """SELECT *, CASE WHEN p IS NULL THEN 'no price' WHEN p < 2000 THEN 'price below minimum' WHEN p > 9000 THEN 'price above maximum' END AS price_r,
  CASE WHEN market_cap < 31000000 THEN 'market cap below minimum' END AS cap_r,
  CASE WHEN p IS NULL THEN 'no price' WHEN average_volume * p < md THEN seg || ': dollar volume' WHEN average_volume < ms THEN seg || ': share volume' END AS liq_r,
  CASE WHEN len(miss) > 0 THEN 'missing ' || array_to_string(miss[1:3], ', ') || CASE WHEN len(miss) > 3 THEN ' +' || (len(miss) - 3) || ' more' ELSE '' END END AS cov_r,
  CASE WHEN n_rows < 83 THEN 'short history' END AS hist_r
  FROM (SELECT *, CASE seg WHEN 'large_cap' THEN 400000 WHEN 'mid_cap' THEN 380000 ELSE 350000 END AS md,
      CASE seg WHEN 'large_cap' THEN 180 WHEN 'mid_cap' THEN 170 ELSE 160 END AS ms FROM (
    SELECT *, coalesce(nullif(current_price, 0), regular_price) AS p,
    CASE WHEN market_cap >= 33000000 THEN 'large_cap' WHEN market_cap >= 32000000 THEN 'mid_cap' ELSE 'small_cap' END AS seg,
    list_filter([CASE WHEN market_cap IS NULL THEN 'cap' END, CASE WHEN current_price IS NULL AND regular_price IS NULL THEN 'price' END,
      CASE WHEN dividend_yield IS NULL AND income_ratio IS NULL THEN 'yield' END,
      CASE WHEN total_assets IS NULL OR income_ratio IS NULL THEN 'statement' END], lambda x: x IS NOT NULL) AS miss FROM quotes))""", "quotes")
RULE_SET = {"price": "price_r", "market_cap": "cap_r", "liquidity": "liq_r", "coverage": "cov_r", "history": "hist_r"}


def rule_columns():
    return {
        "price": U.price_reason(RULES), "market_cap": U.market_cap_reason(RULES), "liquidity": U.liquidity_reason(RULES),
        "coverage": U.coverage_reason(CATEGORIES), "history": U.history_reason(RULES),
    }


@query("u9_price_and_cap_filter", sql("SELECT ticker, price_r AS price_reason, cap_r AS cap_reason FROM reasons", "reasons"))
def u9(t):
    return quotes(t).select("ticker", U.price_reason(RULES).alias("price_reason"), U.market_cap_reason(RULES).alias("cap_reason"))


@query("u10_liquidity_filter", sql("SELECT ticker, seg AS segment, liq_r AS reason FROM reasons", "reasons"))
def u10(t):
    return quotes(t).select("ticker", U.cap_segment(RULES).alias("segment"), U.liquidity_reason(RULES).alias("reason"))


@query("u11_coverage_filter", sql("SELECT ticker, cov_r AS reason FROM reasons", "reasons"))
def u11(t):
    return quotes(t).select("ticker", U.coverage_reason(CATEGORIES).alias("reason"))


@query("u12_history_filter", sql("SELECT ticker FROM px GROUP BY 1 HAVING count(*) >= 83", "px"))
def u12(t):
    n = t.panel.groupBy("ticker").agg(F.count("*").alias("n_rows"))
    return n.where(U.history_reason(RULES).isNull()).select("ticker")


part("failed", "SELECT *, CASE " + " ".join(f"WHEN {c} IS NOT NULL THEN '{n}'" for n, c in RULE_SET.items()) + f""" END AS failed_rule,
  coalesce({', '.join(RULE_SET.values())}) AS reason FROM reasons""", "reasons")


@query("u13_first_failure", sql("SELECT ticker, failed_rule, reason FROM failed", "failed"))
def u13(t):
    return U.first_failure(quotes(t), rule_columns()).select("ticker", "failed_rule", "reason")


part("ats", "SELECT CASE failed_rule " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(RULE_SET, 1)) + " ELSE 6 END AS pos FROM failed", "failed")


@query("u13_rule_counts", sql("SELECT rule, passed, failed FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (pos > {i}) AS passed, count(*) FILTER (pos = {i}) AS failed, count(*) FILTER (pos >= {i}) AS seen FROM ats"
    for i, n in enumerate(RULE_SET, 1)) + ")", "ats"))
def u13_counts(t):
    return U.rule_counts(U.first_failure(quotes(t), rule_columns()), list(RULE_SET))


SUFFIXES = {"REGION_0": ".A", "REGION_1": "", "EUROPE": ".E", "ASIA": "", "AMERICA": ".US"}


@query("u14_exchange_stocks", sql("""SELECT r_name AS exchange, p_partkey AS instrument_id, replace(sym, '/', '-') AS symbol,
  CASE r_name WHEN 'EUROPE' THEN replace(sym, '/', '-') || '.E|' || replace(sym, '/', '-') WHEN 'AMERICA' THEN replace(sym, '/', '-') || '.US|' || replace(sym, '/', '-')
  ELSE replace(sym, '/', '-') END AS candidates
  FROM (SELECT *, 'P' || CAST(p_partkey AS VARCHAR) || '/' || CAST(p_size AS VARCHAR) AS sym FROM part WHERE p_size % 2 = 0) JOIN nation ON n_nationkey = p_partkey % 25
  JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('EUROPE', 'ASIA', 'AMERICA')"""))
def u14(t):
    exchanges = (
        t.raw("region").join(t.raw("nation"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("name"))
        .agg(F.collect_set(F.struct(F.col("n_nationkey").cast("long").alias("id"))).alias("schedules"))
    )
    items = t.raw("part").select(
        F.col("p_partkey").alias("instrument_id"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit("/"), F.col("p_size").cast("string")).alias("symbol"),
        F.when(F.col("p_size") % 2 == 0, "STOCK").otherwise("FUND").alias("type"),
        (F.col("p_partkey") % 25).alias("schedule_id"),
    )
    out = U.exchange_stocks(exchanges, items, ["EUROPE", "ASIA", "AMERICA"], SUFFIXES)
    return out.withColumn("candidates", F.array_join("candidates", "|"))
