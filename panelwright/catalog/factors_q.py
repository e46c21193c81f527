"""Factor construction and standardization."""

from pyspark.sql import functions as F

from panelwright.catalog.base import part, query, rd, sql
from panelwright.catalog.sources_q import day
from panelwright.config import FACTOR_GROUPS, FactorConfig, StandardizeConfig
from panelwright.functions.columns import rounded
from panelwright.functions.stats import CENTRE, MIDDLE, TAIL
from panelwright.operators import factors as X, standardize as Z
from panelwright.session import cut

YEAR = FactorConfig(lookback=12, skip=1, volatility_lookback=12, beta_lookback=12, amihud_lookback=12)

# Flagship

part("mom", """SELECT ticker, max(close) FILTER (idx = n_dates - 1) / max(close) FILTER (idx = n_dates - 11) - 1 AS x FROM pxi GROUP BY 1""", "pxi")
part("mom_z", """SELECT ticker, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS z FROM (SELECT ticker,
  CASE WHEN x IS NOT NULL THEN least(greatest(x, (SELECT quantile_cont(x, 0.01) FROM mom)), (SELECT quantile_cont(x, 0.99) FROM mom)) END AS y FROM mom)""", "mom")


@query("f13_momentum_top_picks", sql(f"""SELECT ticker, sector, {rd('s')} AS score FROM (SELECT ticker, sector, z - avg(z) OVER (PARTITION BY sector) AS s
  FROM mom_z JOIN listing USING (ticker)) WHERE s IS NOT NULL ORDER BY s DESC, ticker LIMIT 10""", "mom_z", "listing"))
def flagship(t):
    m = X.momentum(t.panel, 12, 1).select(F.lit("momentum_12_1").alias("factor"), "ticker", F.col("momentum_12_1").alias("x"))
    z = Z.standardize(m, ["factor"], StandardizeConfig(), t.listing)
    best = z.where("x is not null").orderBy(F.col("x").desc(), "ticker").limit(10)
    return rounded(best.join(t.listing.select("ticker", "sector"), "ticker").select("ticker", "sector", F.col("x").alias("score")))


# Point in time


def quarterly_wide(t):
    """Quarterly statements, one column per item; every third quarter lacks the income."""
    rows = t.statements.where("period_type = 'quarterly'").groupBy("ticker", "period_date").pivot("line_item", ["Total Assets", "Net Income"]).agg(F.first("value"))
    gone = (F.substring("ticker", 2, 20).cast("long") + F.quarter("period_date")) % 3 == 0
    return rows.select("ticker", "period_date", F.col("Total Assets").alias("assets"), F.when(~gone, F.col("Net Income")).alias("income"))


part("qwide", """SELECT ticker, period_date, a AS assets, CASE WHEN (CAST(substr(ticker, 2) AS BIGINT) + quarter(period_date)) % 3 <> 0 THEN b END AS income
  FROM stw WHERE period_type = 'quarterly'""", "stw")


@query("f1_point_in_time", sql(f"""SELECT ticker, CAST(max(period_date) AS VARCHAR) AS period_date, {rd('arg_max(assets, period_date)')} AS assets,
  {rd('arg_max(income, period_date) FILTER (income IS NOT NULL)')} AS income FROM qwide WHERE period_date <= DATE '2000-01-31' - 45 GROUP BY 1""", "qwide"))
def f1(t):
    return rounded(X.point_in_time(quarterly_wide(t), "2000-01-31", 45).select("ticker", day("period_date"), "assets", "income"))


@query("f1_point_in_time_all_months", sql(f"""SELECT CAST(ax.date AS VARCHAR) AS as_of, ticker, {rd('arg_max(assets, period_date)')} AS assets,
  {rd('arg_max(income, period_date) FILTER (income IS NOT NULL)')} AS income FROM ax JOIN qwide ON period_date + 45 <= ax.date GROUP BY ax.date, ticker""", "qwide", "ax"))
def f1_all(t):
    dates = t.panel.select(F.col("date").alias("as_of")).distinct()
    return rounded(X.point_in_time_dates(quarterly_wide(t), dates, 45).select(day("as_of"), "ticker", "assets", "income"))


# Ratios

part("fundg", "SELECT fund.*, asset_growth FROM fund LEFT JOIN growth USING (ticker)", "fund", "growth")
RATIO_SQL = {
    "book_to_price": "book_value / nullif(market_cap, 0)", "earnings_yield": "net_income / nullif(market_cap, 0)",
    "cash_flow_yield": "operating_cashflow / nullif(market_cap, 0)", "sales_to_price": "total_revenue / nullif(market_cap, 0)",
    "ebitda_to_ev": "ebitda / nullif(enterprise_value, 0)", "gross_profitability": "gross_profit / nullif(total_assets, 0)",
    "roe": "net_income / nullif(book_value, 0)", "operating_margin": "operating_income / nullif(total_revenue, 0)",
    "profit_margin": "net_income / nullif(total_revenue, 0)", "asset_growth": "-asset_growth", "dividend_yield": "coalesce(dividend_yield, 0)",
}


def with_growth(t):
    from panelwright.sources.panel import asset_growth

    return t.fundamentals.join(asset_growth(t.statements), "ticker", "left")


def _ratio(number, name):
    @query(f"f{number}_{name}", sql(f"SELECT ticker, {rd(RATIO_SQL[name])} AS {name} FROM fundg", "fundg"))
    def run(t):
        source = with_growth(t) if name == "asset_growth" else t.fundamentals
        return rounded(X.fundamental_factors(source, [name]))


for _i, _n in enumerate(RATIO_SQL, 2):
    _ratio(_i, _n)

# Prices

part("fr0", "SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY idx) - 1 AS r FROM pxi", "pxi")
part("lf", "SELECT max(f) AS last_first, count(*) AS n_names, any_value(n_dates) AS t FROM (SELECT ticker, min(idx) AS f, max(n_dates) AS n_dates FROM pxi GROUP BY 1)", "pxi")
part("grid", """SELECT a.idx, n.ticker, coalesce(r, 0) AS r, f.close, f.volume FROM ax a, (SELECT DISTINCT ticker FROM px) n
  LEFT JOIN fr0 f ON f.ticker = n.ticker AND f.idx = a.idx, lf
  WHERE a.idx > last_first AND a.idx > t - 12""".replace("FROM ax a, (SELECT DISTINCT ticker FROM px) n\n  LEFT JOIN fr0 f ON", "FROM (SELECT idx, ticker FROM ax, (SELECT DISTINCT ticker FROM px)) n CROSS JOIN lf\n  LEFT JOIN fr0 f ON").replace("a.idx", "n.idx").replace(", lf\n", "\n"), "ax", "fr0", "lf")
part("mkt", "SELECT idx, avg(r) AS m FROM grid GROUP BY 1", "grid")
part("pf", """SELECT ticker, -stddev_samp(r) * sqrt(252) AS volatility, -covar_samp(r, m) / nullif(var_samp(m), 0) AS beta,
  avg(abs(r) / nullif(close * volume, 0)) AS amihud_illiquidity FROM grid JOIN mkt USING (idx) GROUP BY 1""", "grid", "mkt")


@query("f13_momentum", sql(f"SELECT ticker, {rd('x')} AS momentum_12_1 FROM mom", "mom"))
def f13(t):
    return rounded(X.momentum(t.panel, 12, 1))


def _price(number, name, scale=1):
    @query(f"f{number}_{name}", sql(f"SELECT ticker, {rd(f'{scale} * {name}')} AS {name} FROM pf", "pf"))
    def run(t):
        return rounded(X.price_factors(t.panel, YEAR).select("ticker", (F.col(name) * scale).alias(name)))


_price(14, "volatility")
_price(15, "beta")
_price(16, "amihud_illiquidity", 1_000_000)

part("rec", "SELECT ticker, avg(strong_buy + buy - strong_sell - sell) AS recommendation_change FROM ratings GROUP BY 1", "ratings")
part("ins", "SELECT ticker, sum(CASE WHEN regexp_matches(lower(transaction_type), 'purchase|buy') THEN shares ELSE -shares END) AS net_insider_buying FROM insider GROUP BY 1", "insider")


@query("f17_recommendation_change", sql(f"SELECT ticker, {rd('recommendation_change')} AS recommendation_change FROM rec", "rec"))
def f17(t):
    return rounded(X.recommendation_change(t.ratings))


@query("f18_net_insider_buying", sql(f"SELECT ticker, {rd('net_insider_buying')} AS net_insider_buying FROM ins", "ins"))
def f18(t):
    return rounded(X.net_insider_buying(t.insider))


def all_factors(t):
    """Cut: standardizing reads the table several times."""
    return cut(factor_rows(t))


def factor_rows(t):
    return X.factor_table(with_growth(t), t.panel, t.ratings, t.insider, list(FACTOR_GROUPS), YEAR)


part("allf", "SELECT ticker, " + ", ".join(f"{e} AS {n}" for n, e in RATIO_SQL.items()) + """, x AS momentum_12_1, volatility, beta, amihud_illiquidity,
  recommendation_change, net_insider_buying FROM fundg LEFT JOIN mom USING (ticker) LEFT JOIN pf USING (ticker) LEFT JOIN rec USING (ticker) LEFT JOIN ins USING (ticker)""",
     "fundg", "mom", "pf", "rec", "ins")


@query("f19_factor_table", sql("SELECT ticker, " + ", ".join(f"{rd('1e6 * ' + n if n == 'amihud_illiquidity' else n)} AS {n}" for n in FACTOR_GROUPS) + " FROM allf", "allf"))
def f19(t):
    return rounded(factor_rows(t).withColumn("amihud_illiquidity", F.col("amihud_illiquidity") * 1e6))


# Standardization over the monthly score history

part("hist12", """SELECT date, ticker, idx, close, volume, r, lag(close, 1) OVER w AS c1, lag(close, 11) OVER w AS c11, idx - lag(idx, 11) OVER w AS gap,
  count(r) OVER y AS nr, stddev_samp(r) OVER y AS sd FROM (SELECT px.*, ret.idx, r FROM px JOIN ret USING (date, ticker))
  WINDOW w AS (PARTITION BY ticker ORDER BY idx), y AS (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""", "px", "ret")
part("sh", """SELECT date, ticker, 'momentum_12_1' AS factor, CASE WHEN gap = 11 THEN c1 / c11 - 1 END AS x FROM hist12
  UNION ALL SELECT date, ticker, 'volatility', CASE WHEN nr = 12 THEN -sd END FROM hist12
  UNION ALL SELECT date, ticker, 'amihud_illiquidity', abs(r) / (close * volume) * 1e6 FROM hist12
  UNION ALL SELECT date, ticker, 'book_to_price', volume / close FROM hist12""", "hist12")
part("fwd", """SELECT date, ticker, CASE WHEN lead(idx) OVER (PARTITION BY ticker ORDER BY idx) = idx + 1
  THEN lead(close) OVER (PARTITION BY ticker ORDER BY idx) / close - 1 END AS fwd FROM pxi""", "pxi")
part("wins", """SELECT date, ticker, factor, CASE WHEN x IS NOT NULL THEN least(greatest(x, lo), hi) END AS x FROM sh LEFT JOIN
  (SELECT date, factor, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM sh WHERE x IS NOT NULL GROUP BY 1, 2) USING (date, factor)""", "sh")
part("zs", """SELECT date, ticker, factor, CASE WHEN s IS NULL OR s = 0 THEN 0 ELSE (x - m) / s END AS x FROM
  (SELECT *, avg(x) OVER (PARTITION BY date, factor) AS m, stddev_samp(x) OVER (PARTITION BY date, factor) AS s FROM wins)""", "wins")
part("neut", "SELECT date, ticker, factor, x - avg(x) OVER (PARTITION BY date, factor, sector) AS x FROM zs JOIN listing USING (ticker)", "zs", "listing")
KEY = ["date", "factor"]
XR = f"CAST(date AS VARCHAR) AS date, ticker, factor, {rd('x')} AS x"


def out(df):
    return rounded(df.select(day(), "ticker", "factor", "x"))


@query("z1_winsorize", sql(f"SELECT {XR} FROM wins", "wins"))
def z1(t):
    return out(Z.winsorize(t.score_history, KEY))


@query("z2_z_score", sql(f"SELECT {XR} FROM zs", "zs"))
def z2(t):
    return out(Z.z_score(Z.winsorize(t.score_history, KEY), KEY))


def _poly(cs, v):
    e = repr(cs[-1])
    for c in reversed(cs[:-1]):
        e = f"({e} * {v} + {c!r})"
    return e


def ppf(p):
    """Text of the normal quantile for the SQL twin."""
    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    c, m, e = f"(0.180625 - {q} * {q})", f"({r} - 1.6)", f"({r} - 5.0)"
    return (f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {_poly(CENTRE[0], c)} / {_poly(CENTRE[1], c)} ELSE sign({q}) * CASE WHEN {r} <= 5 "
            f"THEN {_poly(MIDDLE[0], m)} / {_poly(MIDDLE[1], m)} ELSE {_poly(TAIL[0], e)} / {_poly(TAIL[1], e)} END END")


@query("z3_rank_normal", sql(f"""SELECT CAST(date AS VARCHAR) AS date, ticker, factor, {rd(ppf('p'))} AS x FROM (
  SELECT date, ticker, factor, (rank() OVER (PARTITION BY date, factor ORDER BY x) + (count(*) OVER (PARTITION BY date, factor, x) - 1) / 2.0 - 0.5)
    / count(*) OVER (PARTITION BY date, factor) AS p FROM sh WHERE x IS NOT NULL) UNION ALL
  SELECT CAST(date AS VARCHAR), ticker, factor, NULL FROM sh WHERE x IS NULL""", "sh"))
def z3(t):
    return out(Z.rank_normal(t.score_history, KEY))


@query("z4_neutralize", sql(f"SELECT {XR} FROM (SELECT date, ticker, factor, x - avg(x) OVER (PARTITION BY date, factor, sector) AS x FROM sh JOIN listing USING (ticker))", "sh", "listing"))
def z4(t):
    rows = t.score_history.join(t.listing.select("ticker", "sector"), "ticker", "left")
    return out(Z.neutralize(rows, KEY, ["sector"]))


@query("z5_standardize_factor", sql(f"SELECT {XR} FROM neut WHERE factor = 'momentum_12_1'", "neut"))
def z5(t):
    return out(Z.standardize(t.score_history.where("factor = 'momentum_12_1'"), KEY, StandardizeConfig(), t.listing))


part("alll", " UNION ALL ".join(f"SELECT ticker, '{n}' AS factor, CAST({n} AS DOUBLE) AS x FROM allf" for n in FACTOR_GROUPS), "allf")
part("alls", """SELECT ticker, factor, z - avg(z) OVER (PARTITION BY factor, sector) AS x FROM (
  SELECT ticker, factor, CASE WHEN s IS NULL OR s = 0 THEN 0 ELSE (y - m) / s END AS z FROM (
    SELECT *, avg(y) OVER (PARTITION BY factor) AS m, stddev_samp(y) OVER (PARTITION BY factor) AS s FROM (
      SELECT ticker, factor, CASE WHEN x IS NOT NULL THEN least(greatest(x, lo), hi) END AS y FROM alll JOIN
      (SELECT factor, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM alll WHERE x IS NOT NULL GROUP BY 1) USING (factor))))
  JOIN listing USING (ticker)""", "alll", "listing")


def all_standardized(t):
    return Z.standardize(X.factors_long(all_factors(t)), ["factor"], StandardizeConfig(), t.listing)


@query("z6_standardize_all", sql(f"SELECT ticker, factor, {rd('x')} AS x, x IS NOT NULL AS covered FROM alls", "alls"))
def z6(t):
    return rounded(Z.with_coverage(all_standardized(t)))


def wide_scores(t):
    names = ["momentum_12_1", "volatility", "amihud_illiquidity", "book_to_price"]
    return t.score_history.groupBy("date", "ticker").pivot("factor", names).agg(F.first("x")), names


@query("z7_orthogonalize")
def z7(t):
    table, names = wide_scores(t)
    return rounded(Z.orthogonalize(table, names, 0.95, ("date", "ticker")).withColumn("date", F.date_format("date", "yyyy-MM-dd")))
