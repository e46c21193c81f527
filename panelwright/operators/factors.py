"""Point-in-time alignment and factor construction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.config import CORE_FACTORS, FACTOR_GROUPS, FactorConfig
from panelwright.functions.columns import pick_column
from panelwright.functions.dist import attach_one, by_calendar
from panelwright.sources.panel import with_axis

# Numerator columns and denominator columns of the ratio factors, first existing one wins.
RATIOS = {
    "book_to_price": (("book_value", "total_equity"), ("market_cap",)),
    "earnings_yield": (("net_income", "trailing_eps"), ("market_cap",)),
    "cash_flow_yield": (("operating_cashflow", "operating_cash_flow"), ("market_cap",)),
    "sales_to_price": (("total_revenue", "revenue"), ("market_cap",)),
    "ebitda_to_ev": (("ebitda",), ("enterprise_value",)),
    "gross_profitability": (("gross_profit", "gross_profits"), ("total_assets",)),
    "roe": (("net_income",), ("total_equity", "book_value")),
    "operating_margin": (("operating_income", "ebit"), ("total_revenue", "revenue")),
    "profit_margin": (("net_income",), ("total_revenue", "revenue")),
}


def point_in_time(records: DataFrame, as_of, lag_days: int, date_col: str = "period_date", key: str = "ticker") -> DataFrame:
    """Records public by ``as_of``; per ticker the last non-null value of *every* column."""
    known = records.where(F.col(date_col) <= F.date_sub(F.lit(as_of).cast("date"), lag_days))
    picks = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date_col))).alias(c)
        for c in records.columns
        if c not in (key, date_col)
    ]
    return known.groupBy(key).agg(F.max(date_col).alias(date_col), *picks)


def point_in_time_dates(records: DataFrame, as_of_dates: DataFrame, lag_days: int, date_col: str = "period_date", key: str = "ticker") -> DataFrame:
    """The same cross-section on many as-of dates at once.

    Each record is valid from its publication to the next one of its ticker, so an
    as-of date meets one record per ticker: the dates (a calendar, small) are put into
    an array and every record explodes the part inside its own interval.
    """
    names = [c for c in records.columns if c not in (key, date_col)]
    w = Window.partitionBy(key).orderBy(date_col)
    filled = [F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in names]
    avail = F.date_add(date_col, lag_days)
    rows = records.select(key, date_col, *filled, avail.alias("_from"), F.lead(avail).over(w).alias("_to"))
    calendar = as_of_dates.agg(F.sort_array(F.collect_set("as_of")).alias("_dates"))
    inside = F.filter(
        "_dates", lambda d: (d >= F.col("_from")) & (F.col("_to").isNull() | (d < F.col("_to")))
    )
    return attach_one(rows, calendar).select(F.explode(inside).alias("as_of"), key, date_col, *names)


def ratio(fundamentals: DataFrame, factor: str) -> Column:
    """Null where a column is missing from the table or the denominator is 0."""
    over, under = RATIOS[factor]
    num, den = pick_column(fundamentals, *over), pick_column(fundamentals, *under)
    if num is None or den is None:
        return F.lit(None).cast("double").alias(factor)
    return F.try_divide(F.col(num).cast("double"), F.col(den).cast("double")).alias(factor)


def fundamental_factor(fundamentals: DataFrame, factor: str) -> Column:
    if factor in RATIOS:
        return ratio(fundamentals, factor)
    if factor == "asset_growth":
        have = pick_column(fundamentals, "asset_growth")
        return (-F.col(have) if have else F.lit(None).cast("double")).alias(factor)
    have = pick_column(fundamentals, "dividend_yield", "trailing_annual_dividend_yield")
    return (F.coalesce(F.col(have), F.lit(0.0)) if have else F.lit(None).cast("double")).alias(factor)


def fundamental_factors(fundamentals: DataFrame, names: Sequence[str]) -> DataFrame:
    """All ratio factors in one projection."""
    return fundamentals.select("ticker", *[fundamental_factor(fundamentals, n) for n in names])


def momentum(panel: DataFrame, lookback: int = 252, skip: int = 21) -> DataFrame:
    """Price ``skip`` rows back over the price ``lookback - 1`` rows back on the panel axis, minus 1."""
    rows = with_axis(panel)
    at = lambda back: F.max(F.when(F.col("idx") == F.col("n_dates") - back, F.col("close")))
    enough = F.max("n_dates") >= lookback
    return rows.groupBy("ticker").agg(
        F.when(enough, F.try_divide(at(skip), at(lookback - 1)) - 1).alias("momentum_12_1")
    )


def filled_returns(panel: DataFrame) -> DataFrame:
    """Returns of forward-filled prices without building the filled grid.

    A filled cell has return 0 and is simply absent here; a price after a gap
    returns against the last one seen. ``n_complete`` and ``first_complete`` tell
    which dates are complete: those after the last ticker's first price.
    """
    rows = with_axis(panel.where(F.col("close").isNotNull()))
    w = Window.partitionBy("ticker").orderBy("idx")
    r = F.try_divide(F.col("close"), F.lag("close").over(w)) - 1
    first = rows.groupBy("ticker").agg(F.min("idx").alias("f")).agg(F.max("f").alias("last_first"), F.count(F.lit(1)).alias("n_names"))
    return attach_one(rows.withColumn("r", r), first)


def price_factors(panel: DataFrame, config: FactorConfig | None = None, market: DataFrame | None = None) -> DataFrame:
    """momentum, volatility, beta and illiquidity per ticker from one pass over the panel.

    With ``complete_dates`` the statistics run over the last complete dates, absent
    cells counting as zero return. Without it, each ticker uses the returns it has.
    """
    c = config or FactorConfig()
    rows = filled_returns(panel)
    if c.complete_dates:
        rows = rows.withColumn("_span", F.col("n_dates") - F.col("last_first"))
    else:
        rows = rows.withColumn("_span", F.col("n_dates") - 1)
    def inside(lookback: int) -> Column:
        return F.col("r").isNotNull() & (F.col("idx") > F.col("n_dates") - F.least("_span", F.lit(lookback)))
    if market is None:
        # The mean of a date is its sum over all names: absent cells are zeros.
        by_date = rows.groupBy("date").agg((F.sum("r") / F.max("n_names") if c.complete_dates else F.avg("r")).alias("m"))
    else:
        by_date = market.select("date", "m")
    rows = rows.join(by_calendar(by_date, ["date"]), "date", "left")
    dates = rows.where(F.col("m").isNotNull()).groupBy("idx").agg(F.first("m").alias("m"), F.max("n_dates").alias("n_dates"), F.max("_span").alias("_span"))
    in_beta = F.col("idx") > F.col("n_dates") - F.least("_span", F.lit(c.beta_lookback))
    mk = dates.where(in_beta).agg(
        F.count(F.lit(1)).alias("nm"), F.sum("m").alias("sm"), F.sum(F.col("m") * F.col("m")).alias("smm")
    )
    vol_in, beta_in = inside(c.volatility_lookback), inside(c.beta_lookback) & F.col("m").isNotNull()
    dv = F.nullif(F.col("close") * F.col("volume"), F.lit(0.0)) if "volume" in panel.columns else F.lit(None)
    at = lambda back: F.max(F.when(F.col("idx") == F.col("n_dates") - back, F.col("close")))
    stats = rows.groupBy("ticker").agg(
        F.when(F.max("n_dates") >= c.lookback, F.try_divide(at(c.skip), at(c.lookback - 1)) - 1).alias("momentum_12_1"),
        F.max(F.least("_span", F.lit(c.volatility_lookback))).alias("nv"),
        F.count(F.when(vol_in, 1)).alias("nv_have"),
        F.sum(F.when(vol_in, F.col("r"))).alias("s1"),
        F.sum(F.when(vol_in, F.col("r") * F.col("r"))).alias("s2"),
        F.sum(F.when(beta_in, F.col("r"))).alias("sb"),
        F.sum(F.when(beta_in, F.col("r") * F.col("m"))).alias("sbm"),
        F.avg(F.when(inside(c.amihud_lookback), F.try_divide(F.abs("r"), dv))).alias("amihud_illiquidity"),
        F.count(F.when(beta_in, 1)).alias("nb_have"),
        F.sum(F.when(beta_in, F.col("m"))).alias("sm_own"),
        F.sum(F.when(beta_in, F.col("m") * F.col("m"))).alias("smm_own"),
    )
    s = attach_one(stats, mk)
    if c.complete_dates:
        n, nb, sm, smm = F.col("nv"), F.col("nm"), F.col("sm"), F.col("smm")
    else:
        n, nb, sm, smm = F.col("nv_have"), F.col("nb_have"), F.col("sm_own"), F.col("smm_own")
    var = F.try_divide(F.col("s2") - F.col("s1") * F.col("s1") / n, n - 1)
    cov = F.col("sbm") - F.col("sb") * sm / nb
    mvar = smm - sm * sm / nb
    return s.select(
        "ticker",
        "momentum_12_1",
        (-F.sqrt(F.greatest(var, F.lit(0.0))) * (float(c.annual_periods) ** 0.5)).alias("volatility"),
        F.when(mvar == 0, 0.0).otherwise(-cov / mvar).alias("beta"),
        "amihud_illiquidity",
    )


def recommendation_change(ratings: DataFrame) -> DataFrame:
    """Mean of a given change, else of (strong_buy + buy) - (strong_sell + sell)."""
    if "recommendation_change" in ratings.columns:
        score = F.col("recommendation_change")
    else:
        part = lambda *cs: sum((F.col(c) for c in cs if c in ratings.columns), F.lit(0))
        score = part("strong_buy", "buy") - part("strong_sell", "sell")
    return ratings.groupBy("ticker").agg(F.avg(score).alias("recommendation_change"))


def net_insider_buying(trades: DataFrame) -> DataFrame:
    """Shares bought minus shares sold; buys are types that mention a purchase or a buy."""
    if "transaction_type" in trades.columns:
        bought = F.lower("transaction_type").rlike("purchase|buy")
        signed = F.when(bought, F.col("shares")).otherwise(-F.col("shares"))
    else:
        signed = F.col("shares")
    return trades.groupBy("ticker").agg(F.sum(signed).alias("net_insider_buying"))


PRICE_FACTORS = ("momentum_12_1", "volatility", "beta", "amihud_illiquidity")


def factor_table(
    fundamentals: DataFrame,
    panel: DataFrame | None = None,
    ratings: DataFrame | None = None,
    trades: DataFrame | None = None,
    names: Sequence[str] = CORE_FACTORS,
    config: FactorConfig | None = None,
) -> DataFrame:
    """The chosen factors for every ticker of the fundamentals, one column each.

    A factor without its source table is left out.
    """
    own = [n for n in names if n in RATIOS or n in ("asset_growth", "dividend_yield")]
    out = fundamental_factors(fundamentals, own)
    wanted = [n for n in names if n in PRICE_FACTORS]
    if panel is not None and wanted:
        out = out.join(price_factors(panel, config).select("ticker", *wanted), "ticker", "left")
    if ratings is not None and "recommendation_change" in names:
        out = out.join(recommendation_change(ratings), "ticker", "left")
    if trades is not None and "net_insider_buying" in names:
        out = out.join(net_insider_buying(trades), "ticker", "left")
    return out.select("ticker", *[n for n in names if n in out.columns])


def factors_long(table: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """(keys, factor, x) rows of a wide factor table."""
    names = [c for c in table.columns if c not in keys]
    return table.unpivot(list(keys), names, "factor", "x")


def group_of(factor: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in FACTOR_GROUPS.items() for v in kv]), factor)
