"""The star-schema Parquet tables read as an investment data set.

Suppliers play listed instruments (monthly panel), part brands play index-like
assets (weekly panel), events play quotes, ratings and insider trades.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window, functions as F

from panelwright.session import cut
from panelwright.sources import panel as P

STATEMENT_ITEMS = {
    "Total Assets": "total_assets",
    "Net Income": "net_income",
    "Gross Profit": "gross_profit",
    "Operating Income": "operating_income",
    "Stockholders Equity": "total_equity",
}


class MarketTables:
    def __init__(self, spark, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def panel(self) -> DataFrame:
        """Monthly supplier panel.

        Operators read a panel several times (its date axis, lags, ranks). It is
        written once, so the fact table is scanned once and not once per read.
        """
        return cut(
            self.raw("lineitem")
            .groupBy("l_suppkey", F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"))
            .agg(
                (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
                F.sum("l_quantity").alias("volume"),
            )
            .select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), "date", "close", "volume")
        )

    @cached_property
    def returns(self) -> DataFrame:
        return P.simple_returns(self.panel)

    @cached_property
    def weekly(self) -> DataFrame:
        """Weekly brand panel.

        Parts have hardly a line a week, so lines are not aggregated before they meet their
        brand; after it a task keeps a row per brand and week.
        """
        line = self.raw("lineitem").select(
            "l_partkey", F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.col("l_extendedprice").alias("ext"), F.col("l_quantity").alias("qty")
        )
        part = self.raw("part").select("p_partkey", F.col("p_brand").alias("ticker"))
        return (
            line.join(part, line.l_partkey == part.p_partkey)
            .groupBy("ticker", "date")
            .agg((F.sum("ext") / F.sum("qty")).alias("close"), F.sum("qty").alias("volume"))
        )

    @cached_property
    def weekly_returns(self) -> DataFrame:
        """Weekly return panel of the brands; a week without a return is an absent row.

        Small at any scale (brands by weeks) and read many times, so it is
        materialized once instead of aggregating the fact table again.
        """
        return cut(P.simple_returns(cut(self.weekly)).where(F.col("r").isNotNull()).select("date", "ticker", "r"))

    @cached_property
    def complete(self) -> MarketTables:
        """The same tables with the weekly panel cut to the weeks in which every brand has a return."""
        other = MarketTables(self.spark, self.folder)
        other.__dict__["weekly_returns"] = cut(P.complete_dates(self.weekly_returns))
        return other

    @cached_property
    def listing(self) -> DataFrame:
        """ticker, instrument_id, sector, country, exchange, delisted_at, delisting_return."""
        s, n, r = self.raw("supplier"), self.raw("nation"), self.raw("region")
        return (
            s.join(n, s.s_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(
                F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"),
                F.col("s_suppkey").alias("instrument_id"),
                F.col("n_name").alias("sector"),
                F.col("r_name").alias("exchange"),
                "s_acctbal",
                "s_nationkey",
            )
        )

    @cached_property
    def fundamentals(self) -> DataFrame:
        line = self.raw("lineitem")
        ext, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
        sums = line.groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker")).agg(
            F.sum(ext).alias("market_cap"),
            F.sum(ext * (1 - disc)).alias("total_revenue"),
            F.sum(ext * (disc - tax)).alias("net_income"),
            F.sum(ext * tax).alias("operating_cashflow"),
            F.sum(ext * disc).alias("operating_income"),
            F.sum(ext * (disc + 0.05)).alias("ebitda"),
            F.avg(disc).alias("mean_discount"),
        )
        last = self.panel.groupBy("ticker").agg(F.max_by("close", "date").alias("current_price"))
        return cut(
            sums.join(self.listing, "ticker")
            .join(last, "ticker")
            .select(
                "ticker",
                "sector",
                "exchange",
                "market_cap",
                F.col("s_acctbal").alias("book_value"),
                "total_revenue",
                "net_income",
                "operating_cashflow",
                "operating_income",
                "ebitda",
                (F.col("market_cap") - F.col("s_acctbal")).alias("enterprise_value"),
                (F.col("total_revenue") - 0.6 * F.col("market_cap")).alias("gross_profit"),
                (F.col("market_cap") + F.abs("s_acctbal")).alias("total_assets"),
                F.when(F.col("s_nationkey") % 3 != 0, F.col("mean_discount")).alias("dividend_yield"),
                "current_price",
            )
        )

    @cached_property
    def statements(self) -> DataFrame:
        """ticker, period_type, period_date, line_item, value."""
        line = self.raw("lineitem")
        ext, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
        quarter = cut(
            line.groupBy("l_suppkey", F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("q"))
            .agg(
                F.sum(ext).alias("Total Assets"),
                F.sum(ext * (disc - tax)).alias("Net Income"),
                F.sum(ext * (0.4 - disc)).alias("Gross Profit"),
                F.sum(ext * disc).alias("Operating Income"),
                F.sum("l_quantity").alias("Stockholders Equity"),
            )
            .withColumn("ticker", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
        )
        names = list(STATEMENT_ITEMS)
        year = quarter.groupBy("ticker", F.trunc("q", "year").alias("y")).agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in names])
        q = quarter.select(
            "ticker", F.lit("quarterly").alias("period_type"), F.last_day(F.add_months("q", 2)).alias("period_date"),
            *[F.col(f"`{c}`") for c in names],
        )
        y = year.select(
            "ticker", F.lit("annual").alias("period_type"), F.last_day(F.add_months("y", 11)).alias("period_date"),
            *[F.col(f"`{c}`") for c in names],
        )
        return q.unionByName(y).unpivot(
            ["ticker", "period_type", "period_date"], [F.col(f"`{c}`") for c in names], "line_item", "value"
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def _event_ticker(self):
        n = self.raw("supplier").agg(F.count(F.lit(1)).alias("n_sup"))
        return P.attach_one(self.events, n).withColumn(
            "ticker", F.concat(F.lit("S"), (F.col("user_id") % F.col("n_sup")).cast("string"))
        )

    @cached_property
    def ratings(self) -> DataFrame:
        """Analyst counts per ticker and day."""
        def n(kind: str, name: str):
            return F.count_if(F.col("event_type") == kind).alias(name)

        return (
            self._event_ticker()
            .groupBy("ticker", F.to_date("ts").alias("period"))
            .agg(n("signup", "strong_buy"), n("view", "buy"), n("click", "hold"), n("error", "sell"))
            .withColumn("strong_sell", F.lit(0).cast("long"))
        )

    @cached_property
    def insider(self) -> DataFrame:
        return self._event_ticker().select(
            "ticker", F.col("event_type").alias("transaction_type"), F.col("value").alias("shares")
        )

    @cached_property
    def macro(self) -> DataFrame:
        """Quarterly macro history per region."""
        o, c = self.raw("orders"), self.raw("customer")
        n, r = self.raw("nation"), self.raw("region")
        q = F.to_date(F.date_trunc("quarter", "o_orderdate"))
        per_cust = o.groupBy("o_custkey", q.alias("date")).agg(
            F.sum("o_totalprice").alias("t"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"),
            F.count(F.lit(1)).alias("c"),
        )
        total = (
            per_cust.join(c, per_cust.o_custkey == c.c_custkey)
            .groupBy("c_nationkey", "date")
            .agg(F.sum("t").alias("t"), F.sum("u").alias("u"), F.sum("c").alias("c"))
            .join(n, F.col("c_nationkey") == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .groupBy(F.col("r_name").alias("country"), "date")
            .agg(F.sum("t").alias("t"), F.sum("u").alias("u"), F.sum("c").alias("c"))
        )
        w = Window.partitionBy("country").orderBy("date")
        return total.select(
            "country",
            "date",
            (100 * (F.try_divide(F.col("t"), F.lag("t").over(w)) - 1)).alias("gdp_growth"),
            (100.0 * F.col("u") / F.col("c")).alias("unemployment_rate"),
            (100.0 * F.col("u") / F.col("c") - 20).alias("yield_spread"),
        )

    @cached_property
    def score_history(self) -> DataFrame:
        """Monthly factor scores, (date, ticker, factor, x) with nulls where undefined."""
        w = Window.partitionBy("ticker").orderBy("idx")
        rows = P.with_axis(self.panel).withColumn("r", F.when(F.lag("idx").over(w) == F.col("idx") - 1, F.col("close") / F.lag("close").over(w) - 1))
        year = w.rowsBetween(-11, 0)
        whole = F.col("idx") - F.lag("idx", 11).over(w) == 11
        wide = rows.select(
            "date",
            "ticker",
            F.when(whole, F.lag("close", 1).over(w) / F.lag("close", 11).over(w) - 1).alias("momentum_12_1"),
            F.when(F.count("r").over(year) == 12, -F.stddev_samp("r").over(year)).alias("volatility"),
            (F.abs("r") / (F.col("close") * F.col("volume")) * 1e6).alias("amihud_illiquidity"),
            (F.col("volume") / F.col("close")).alias("book_to_price"),
        )
        names = ["momentum_12_1", "volatility", "amihud_illiquidity", "book_to_price"]
        return wide.unpivot(["date", "ticker"], names, "factor", "x")

    @cached_property
    def forward_returns(self) -> DataFrame:
        """Return of the next month, (date, ticker, fwd)."""
        w = Window.partitionBy("ticker").orderBy("idx")
        nxt = F.when(F.lead("idx").over(w) == F.col("idx") + 1, F.lead("close").over(w) / F.col("close") - 1)
        return P.with_axis(self.panel).select("date", "ticker", nxt.alias("fwd"))

    @cached_property
    def market(self) -> DataFrame:
        """Equal-weight forward return per date, (date, m)."""
        return self.forward_returns.groupBy("date").agg(F.avg("fwd").alias("m")).where(F.col("m").isNotNull())
