"""Registry of the queries and the shared pieces of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelwright.sources.tables import MarketTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# Queries of estimators that ask for complete dates.
COMPLETE: set[str] = set()


def query(name: str, sql: str | None = None, complete: bool = False):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL twin if there is one.

    ``complete`` gives it the weekly panel without the dates that lack a brand.
    """

    def wrap(fn):
        if name in QUERIES:
            raise KeyError(name)
        if complete:
            COMPLETE.add(name)
        QUERIES[name] = lambda spark, folder: fn(MarketTables(spark, folder).complete if complete else MarketTables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


# Named subqueries of the SQL twins: name -> (names it reads, text).
PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, text: str, *needs: str) -> None:
    PARTS[name] = (needs, text)


def sql(body: str, *needs: str) -> str:
    """``WITH`` the needed parts, in order of dependency, followed by the body."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in PARTS[n][0]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    head = ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order)
    return f"WITH {head}\n{body}" if head else body


def rd(expr: str, digits: int = 6) -> str:
    """Rounded; the nudge moves exact halves (prices are cents over whole quantities) off the edge."""
    return f"round(({expr}) + 1e-9, {digits})"


part("px", """SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2""")
part("ax", "SELECT date, row_number() OVER (ORDER BY date) AS idx, count(*) OVER () AS n_dates FROM (SELECT DISTINCT date FROM px)", "px")
part("pxi", "SELECT px.*, idx, n_dates FROM px JOIN ax USING (date)", "px", "ax")
part("ret", """SELECT date, ticker, idx, n_dates,
  CASE WHEN idx - lag(idx) OVER (PARTITION BY ticker ORDER BY idx) = 1
       THEN close / lag(close) OVER (PARTITION BY ticker ORDER BY idx) - 1 END AS r FROM pxi""", "pxi")
part("bx", """SELECT p_brand AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
  sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
part("bax", "SELECT date, row_number() OVER (ORDER BY date) AS idx, count(*) OVER () AS n_dates FROM (SELECT DISTINCT date FROM bx)", "bx")
part("bret0", """SELECT date, ticker, idx, CASE WHEN idx - lag(idx) OVER (PARTITION BY ticker ORDER BY idx) = 1
  THEN close / lag(close) OVER (PARTITION BY ticker ORDER BY idx) - 1 END AS r FROM bx JOIN bax USING (date)""", "bx", "bax")
part("bret", "SELECT date, ticker, r FROM bret0 WHERE r IS NOT NULL", "bret0")


def on_complete_dates(text: str) -> str:
    """The same query over the dates on which every brand has a return."""
    present = "FROM bret0 WHERE r IS NOT NULL"
    every = f"(SELECT date {present} GROUP BY date HAVING count(*) = (SELECT count(DISTINCT ticker) {present}))"
    return text.replace(present, f"{present} AND date IN {every}", 1)


part("listing", """SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS ticker, s_suppkey AS instrument_id, n_name AS sector, r_name AS exchange,
  s_acctbal, s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
part("fund", """SELECT ticker, sector, exchange, market_cap, s_acctbal AS book_value, total_revenue, net_income, operating_cashflow,
  operating_income, ebitda, market_cap - s_acctbal AS enterprise_value, total_revenue - 0.6 * market_cap AS gross_profit,
  market_cap + abs(s_acctbal) AS total_assets, CASE WHEN s_nationkey % 3 <> 0 THEN md END AS dividend_yield, current_price
  FROM (SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS ticker, sum(l_extendedprice) AS market_cap,
      sum(l_extendedprice * (1 - l_discount)) AS total_revenue, sum(l_extendedprice * (l_discount - l_tax)) AS net_income,
      sum(l_extendedprice * l_tax) AS operating_cashflow, sum(l_extendedprice * l_discount) AS operating_income,
      sum(l_extendedprice * (l_discount + 0.05)) AS ebitda, avg(l_discount) AS md FROM lineitem GROUP BY 1)
  JOIN listing USING (ticker) JOIN (SELECT ticker, max_by(close, date) AS current_price FROM px GROUP BY 1) USING (ticker)""", "px", "listing")
part("qst", """SELECT l_suppkey, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q, sum(l_extendedprice) AS a,
  sum(l_extendedprice * (l_discount - l_tax)) AS b, sum(l_extendedprice * (0.4 - l_discount)) AS c,
  sum(l_extendedprice * l_discount) AS d, sum(l_quantity) AS e FROM lineitem GROUP BY 1, 2""")
part("stw", """SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS ticker, 'quarterly' AS period_type, last_day(q + INTERVAL 2 MONTH) AS period_date, a, b, c, d, e FROM qst
  UNION ALL SELECT 'S' || CAST(l_suppkey AS VARCHAR), 'annual', last_day(date_trunc('year', q) + INTERVAL 11 MONTH),
  sum(a), sum(b), sum(c), sum(d), sum(e) FROM qst GROUP BY 1, 2, 3""", "qst")
part("stm", " UNION ALL ".join(
    f"SELECT ticker, period_type, period_date, '{n}' AS line_item, CAST({c} AS DOUBLE) AS value FROM stw"
    for n, c in zip(["Total Assets", "Net Income", "Gross Profit", "Operating Income", "Stockholders Equity"], "abcde")), "stw")
part("evt", """SELECT events.*, 'S' || CAST(user_id % (SELECT count(*) FROM supplier) AS VARCHAR) AS ticker FROM events""")
part("ratings", """SELECT ticker, CAST(ts AS DATE) AS period, count(*) FILTER (event_type = 'signup') AS strong_buy,
  count(*) FILTER (event_type = 'view') AS buy, count(*) FILTER (event_type = 'click') AS hold,
  count(*) FILTER (event_type = 'error') AS sell, 0 AS strong_sell FROM evt GROUP BY 1, 2""", "evt")
part("insider", "SELECT ticker, event_type AS transaction_type, value AS shares FROM evt", "evt")
part("macro", """SELECT country, date, 100 * (t / lag(t) OVER w - 1) AS gdp_growth, 100.0 * u / c AS unemployment_rate,
  100.0 * u / c - 20 AS yield_spread FROM (SELECT r_name AS country, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date,
    sum(o_totalprice) AS t, count(*) FILTER (o_orderpriority = '1-URGENT') AS u, count(*) AS c
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) WINDOW w AS (PARTITION BY country ORDER BY date)""")


def twin(name: str, text: str) -> None:
    """SQL twin of an already registered query."""
    if name not in QUERIES or name in SQL:
        raise KeyError(name)
    SQL[name] = text


def recursive(body: str, *needs: str) -> str:
    """Like ``sql`` for parts that read themselves."""
    return "WITH RECURSIVE " + sql(body, *needs).removeprefix("WITH ")
