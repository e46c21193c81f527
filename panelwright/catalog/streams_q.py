"""Streams over the event file: closed windows are compared with the batch result."""

from pyspark.sql import functions as F

from panelwright.catalog.base import part, query, rd, sql
from panelwright.config import Band, DriftRule
from panelwright.functions.columns import rounded
from panelwright.session import fresh_path
from panelwright.streaming import streams as X

TS = "'%Y-%m-%d %H:%M:%S'"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def event_stream(t):
    return X.file_stream(t.spark, t.folder, t.raw("events").schema, "events.parquet")


def quote_stream(t, symbols=None):
    raw = event_stream(t).select("ts", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.col("value").alias("price"), F.lit(1.0).alias("size"))
    return X.quotes(raw, symbols)


part("qt", "SELECT ts, 'U' || CAST(user_id AS VARCHAR) AS symbol, value AS price, event_id FROM events")
part("wm", "SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events")


@query("x1_quote_stream", sql(f"SELECT symbol, count(*) AS n, {rd('sum(price)')} AS total FROM qt WHERE symbol IN ('U1', 'U2', 'U3', 'U5', 'U8', 'U13') GROUP BY 1", "qt"))
def x1(t):
    path = fresh_path(t.spark, "quotes")
    q = quote_stream(t, ["U1", "U2", "U3", "U5", "U8", "U13"])
    X.handle(q, lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}")).awaitTermination()
    rows = t.spark.read.parquet(path)
    return rounded(rows.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("price").alias("total")))


OHLC = f"{rd('arg_min(price, ts)')} AS open, {rd('max(price)')} AS high, {rd('min(price)')} AS low, {rd('arg_max(price, ts)')} AS close, {rd('CAST(count(*) AS DOUBLE)')} AS volume, count(*) AS n"


def out(df):
    return rounded(df.select("symbol", stamp("start"), stamp("end"), "open", "high", "low", "close", "volume", "n"))


@query("x2_tumbling_bars", sql(f"""SELECT symbol, strftime(s, {TS}) AS start, strftime(s + INTERVAL 1 HOUR, {TS}) AS "end", {OHLC} FROM (SELECT *, date_trunc('hour', ts) AS s FROM qt) WHERE s + INTERVAL 1 HOUR <= (SELECT wm FROM wm) GROUP BY symbol, s""", "qt", "wm"))
def x2(t):
    return out(X.drain(X.bars(quote_stream(t), "1 hour"), "bars"))


@query("x2_sliding_bars", sql(f"""SELECT symbol, strftime(s, {TS}) AS start, strftime(s + INTERVAL 1 DAY, {TS}) AS "end", {OHLC} FROM (SELECT qt.*, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01') - to_hours(CAST(12 * k AS INTEGER)) AS s FROM qt, range(0, 2) r(k))
  WHERE s + INTERVAL 1 DAY <= (SELECT wm FROM wm) GROUP BY symbol, s""", "qt", "wm"))
def x2s(t):
    return out(X.drain(X.bars(quote_stream(t), "1 day", "12 hours"), "sliding"))


part("ses", """SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 8 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS gap FROM qt)""", "qt")


@query("x2_session_bars", sql(f"""SELECT symbol, strftime(min(ts), {TS}) AS start, strftime(max(ts) + INTERVAL 8 HOUR, {TS}) AS "end", {OHLC} FROM ses GROUP BY symbol, k HAVING max(ts) + INTERVAL 8 HOUR <= (SELECT wm FROM wm)""", "ses", "wm"))
def x2g(t):
    return out(X.drain(X.sessions(quote_stream(t), "8 hours"), "sessions"))


@query("x3_incremental_load", sql(f"SELECT event_id, strftime(ts, {TS}) AS ts, {rd('value')} AS value FROM events"))
def x3(t):
    """Rows of every fifth day are delivered twice; the table holds each once."""
    e = event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.unionByName(e.where(F.dayofmonth("ts") % 5 == 0)).select(
        "event_id", "ts", "value", F.to_date("ts").alias("day"), F.unix_micros("ts").alias("ingest_ts"))
    path = fresh_path(t.spark, "load")
    X.incremental_load(rows, ["event_id"], path, "day").awaitTermination()
    return rounded(t.spark.read.parquet(path).select("event_id", stamp("ts"), "value"))


def holdings(t):
    """Ten portfolios over the users by last digit, equal weights."""
    users = t.raw("events").select("user_id").distinct()
    n = users.groupBy((F.col("user_id") % 10).alias("portfolio")).agg(F.count(F.lit(1)).alias("n"))
    rows = users.withColumn("portfolio", F.col("user_id") % 10).join(n, "portfolio")
    return rows.select("portfolio", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("asset"), (1.0 / F.col("n")).alias("w"))


part("hb", """SELECT symbol AS asset, date_trunc('hour', ts) + INTERVAL 1 HOUR AS e, arg_min(price, ts) AS o, arg_max(price, ts) AS c FROM qt GROUP BY 1, 2 HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT wm FROM wm)""", "qt", "wm")
part("hold", "SELECT 'U' || CAST(user_id AS VARCHAR) AS asset, user_id % 10 AS portfolio, 1.0 / count(*) OVER (PARTITION BY user_id % 10) AS w FROM (SELECT DISTINCT user_id FROM events)")
part("pe", "SELECT DISTINCT portfolio, e FROM hb JOIN hold USING (asset)", "hb", "hold")
part("px_as_of", """SELECT portfolio, pe.e, asset, w, arg_min(o, hb.e) AS base, arg_max(c, hb.e) AS last FROM pe JOIN hold USING (portfolio) JOIN hb USING (asset) WHERE hb.e <= pe.e GROUP BY 1, 2, 3, 4""", "pe", "hold", "hb")


@query("x4_drift_monitor", sql(f"""SELECT portfolio, strftime(e, {TS}) AS "end", {rd('max(d)')} AS max_drift, max(d) > 0.2 AS fires FROM (SELECT portfolio, e, abs(w * last / base / sum(w * last / base) OVER p * sum(w) OVER p - w) AS d FROM px_as_of WINDOW p AS (PARTITION BY portfolio, e)) GROUP BY 1, 2""", "px_as_of"))
def x4(t):
    m = X.drift_monitor(quote_stream(t), holdings(t), DriftRule(0.2))
    return rounded(X.drain(m, "drift").select("portfolio", stamp("end"), "max_drift", "fires"))


part("dv", """SELECT symbol, date_trunc('day', ts) + INTERVAL 1 DAY AS e, sum(price) AS v, count(*) AS n FROM qt GROUP BY 1, 2 HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= (SELECT wm FROM wm)""", "qt", "wm")


@query("x5_streaming_screen", sql(f"""SELECT symbol, strftime(e, {TS}) AS "end", {rd('v')} AS dollar_volume, n, coalesce(last_value(CASE WHEN v >= 30 THEN 1 WHEN v < 15 THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY e), 0) = 1 AS member FROM dv""", "dv"))
def x5(t):
    return rounded(X.drain(X.streaming_screen(quote_stream(t), Band(30.0, 15.0)), "screen").select("symbol", stamp("end"), "dollar_volume", "n", "member"))
