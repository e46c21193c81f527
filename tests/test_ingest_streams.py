"""Ingestion helpers and streams: replays, late rows, state across runs."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from panelwright.config import Band, DriftRule
from panelwright.session import fresh_path
from panelwright.sources import ingest, panel as P
from panelwright.streaming import streams

QUOTE = "ts timestamp, symbol string, price double, size double"


def test_safe_values(spark):
    rows = [("1.5",), ("nan",), ("inf",), ("x",), (None,), ("-7",), ("9e18",)]
    df = spark.createDataFrame(rows, "v string")
    got = df.select(ingest.safe_float(F.col("v")).alias("f"), ingest.safe_int(F.col("v")).alias("i")).collect()
    assert [r["f"] for r in got] == [1.5, None, None, None, None, -7.0, 9e18]
    assert [r["i"] for r in got] == [1, None, None, None, None, -7, None]
    dates = spark.createDataFrame([("2024-02-03",), ("2024-02-03T10:11:12",), ("1706918400",), ("soon",), ("2024-13-01",), (None,)], "v string")
    day = dt.date(2024, 2, 3)
    assert [r[0] for r in dates.select(ingest.safe_date(F.col("v"))).collect()] == [day, day, day, None, None, None]


def test_first_number(spark):
    rows = ["$ 1,234.50", "-0.5%", "N/A", "-", "", "up 3.2 of 7", "none"]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    assert [r[0] for r in df.select(ingest.first_number(F.col("v"))).collect()] == [1234.5, -0.5, None, None, None, 3.2, None]


def test_upsert_touches_only_its_partitions_and_repeats(spark):
    path = fresh_path(spark, "t")
    schema = "k int, part int, v string, created_at int, ingest_ts int"
    first = spark.createDataFrame([(1, 1, "a", 1, 1), (2, 2, "b", 1, 1), (2, 2, "c", 2, 2)], schema)
    ingest.upsert_table(first, path, ["k"], "part")
    second = spark.createDataFrame([(2, 2, "d", 9, 0), (3, 2, "e", 9, 9)], schema)
    for _ in range(2):
        ingest.upsert_table(second, path, ["k"], "part")
    got = sorted((r["k"], r["v"], r["created_at"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, "a", 1), (2, "d", 1), (3, "e", 9)]
    ingest.upsert_table(second.limit(0), path, ["k"], "part")
    assert spark.read.parquet(path).count() == 3


def test_statement_rows_drop_bad_dates(spark):
    wide = spark.createDataFrame([("A", "Sales", 1.0, 2.0, 3.0)], ["ticker", "line_item", "2023-12-31", "2022-12-31 00:00:00", "TTM"])
    got = {(str(r["period_date"]), r["value"]) for r in ingest.statement_to_rows(wide, wide.columns[2:], ["ticker"]).collect()}
    assert got == {("2023-12-31", 1.0), ("2022-12-31", 2.0)}


def test_delisting_marks(spark):
    rows = [("A", None, None), ("B", "2020-01-01", -0.5), ("C", "2020-01-01", -0.5), ("D", None, None)]
    inst = spark.createDataFrame(rows, "ticker string, d string, delisting_return double").selectExpr("ticker", "to_date(d) delisted_at", "delisting_return")
    seen = spark.createDataFrame([("A",), ("B",), ("B",)], "ticker string")
    got = {r["ticker"]: (str(r["delisted_at"]), r["delisting_return"]) for r in ingest.mark_delistings(inst, seen, "2024-05-01").collect()}
    assert got == {"A": ("None", None), "B": ("None", None), "C": ("2020-01-01", -0.5), "D": ("2024-05-01", -0.3)}


def test_unknown_exchange_passes(spark):
    counts = spark.createDataFrame([(1, 10, "X"), (2, 260, "X"), (3, 1, "?")], "instrument_id int, n_rows int, exchange string")
    cal = spark.createDataFrame([("X",)], "exchange string")
    got = {r["instrument_id"]: (r["expected"], r["sufficient"]) for r in ingest.sufficient_history(counts, cal, "2024-01-01", 1).collect()}
    assert got == {1: (260, False), 2: (260, True), 3: (None, True)}


def test_panel_takes_first_non_null_listing(spark):
    hist = spark.createDataFrame([(1, "2024-01-01", None, 5.0), (2, "2024-01-01", 7.0, 6.0), (3, "2024-01-01", 8.0, 7.0)], "instrument_id int, d string, close double, volume double").selectExpr("instrument_id", "to_date(d) date", "close", "volume")
    inst = spark.createDataFrame([(1, "A"), (2, "A"), (3, " ")], "instrument_id int, ticker string")
    assert [tuple(r) for r in P.price_panel(hist, inst).collect()] == [(dt.date(2024, 1, 1), "A", 7.0, 5.0)]


# Streams


def put(spark, path, rows, batch):
    frame = spark.createDataFrame([(pd.Timestamp(t).to_pydatetime(), s, float(p), 1.0) for t, s, p in rows], QUOTE)
    frame.coalesce(1).write.mode("append").parquet(f"{path}/b={batch}")


def source(spark, path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(QUOTE)
    return streams.quotes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path))


def test_json_quotes(spark):
    rows = [('{"ts": "2024-01-01T10:00:00Z", "symbol": "A", "price": 1.5, "size": 2}',), ("broken",), ('{"symbol": "B", "price": 1}',)]
    got = streams.parse_quotes(spark.createDataFrame(rows, "value string")).collect()
    assert [(r["symbol"], r["price"], r["size"]) for r in got] == [("A", 1.5, 2.0)]


def test_bars_drop_late_rows(spark):
    path = fresh_path(spark, "src")
    put(spark, path, [("2024-01-01 00:01", "A", 1), ("2024-01-01 00:30", "A", 3), ("2024-01-01 05:00", "A", 9)], 1)
    # Rows are late against the watermark of the batch before, so one batch lies between.
    put(spark, path, [("2024-01-01 06:00", "A", 9)], 2)
    put(spark, path, [("2024-01-01 00:10", "A", 50), ("2024-01-01 09:00", "A", 9)], 3)
    put(spark, path, [("2024-01-01 20:00", "A", 9)], 4)
    got = {str(r["start"]): (r["open"], r["high"], r["close"], r["n"]) for r in streams.drain(streams.bars(source(spark, path), "1 hour"), "out").collect()}
    assert got["2024-01-01 00:00:00"] == (1.0, 3.0, 3.0, 2)
    assert "2024-01-01 20:00:00" not in got


def test_sessions_end_after_the_gap(spark):
    path = fresh_path(spark, "src")
    put(spark, path, [("2024-01-01 00:00", "A", 1), ("2024-01-01 00:20", "A", 2), ("2024-01-01 02:00", "A", 5), ("2024-01-02 00:00", "A", 5)], 1)
    got = sorted((str(r["start"]), r["n"]) for r in streams.drain(streams.sessions(source(spark, path), "30 minutes"), "out").collect())
    assert got == [("2024-01-01 00:00:00", 2), ("2024-01-01 02:00:00", 1)]


def test_incremental_load_is_idempotent(spark):
    src, out = fresh_path(spark, "src"), fresh_path(spark, "table")
    put(spark, src, [("2024-01-01 00:00", "A", 1), ("2024-01-02 00:00", "B", 2)], 1)
    put(spark, src, [("2024-01-02 00:00", "B", 2), ("2024-01-03 00:00", "C", 3)], 2)
    for _ in range(2):
        rows = source(spark, src).select("ts", "symbol", "price", F.to_date("ts").alias("day"), F.unix_micros("ts").alias("ingest_ts"))
        streams.incremental_load(rows, ["symbol"], out, "day").awaitTermination()
    assert sorted((r["symbol"], r["price"]) for r in spark.read.parquet(out).collect()) == [("A", 1.0), ("B", 2.0), ("C", 3.0)]


def test_membership_survives_between_batches(spark):
    path = fresh_path(spark, "src")
    days = [("2024-01-01", 40), ("2024-01-02", 20), ("2024-01-03", 10), ("2024-01-04", 20), ("2024-01-06", 1)]
    for i, (d, v) in enumerate(days):
        put(spark, path, [(f"{d} 12:00", "A", v)], i)
    got = streams.drain(streams.streaming_screen(source(spark, path), Band(30, 15)), "out").orderBy("end").collect()
    assert [r["member"] for r in got][:4] == [True, True, False, False]


def test_drift_events(spark):
    path = fresh_path(spark, "src")
    put(spark, path, [("2024-01-01 00:00", "A", 10), ("2024-01-01 00:05", "B", 10)], 1)
    put(spark, path, [("2024-01-01 01:30", "A", 30)], 2)
    put(spark, path, [("2024-01-02 00:00", "B", 30)], 3)
    put(spark, path, [("2024-01-03 00:00", "B", 30)], 4)
    holdings = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.5)], "portfolio long, asset string, w double")
    got = streams.drain(streams.drift_monitor(source(spark, path), holdings, DriftRule(0.2)), "out").orderBy("end").collect()
    assert [(round(r["max_drift"], 6), r["fires"]) for r in got][:3] == [(0.0, False), (0.25, True), (0.0, False)]


def test_drift_from_a_price_of_zero(spark):
    path = fresh_path(spark, "src")
    put(spark, path, [("2024-01-01 00:00", "A", 10), ("2024-01-01 00:05", "B", 0), ("2024-01-01 00:06", "C", 10)], 1)
    put(spark, path, [("2024-01-01 01:30", "A", 30), ("2024-01-01 01:40", "B", 5)], 2)
    put(spark, path, [("2024-01-02 00:00", "C", 30)], 3)
    put(spark, path, [("2024-01-03 00:00", "C", 30)], 4)
    holdings = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.5), (2, "C", 1.0)], "portfolio long, asset string, w double")
    got = streams.drain(streams.drift_monitor(source(spark, path), holdings, DriftRule(0.2)), "out").orderBy("end").collect()
    assert all(r["max_drift"] is None and r["fires"] for r in got if r["portfolio"] == 1)
    assert [(r["max_drift"], r["fires"]) for r in got if r["portfolio"] == 2][:2] == [(0.0, False)] * 2


def test_reference_dates_in_every_form(spark):
    cases = {
        "Dec 2024": "2024-12-01", "  september 1999 ": "1999-09-01", "12/ 25": "2025-12-01", "1/26": "2026-01-01", "01/26": "2026-01-01", "13/25": None, "0/25": None,
        "Mar/15": "2023-03-15", "feb/30": None, "March / 5": "2023-03-05", "2024-12-01": "2024-12-01", "20241201": "2024-12-01", "2024-13-01": None, "1/15/2025": "2025-01-15",
        "15/1/2025": "2025-01-15", "02/03/2025": "2025-02-03", "31/02/2025": None, "Foo 2024": None, "Dec": None, "Dec 2024 x": None, "": None, "  ": None, "n/a": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r["raw"]: r["d"] and str(r["d"]) for r in df.select("raw", ingest.reference_date(F.col("raw"), 2023).alias("d")).collect()}
    assert got == cases
    days = spark.createDataFrame([(dt.date(2024, 2, 29),), (None,)], "d date")
    assert [r[0] for r in days.select(ingest.reference_date(F.col("d"), 2023)).collect()] == [dt.date(2024, 2, 29), None]


def test_article_times_in_every_form(spark):
    cases = {
        "1704067200": "2024-01-01 00:00:00", "2024-01-01": "2024-01-01 00:00:00", "2024-01-01T10:20:30Z": "2024-01-01 10:20:30", "2024-01-01 10:20:30.5+02:00": "2024-01-01 10:20:30",
        "2024-01-01T10:20+0530": "2024-01-01 10:20:00", "20240101": "2024-01-01 00:00:00", "2024-01-01T10:20": "2024-01-01 10:20:00", "N/A": None, "": None, "2024-02-30": None, "yesterday": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r["raw"]: r["t"] for r in df.select("raw", F.date_format(ingest.article_time(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()}
    assert got == cases
    rows = [(1, "de", "a", 1704067200), (2, "de", "b", None), (3, "de", "c", 1600000000)]
    feed = ingest.news_feed(spark.createDataFrame(rows, "article_id int, country string, title string, published long"), "2024-01-05 00:00:00")
    assert [r["article_id"] for r in feed.collect()] == [1]
