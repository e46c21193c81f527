"""Upserts, value cleaning, freshness, news, pages and sinks."""

from pyspark.sql import functions as F

from panelwright.catalog.base import SQL, part, query, rd, sql
from panelwright.catalog.sources_q import day
from panelwright.functions.columns import rounded
from panelwright.session import fresh_path
from panelwright.sources import ingest as I


def ledger(t):
    """Order rows as versions: the older half exists, the rest comes in; the key is customer and month."""
    o = t.raw("orders").select(
        F.col("o_custkey").alias("instrument_id"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"),
        F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("ingest_ts"), F.col("o_orderkey").alias("created_at"),
    )
    return o.where("ingest_ts % 2 = 0"), o.where("ingest_ts % 2 = 1")


part("led", """SELECT o_custkey AS instrument_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, arg_max(o_totalprice, (o_orderkey % 2, o_orderkey)) AS value, max((o_orderkey % 2, o_orderkey))[2] AS ingest_ts, min((o_orderkey % 2, o_orderkey))[2] AS created_at FROM orders GROUP BY 1, 2""")
LED = f"SELECT instrument_id, CAST(month AS VARCHAR) AS month, {rd('value')} AS value, ingest_ts, created_at FROM led"


@query("s9_keyed_upsert", sql(LED, "led"))
def s9(t):
    old, new = ledger(t)
    return rounded(I.merge_rows(old, new, ["instrument_id", "month"]).select("instrument_id", day("month"), "value", "ingest_ts", "created_at"))


@query("s9_upsert_table", sql(LED, "led"))
def s9_table(t):
    path = fresh_path(t.spark, "upsert")
    for rows in ledger(t):
        I.upsert_table(rows.withColumn("part", F.year("month")), path, ["instrument_id", "month"], "part")
    return rounded(t.spark.read.parquet(path).select("instrument_id", day("month"), "value", "ingest_ts", "created_at"))


@query("s10_statement_to_rows", sql(f"SELECT ticker, line_item, CAST(period_date AS VARCHAR) AS period_date, {rd('value', 2)} AS value FROM stm WHERE period_type = 'annual' AND value IS NOT NULL", "stm"))
def s10(t):
    s = t.statements.where("period_type = 'annual'").withColumn("p", F.date_format("period_date", "yyyy-MM-dd"))
    periods = sorted(r["p"] for r in s.select("p").distinct().collect())  # bounded by the calendar
    wide = s.groupBy("ticker", "line_item").pivot("p", periods).agg(F.max("value"))
    # as providers name them: plain days, days with a time, and a column that is no period
    named = {p: p if i % 2 else f"{p} 00:00:00" for i, p in enumerate(periods)}
    wide = wide.withColumnsRenamed(named).withColumn("note", F.lit(1.0))
    return rounded(I.statement_to_rows(wide, [*named.values(), "note"], ["ticker"]).select("ticker", "line_item", day("period_date"), "value"), 2)


@query("s11_value_cleaning", sql(f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE value END AS f, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE CAST(trunc(value) AS BIGINT) END AS i,
  substr(event_type, 1, 4) AS s, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d') END AS d FROM events"""))
def s11(t):
    e = t.events
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "n/a").when(k == 1, "NaN").otherwise(F.col("value").cast("string"))
    d = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(
        F.col("event_id") % 3 == 1, F.unix_timestamp("ts").cast("string")).otherwise("soon")
    return e.select("event_id", I.safe_float(raw).alias("f"), I.safe_int(raw).alias("i"), I.safe_text(F.col("event_type"), 4).alias("s"),
                    F.date_format(I.safe_date(d), "yyyy-MM-dd").alias("d"))


@query("s12_staleness", sql("""SELECT instrument_id, CAST(lp AS VARCHAR) AS last_price, CAST(lp - 5 AS VARCHAR) AS fetch_from, coalesce(TIMESTAMP '2024-01-31 00:00:00' - v < INTERVAL 24 HOUR, false) AS profile_fresh,
  coalesce(TIMESTAMP '2024-01-31 00:00:00' - c < INTERVAL 168 HOUR, false) AS statements_fresh FROM (SELECT user_id AS instrument_id, max(CAST(ts AS DATE)) FILTER (event_type = 'view') AS lp,
  max(ts) FILTER (event_type = 'click') AS v, max(ts) FILTER (event_type = 'error' AND user_id % 2 = 0) AS c FROM events WHERE event_type IN ('view', 'click') OR (event_type = 'error' AND user_id % 2 = 0) GROUP BY 1)"""))
def s12(t):
    e = t.events.withColumnRenamed("user_id", "instrument_id")
    kind = lambda k: e.where(F.col("event_type") == k).select("instrument_id", F.col("ts").alias("updated_at"))
    prices = e.where("event_type = 'view'").select("instrument_id", F.to_date("ts").alias("date"))
    cats = {"profile": kind("click"), "statements": kind("error").where("instrument_id % 2 = 0")}
    out = I.staleness(prices, cats, "2024-01-31 00:00:00", {"profile": 24, "statements": 168})
    return out.select("instrument_id", day("last_price"), day("fetch_from"), "profile_fresh", "statements_fresh")


@query("s13_sufficient_history", sql("""SELECT instrument_id, n_rows, expected, coalesce(n_rows >= floor(expected * 0.5), true) AS sufficient FROM (SELECT l_suppkey AS instrument_id, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_rows,
  CASE WHEN any_value(r_name) <> 'ASIA' THEN (SELECT count(*) FROM range(0, 731) d(i) WHERE DATE '1998-01-01' + CAST(i AS INTEGER) < DATE '2000-01-01' AND isodow(DATE '1998-01-01' + CAST(i AS INTEGER)) <= 5 AND NOT (day(DATE '1998-01-01' + CAST(i AS INTEGER)) = 25 AND month(DATE '1998-01-01' + CAST(i AS INTEGER)) = 12)) END AS expected
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE CAST(l_shipdate AS DATE) >= DATE '1998-01-01' AND CAST(l_shipdate AS DATE) < DATE '2000-01-01' GROUP BY 1)"""))
def s13(t):
    day_ = F.to_date("l_shipdate")
    n = t.raw("lineitem").where((day_ >= F.lit("1998-01-01")) & (day_ < F.lit("2000-01-01"))).groupBy("l_suppkey").agg(F.count_distinct(day_).alias("n_rows"))
    counts = n.join(t.listing, F.col("instrument_id") == F.col("l_suppkey")).select("instrument_id", "n_rows", "exchange")
    calendars = t.raw("region").where("r_name <> 'ASIA'").select(F.col("r_name").alias("exchange"))
    holidays = calendars.select("exchange", F.explode(F.array(F.lit("1998-12-25").cast("date"), F.lit("1999-12-25").cast("date"))).alias("date"))
    return I.sufficient_history(counts, calendars, "2000-01-01", 2, holidays, 0.5)


@query("s15_delisting_detection", sql(f"""SELECT ticker, CAST(CASE WHEN seen THEN NULL WHEN k % 7 = 0 THEN DATE '2000-01-01' ELSE DATE '2001-11-30' END AS VARCHAR) AS delisted_at,
  CASE WHEN seen THEN NULL WHEN k % 7 = 0 THEN {rd('-0.5')} ELSE {rd('-0.3')} END AS delisting_return FROM (SELECT ticker, instrument_id AS k, ticker IN (SELECT ticker FROM px WHERE date = (SELECT max(date) FROM px)) AND instrument_id % 3 <> 0 AS seen FROM listing)""", "listing", "px"))
def s15(t):
    k = F.col("instrument_id")
    inst = t.listing.select("ticker", F.when(k % 7 == 0, F.lit("2000-01-01").cast("date")).alias("delisted_at"), F.when(k % 7 == 0, -0.5).alias("delisting_return"))
    from panelwright.sources.panel import last_rows

    seen = last_rows(t.panel, 1).join(t.listing.where("instrument_id % 3 <> 0").select("ticker"), "ticker", "left_semi")
    return rounded(I.mark_delistings(inst, seen, "2001-11-30").select("ticker", day("delisted_at"), "delisting_return"))


part("cs", "SELECT country, arg_max(gdp_growth, date) FILTER (gdp_growth IS NOT NULL) AS g, arg_max(unemployment_rate, date) AS u, round(arg_max(unemployment_rate, date) / 10 + 0.0003, 4) AS y2, round(arg_max(yield_spread, date) / 5 + 2.0003, 4) AS y10 FROM macro GROUP BY 1", "macro")


@query("s16_country_summary", sql(f"""SELECT country, {rd('g')} AS gdp_growth, {rd('u')} AS unemployment_rate, {rd('y2')} AS y2, {rd('y10')} AS y10, {rd('y10 - y2')} AS spread,
  'Bond yields: 10Y: ' || printf('%.2f', y10) || '%, 2Y: ' || printf('%.2f', y2) || '%; 10Y-2Y spread: ' || CASE WHEN y10 - y2 >= 0 THEN '+' ELSE '' END || printf('%.2f', y10 - y2) || '% (' || CASE WHEN y10 > y2 THEN 'steepening' ELSE 'inverted' END || ')' AS digest FROM cs""", "cs"))
def s16(t):
    m = t.macro
    b = F.array(
        F.struct(F.lit("2Y").alias("maturity"), F.round(F.col("unemployment_rate") / 10 + 0.0003, 4).alias("yield")),
        F.struct(F.lit("10Y").alias("maturity"), F.round(F.col("yield_spread") / 5 + 2.0003, 4).alias("yield")),
    )
    return rounded(I.country_summary(m, m.select("country", "date", F.explode(b).alias("b")).select("country", "date", "b.*")))


def articles(t):
    """Documents as articles: title = first eight words, one publish time per document."""
    words = F.slice(F.split("text", "[ \\t\\r\\n]+"), 1, 8)
    age = F.make_dt_interval(F.pmod(F.col("doc_id") * 37, F.lit(90)).cast("int"), F.lit(0), F.pmod(F.col("doc_id"), F.lit(1440)).cast("int"))
    return t.raw("documents").select(
        F.col("doc_id").alias("article_id"), F.col("lang").alias("country"), F.array_join(words, " ").alias("title"),
        (F.lit("2024-03-31 00:00:00").cast("timestamp") - age).alias("published"),
    )


part("art", """SELECT doc_id AS article_id, lang AS country, array_to_string(regexp_split_to_array(text, '[ \\t\\r\\n]+')[1:8], ' ') AS title,
  TIMESTAMP '2024-03-31 00:00:00' - to_days(CAST((doc_id * 37) % 90 AS INTEGER)) - to_minutes(doc_id % 1440) AS published FROM documents""")


@query("s17_news_feed", sql("""SELECT country, title, article_id, strftime(published, '%Y-%m-%d %H:%M:%S') AS published, rnk FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY published DESC, article_id) AS rnk FROM (
  SELECT country, title, min(article_id) AS article_id, arg_min(published, article_id) AS published FROM art WHERE published > TIMESTAMP '2024-03-31 00:00:00' - INTERVAL 60 DAY AND published <= TIMESTAMP '2024-03-31 00:00:00' GROUP BY 1, 2)) WHERE rnk <= 50""", "art"))
def s17(t):
    return I.news_feed(articles(t), "2024-03-31 00:00:00").withColumn("published", F.date_format("published", "yyyy-MM-dd HH:mm:ss"))


RAW_FEED = SQL["s17_news_feed"].replace(" FROM art WHERE ", " FROM art WHERE article_id % 5 <> 3 AND ")


@query("s17_raw_news_feed", RAW_FEED)
def s17_raw(t):
    p = F.col("published")
    at = lambda f: F.date_format(p, f)
    raw = (
        F.when(F.col("article_id") % 5 == 0, F.unix_timestamp(p).cast("string")).when(F.col("article_id") % 5 == 1, at("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("article_id") % 5 == 2, F.concat(at("yyyy-MM-dd HH:mm:ss.SSS"), F.lit("+02:00"))).when(F.col("article_id") % 5 == 3, "N/A").otherwise(at("yyyy-MM-dd'T'HH:mm"))
    )
    return I.news_feed(articles(t).withColumn("published", raw), "2024-03-31 00:00:00").withColumn("published", F.date_format("published", "yyyy-MM-dd HH:mm:ss"))


# Dates of macro rows as different providers write them.
part("rawd", """SELECT o_orderkey, k, CASE k WHEN 0 THEN strftime(d, '%b %Y') WHEN 1 THEN strftime(d, '%m/ ') || substr(strftime(d, '%Y'), 3) WHEN 2 THEN strftime(d, '%B') || '/' || day(d) WHEN 3 THEN ' ' || strftime(d, '%Y-%m-%d') || ' '
  WHEN 4 THEN month(d) || '/' || day(d) || '/' || year(d) WHEN 5 THEN day(d) || '/' || month(d) || '/' || year(d) WHEN 6 THEN strftime(d, '%Y%m%d') WHEN 7 THEN upper(strftime(d, '%B')) || '  ' || year(d) WHEN 8 THEN '31/02/' || year(d) WHEN 9 THEN 'soon' END AS raw, d
  FROM (SELECT o_orderkey, o_orderkey % 11 AS k, CAST(o_orderdate AS DATE) AS d FROM orders)""")


@query("s7_reference_dates", sql("""SELECT o_orderkey, raw, strftime(CASE WHEN k IN (0, 7) THEN date_trunc('month', d) WHEN k = 1 THEN make_date(2000 + year(d) % 100, month(d), 1) WHEN k = 2 THEN try_cast(printf('1999-%02d-%02d', month(d), day(d)) AS DATE)
  WHEN k IN (3, 4, 6) THEN d WHEN k = 5 THEN CASE WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END END, '%Y-%m-%d') AS date FROM rawd""", "rawd"))
def s7_dates(t):
    d, k = F.col("d"), F.col("k")
    at = lambda f: F.date_format(d, f)
    forms = [at("MMM yyyy"), at("MM/ yy"), at("MMMM/d"), at(" yyyy-MM-dd "), at("M/d/yyyy"), at("d/M/yyyy"), at("yyyyMMdd"), F.upper(at("MMMM  yyyy")), at("'31/02/'yyyy"), F.lit("soon")]
    raw = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        raw = F.when(k == i, f).otherwise(raw)
    rows = t.raw("orders").select("o_orderkey", (F.col("o_orderkey") % 11).alias("k"), F.to_date("o_orderdate").alias("d")).withColumn("raw", raw)
    return rows.select("o_orderkey", "raw", F.date_format(I.reference_date(F.col("raw"), 1999), "yyyy-MM-dd").alias("date"))


def plain_sql(x):
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"trim(regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g'))"


BODY = "html"
for _tag in ("script", "style", "nav", "header", "footer", "aside"):
    BODY = f"regexp_replace({BODY}, '(?s)<{_tag}[ >].*?</{_tag}>', ' ', 'g')"


@query("s18_page_fields", f"""SELECT page_id, title, links, article, length(article) AS article_length FROM (SELECT page_id, {plain_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
  array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), '|') AS links, {plain_sql(f"regexp_extract({BODY}, '(?s)<article[^>]*>(.*)</article>', 1)")} AS article FROM pages)""")
def s18(t):
    return I.page_fields(t.raw("pages")).withColumn("links", F.array_join("links", "|"))


NAMES = [("The", "definite"), ("and", "conjunction"), ("AND", "conjunction"), ("des", "article"), ("Nicht", "negation"), ("la", "article")]


@query("s18_matched_names", """SELECT page_id, standard, count(*) AS hits FROM (SELECT page_id, lower(trim(unnest(regexp_extract_all(html, '(?s)<a[^>]*>(.*?)</a>', 1)))) AS name FROM pages)
  JOIN (VALUES ('the', 'definite'), ('and', 'conjunction'), ('des', 'article'), ('nicht', 'negation'), ('la', 'article')) v(name, standard) USING (name) GROUP BY 1, 2""")
def s18_names(t):
    names = t.spark.createDataFrame(NAMES, "pattern string, standard string").withColumn("pattern", F.lower("pattern")).distinct()
    return I.matched_names(t.raw("pages"), names)


@query("s18_first_number", """SELECT doc_id, TRY_CAST(nullif(regexp_extract(regexp_replace(text, '[%,$€£¥ \\t\\r\\n]', '', 'g'), '(-?[0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE) AS value FROM documents""")
def s18_number(t):
    return t.raw("documents").select("doc_id", I.first_number(F.col("text")).alias("value"))


@query("s19_weights_sink", sql(f"SELECT as_of, asset, {rd('w')} AS w FROM (SELECT CAST(date AS VARCHAR) AS as_of, ticker AS asset, volume / sum(volume) OVER (PARTITION BY date) AS w FROM px)", "px"))
def s19(t):
    total = t.panel.groupBy("date").agg(F.sum("volume").alias("v"))
    w = t.panel.join(total, "date").select(
        F.date_format("date", "yyyy-MM-dd").alias("as_of"), F.col("ticker").alias("asset"), (F.col("volume") / F.col("v")).alias("w"))
    path = fresh_path(t.spark, "weights")
    I.write_weights(w, path)
    return rounded(t.spark.read.schema("asset string, w double, as_of string").option("header", True).csv(path).select("as_of", "asset", "w"))
