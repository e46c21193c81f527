"""Cleaning, keyed upserts, freshness, news, pages and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.utils import AnalysisException

from panelwright.functions.columns import finite
from panelwright.session import cut

# Values


def safe_float(c: Column) -> Column:
    """Number or null; NaN and infinities are null."""
    return finite(c.try_cast("double"))


def safe_int(c: Column) -> Column:
    """Whole number cut toward zero, or null."""
    x = safe_float(c)
    return F.when(F.abs(x) < 9.0e18, x.cast("long"))


def safe_text(c: Column, length: int | None = None) -> Column:
    s = c.cast("string")
    return s if length is None else F.substring(s, 1, length)


def safe_date(c: Column) -> Column:
    """ISO date or timestamp text, or epoch seconds, to a date; anything else is null."""
    s = F.trim(c.cast("string"))
    epoch = F.when(s.rlike(r"^-?[0-9]{5,12}(\.[0-9]+)?$"), s.try_cast("double"))
    iso = F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.coalesce(F.try_to_timestamp(s), F.try_to_timestamp(F.substring(s, 1, 10))))
    return F.coalesce(F.to_date(iso), F.to_date(F.timestamp_seconds(F.floor(epoch))))


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _date(year: Column, month: Column, day: Column) -> Column:
    """The day, null if there is none such."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    known = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.to_date(F.try_to_timestamp(F.when(known, text), F.lit("yyyy-MM-dd")))


def reference_date(c: Column, year: int | Column) -> Column:
    """Dates of macro rows in the forms providers use; the first form that gives a day wins, else null.

    ``Dec 2024`` (first of the month, any word that begins with the month's three letters), ``12/ 25``
    (month and two-digit year), ``Mar/15`` (in the given ``year``), ``2024-12-01`` or ``20241201``,
    ``1/15/2025`` and, where that is no day, day first. Blanks around are ignored.
    """
    s = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    tight = F.replace(s, F.lit(" "), F.lit(""))

    def group(x: Column, pattern: str, n: int) -> Column:
        return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, n))

    def month(x: Column) -> Column:
        name = F.substring(F.lower(x), 1, 3)
        at = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), name)
        return F.when(at > 0, at.cast("string"))

    one = F.lit("1")
    word_year = r"^(\S+)\s+([0-9]{1,4})$"
    month_year = r"^([0-9]{1,2})/([0-9]{2})$"
    month_day = r"^([^/]*)/([0-9]{1,2})$"
    iso = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$"
    plain = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"
    slashes = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
    this_year = (F.lit(year) if isinstance(year, int) else year).cast("string")
    return F.coalesce(
        _date(group(s, word_year, 2), month(group(s, word_year, 1)), one),
        _date(F.concat(F.lit("20"), group(tight, month_year, 2)), group(tight, month_year, 1), one),
        _date(this_year, month(group(tight, month_day, 1)), group(tight, month_day, 2)),
        *[_date(*[group(s, p, n) for n in (1, 2, 3)]) for p in (iso, plain)],
        _date(*[group(s, slashes, n) for n in (3, 1, 2)]),
        _date(*[group(s, slashes, n) for n in (3, 2, 1)]),
    )


def article_time(c: Column) -> Column:
    """Publication time of an article: epoch seconds or ISO text, whose zone is dropped; ``N/A`` and the like are null."""
    s = F.trim(c.cast("string"))
    day = s.rlike("^[0-9]{8}$")
    epoch = F.when(s.rlike("^-?[0-9]{1,12}$") & ~day, s.try_cast("long"))
    iso = F.when(
        s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"),
        F.regexp_replace(s, r"(:[0-9]{2}(?:[.][0-9]+)?)(?:Z|[+-][0-9]{2}:?[0-9]{2})$", "$1"))
    return F.coalesce(F.timestamp_seconds(epoch), F.try_to_timestamp(iso), F.try_to_timestamp(F.when(day, s), F.lit("yyyyMMdd")))


# Upsert


def merge_rows(existing: DataFrame, incoming: DataFrame, key: Sequence[str], keep: Sequence[str] = ("id", "created_at")) -> DataFrame:
    """New rows replace old rows with the same key; ``keep`` columns stay those of the first row.

    An incoming row always beats an existing one; among incoming rows of a key the
    newest (by ``ingest_ts``) wins. Partial aggregation reduces repeated keys before
    the shuffle.
    """
    rows = existing.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)))
    order = F.struct("_in", "ingest_ts")
    rest = [c for c in incoming.columns if c not in key and c not in keep]
    kept = [c for c in keep if c in incoming.columns]
    picks = [F.max_by(F.struct(*rest), order).alias("_new"), *[F.min_by(c, order).alias(c) for c in kept]]
    return rows.groupBy(*key).agg(*picks).select(*key, *kept, "_new.*").select(*incoming.columns)


def upsert_table(incoming: DataFrame, path: str, key: Sequence[str], partition: str) -> None:
    """Upsert into a partitioned Parquet table, rewriting only the partitions that receive rows.

    The merged partitions are checkpointed before they replace their own source files.
    """
    spark = incoming.sparkSession
    incoming = cut(incoming)
    touched = [r[0] for r in incoming.select(partition).distinct().collect()]
    if not touched:
        return
    try:
        old = spark.read.schema(incoming.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = incoming.limit(0)
    old = old.where(F.col(partition).isin(touched)).select(*incoming.columns)
    merged = cut(merge_rows(old, incoming, [*key]))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def statement_to_rows(wide: DataFrame, periods: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per (keys, line item, period column); columns that are no date are dropped."""
    long = wide.unpivot([*keys, "line_item"], list(periods), "_period", "value")
    return (
        long.withColumn("period_date", safe_date(F.col("_period")))
        .where(F.col("period_date").isNotNull())
        .select(*keys, "line_item", "period_date", "value")
    )


# Freshness


def staleness(prices: DataFrame, categories: dict[str, DataFrame], now, hours: dict[str, int], overlap_days: int = 5) -> DataFrame:
    """Per instrument: last price date, the date to fetch from, and per category whether its
    newest ``updated_at`` is younger than the threshold."""
    out = prices.groupBy("instrument_id").agg(F.max("date").alias("last_price"))
    for name, df in categories.items():
        out = out.join(df.groupBy("instrument_id").agg(F.max("updated_at").alias(f"_{name}")), "instrument_id", "full")
    at = F.unix_micros(F.lit(now).cast("timestamp"))
    fresh = [
        F.coalesce(at - F.unix_micros(f"_{n}") < hours[n] * 3_600_000_000, F.lit(False)).alias(f"{n}_fresh") for n in categories
    ]
    return out.select("instrument_id", "last_price", F.date_sub("last_price", overlap_days).alias("fetch_from"), *fresh)


def sufficient_history(counts: DataFrame, calendars: DataFrame, as_of, years: int, holidays: DataFrame | None = None, tolerance: float = 0.95) -> DataFrame:
    """(instrument_id, n_rows, expected, sufficient): rows against the weekday sessions of the
    exchange over ``years``, holidays left out; an unknown exchange passes."""
    end = F.lit(as_of).cast("date")
    days = calendars.select("exchange").distinct().select(
        "exchange", F.explode(F.sequence(F.add_months(end, -12 * years), F.date_sub(end, 1))).alias("date")
    ).where(F.weekday("date") < 5)
    if holidays is not None:
        days = days.join(holidays.select("exchange", "date"), ["exchange", "date"], "left_anti")
    expected = days.groupBy("exchange").agg(F.count(F.lit(1)).alias("expected"))
    rows = counts.join(expected, "exchange", "left")
    ok = F.coalesce(F.col("n_rows") >= F.floor(F.col("expected") * tolerance), F.lit(True))
    return rows.select("instrument_id", "n_rows", "expected", ok.alias("sufficient"))


def mark_delistings(instruments: DataFrame, seen: DataFrame, today, default: float = -0.30) -> DataFrame:
    """Active tickers not seen now are delisted today; a ticker seen again is cleared."""
    rows = instruments.join(seen.select("ticker").distinct().withColumn("_seen", F.lit(True)), "ticker", "left")
    here = F.col("_seen").isNotNull()
    fresh = ~here & F.col("delisted_at").isNull()
    return rows.select(
        *[c for c in instruments.columns if c not in ("delisted_at", "delisting_return")],
        F.when(fresh, F.lit(today).cast("date")).when(~here, F.col("delisted_at")).alias("delisted_at"),
        F.when(fresh, F.lit(default)).when(~here, F.col("delisting_return")).alias("delisting_return"),
    )


def country_summary(indicators: DataFrame, bonds: DataFrame) -> DataFrame:
    """Per country: latest indicators, bond yields by maturity, the 10Y-2Y spread and a text line."""
    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("date"))).alias(name)

    ind = indicators.groupBy("country").agg(last("gdp_growth"), last("unemployment_rate"))
    latest = bonds.where(F.col("yield").isNotNull()).groupBy("country", "maturity").agg(F.max_by("yield", "date").alias("y"))
    text = F.concat(F.col("maturity"), F.lit(": "), F.format_string("%.2f", "y"), F.lit("%"))
    curve = latest.groupBy("country").agg(
        F.max(F.when(F.col("maturity") == "2Y", F.col("y"))).alias("y2"),
        F.max(F.when(F.col("maturity") == "10Y", F.col("y"))).alias("y10"),
        F.concat_ws(", ", F.sort_array(F.collect_list(text))).alias("curve"),
    )
    spread = F.col("y10") - F.col("y2")
    shape = F.when(spread > 0, "steepening").otherwise("inverted")
    digest = F.concat(
        F.lit("Bond yields: "), F.col("curve"),
        F.when(spread.isNotNull(), F.concat(F.lit("; 10Y-2Y spread: "), F.format_string("%+.2f", spread), F.lit("% ("), shape, F.lit(")"))).otherwise(""),
    )
    return ind.join(curve, "country", "full").select("country", "gdp_growth", "unemployment_rate", "y2", "y10", spread.alias("spread"), digest.alias("digest"))


# News and pages


def news_feed(articles: DataFrame, as_of, days: int = 60, per_country: int = 50) -> DataFrame:
    """Recent articles, the first of each title per country, the newest N of each country.

    ``published`` may be a timestamp or raw text (``article_time``); articles without a time are left out.

    Repeated titles collapse in a partial aggregate; the final ranking keeps N rows per
    country in every map task.
    """
    now = F.lit(as_of).cast("timestamp")
    kind = articles.schema["published"].dataType.typeName()
    if kind in ("string", "long", "integer"):
        at = article_time(F.col("published")) if kind == "string" else F.timestamp_seconds("published")
        articles = articles.withColumn("published", at)
    recent = articles.where((F.col("published") > now - F.make_dt_interval(F.lit(days))) & (F.col("published") <= now))
    first = recent.groupBy("country", "title").agg(F.min_by(F.struct("article_id", "published"), "article_id").alias("a"))
    rows = first.select("country", "title", "a.article_id", "a.published")
    w = Window.partitionBy("country").orderBy(F.col("published").desc(), "article_id")
    return rows.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= per_country)


def _plain(html: Column) -> Column:
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " "))


def first_number(text: Column) -> Column:
    """First signed number of a cell after the usual currency and percent marks are removed."""
    cleaned = F.regexp_replace(text, r"[%,$€£¥ \t\r\n]", "")
    found = F.regexp_extract(cleaned, r"(-?[0-9]+\.?[0-9]*)", 1)
    missing = F.upper(F.trim(text)).isin("N/A", "NA", "-", "")
    return F.when(~missing & (found != ""), found.try_cast("double"))


def page_fields(pages: DataFrame) -> DataFrame:
    """(page_id, title, links, article, article_length) of raw pages by regular expressions."""
    html = F.col("html")
    body = html
    for tag in ("script", "style", "nav", "header", "footer", "aside"):
        body = F.regexp_replace(body, f"(?s)<{tag}[ >].*?</{tag}>", " ")
    article = F.regexp_extract(body, "(?s)<article[^>]*>(.*)</article>", 1)
    return pages.select(
        "page_id",
        _plain(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)).alias("title"),
        F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1)).alias("links"),
        _plain(article).alias("article"),
    ).withColumn("article_length", F.length("article"))


def matched_names(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(page_id, standard, hits): link texts that equal a known name, ignoring case.

    ``names`` is (pattern, standard).
    """
    texts = pages.select(
        "page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<a[^>]*>(.*?)</a>"), F.lit(1))).alias("text")
    ).select("page_id", F.lower(F.trim("text")).alias("name"))
    known = names.select(F.lower("pattern").alias("name"), "standard")
    return texts.groupBy("page_id", "name").agg(F.count(F.lit(1)).alias("n")).join(known, "name").groupBy("page_id", "standard").agg(
        F.sum("n").alias("hits")
    )


# Sinks


def write_weights(weights: DataFrame, path: str, fmt: str = "csv") -> None:
    """Weights sorted by size inside each as-of partition."""
    out = weights.repartition("as_of").sortWithinPartitions("as_of", F.col("w").desc(), "asset")
    writer = out.write.mode("overwrite").partitionBy("as_of")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
