"""Long price panels, fundamentals and statement tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions.dist import attach_one

DEFAULT_DELISTING_RETURN = -0.30


def price_panel(
    history: DataFrame,
    instruments: DataFrame,
    values: Sequence[str] = ("close", "volume"),
    include_delisted: bool = True,
    start=None,
    end=None,
) -> DataFrame:
    """One row per (date, ticker); a ticker with several listings keeps, per value,
    the first non-null one in instrument order."""
    listed = instruments.where(F.length(F.trim("ticker")) > 0)
    if not include_delisted:
        listed = listed.where(F.col("delisted_at").isNull())
    rows = history
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end))
    picks = [
        F.min_by(F.col(v).cast("double"), F.when(F.col(v).isNotNull(), F.col("instrument_id"))).alias(v)
        for v in values
    ]
    return (
        rows.join(listed.select("instrument_id", "ticker"), "instrument_id")
        .groupBy("date", "ticker")
        .agg(*picks)
    )


def date_axis(panel: DataFrame) -> DataFrame:
    """(date, idx, n_dates): the panel's rows. Its size is bounded by the calendar."""
    dates = panel.select("date").distinct()
    w = Window.orderBy("date")
    return dates.select(
        "date",
        F.row_number().over(w).alias("idx"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n_dates"),
    )


def with_axis(panel: DataFrame) -> DataFrame:
    """Adds the date index and the number of panel dates.

    The axis has one row per calendar day at most, so it is broadcast and the panel
    is not shuffled by date.
    """
    return panel.drop("idx", "n_dates").join(F.broadcast(date_axis(panel)), "date")


def last_rows(panel: DataFrame, window: int) -> DataFrame:
    """Rows on the last ``window`` dates of the panel (not of each ticker)."""
    return with_axis(panel).where(F.col("idx") > F.col("n_dates") - window)


def simple_returns(panel: DataFrame, log: bool = False) -> DataFrame:
    """Return against the previous *panel date*; null where either price is missing.

    The index difference finds gaps, so no dates-by-tickers grid is built.
    """
    w = Window.partitionBy("ticker").orderBy("idx")
    prev = F.when(F.lag("idx").over(w) == F.col("idx") - 1, F.lag("close").over(w))
    ratio = F.try_divide(F.col("close"), prev)
    return with_axis(panel).select(
        "date", "ticker", "idx", (F.ln(ratio) if log else ratio - 1).alias("r")
    )


def dense(panel: DataFrame, value: str, only: DataFrame | None = None) -> DataFrame:
    """Every (date, ticker) cell, null where nothing was observed; of the tickers in ``only``, if given.

    Used only where the result itself has a row per cell. A ticker's rows are collected, and the
    index numbers it lacks are added there, so the cells are not shuffled to meet the panel.
    """
    axis = date_axis(panel)
    width = axis.agg(F.max("idx").alias("n_dates"))
    axis = axis.select("date", "idx")
    rows = panel if only is None else panel.join(only, "ticker", "left_semi")
    cell = F.struct("idx", F.col(value).alias("v"))
    seen = rows.select("date", "ticker", value).join(F.broadcast(axis), "date", "left").groupBy("ticker").agg(
        F.collect_list(F.when(F.col("idx").isNotNull() & F.col("ticker").isNotNull(), cell)).alias("seen")
    )
    number = F.sequence(F.lit(1), F.col("n_dates"))
    lacking = F.transform(F.array_except(number, F.col("seen.idx")), lambda i: F.struct(i.alias("idx"), F.lit(None).cast(panel.schema[value].dataType).alias("v")))
    cells = attach_one(seen, width).select("ticker", F.explode(F.concat("seen", lacking)).alias("c")).select("ticker", "c.idx", F.col("c.v").alias(value))
    return cells.join(F.broadcast(axis), "idx").select("date", "ticker", "idx", value)


def append_delisting_prices(prices: DataFrame, delistings: DataFrame, default: float = DEFAULT_DELISTING_RETURN) -> DataFrame:
    """Terminal price ``last * (1 + delisting_return)`` on the delisting date, where no price exists."""
    known = prices.where(F.col("close").isNotNull())
    last = (
        known.join(delistings.where(F.col("delisted_at").isNotNull()), "ticker")
        .where(F.col("date") <= F.col("delisted_at"))
        .groupBy("ticker", "delisted_at", "delisting_return")
        .agg(F.max_by("close", "date").alias("last_close"))
    )
    terminal = last.select(
        F.col("delisted_at").alias("date"),
        "ticker",
        (F.col("last_close") * (1 + F.coalesce("delisting_return", F.lit(default)))).alias("close"),
    )
    fresh = terminal.join(known.select("date", "ticker"), ["date", "ticker"], "left_anti")
    return known.select("date", "ticker", "close").unionByName(fresh)


def latest_line_items(statements: DataFrame, items: dict[str, str], period_type: str = "annual") -> DataFrame:
    """Latest value per (ticker, line item) as one wide row per ticker."""
    picks = [
        F.max_by("value", F.when((F.col("line_item") == item) & F.col("value").isNotNull(), F.col("period_date"))).alias(name)
        for item, name in items.items()
    ]
    return (
        statements.where((F.col("period_type") == period_type) & F.col("line_item").isin(*items))
        .groupBy("ticker")
        .agg(*picks)
    )


def fill_from_statements(fundamentals: DataFrame, statements: DataFrame, items: dict[str, str]) -> DataFrame:
    """Null fundamentals take the latest statement value; unseen tickers are added."""
    extra = latest_line_items(statements, items).select(
        "ticker", *[F.col(n).alias(f"_s_{n}") for n in items.values()]
    )
    names = [c for c in fundamentals.columns if c != "ticker"]
    added = [n for n in items.values() if n not in names]
    cols = [
        F.coalesce(F.col(n), F.col(f"_s_{n}")).alias(n) if n in items.values() else F.col(n)
        for n in names
    ]
    return fundamentals.join(extra, "ticker", "full").select(
        "ticker", *cols, *[F.col(f"_s_{n}").alias(n) for n in added]
    )


def asset_growth(statements: DataFrame, item: str = "Total Assets") -> DataFrame:
    """(A0 - A1) / |A1| from the two latest annual values."""
    w = Window.partitionBy("ticker").orderBy(F.col("period_date").desc())
    rows = (
        statements.where((F.col("period_type") == "annual") & (F.col("line_item") == item) & F.col("value").isNotNull())
        .select("ticker", F.row_number().over(w).alias("rn"), "value")
        .where(F.col("rn") <= 2)
    )
    return (
        rows.groupBy("ticker")
        .agg(
            F.max(F.when(F.col("rn") == 1, F.col("value"))).alias("a0"),
            F.max(F.when(F.col("rn") == 2, F.col("value"))).alias("a1"),
        )
        .select("ticker", F.try_divide(F.col("a0") - F.col("a1"), F.abs("a1")).alias("asset_growth"))
        .where(F.col("asset_growth").isNotNull())
    )


def fundamentals_table(profiles: DataFrame, instruments: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Profile columns and sector, the first instrument of each ticker."""
    rows = profiles.join(
        instruments.where(F.length(F.trim("ticker")) > 0).select("instrument_id", "ticker"),
        "instrument_id",
    )
    first = F.min_by(F.struct(*columns), "instrument_id").alias("p")
    return rows.groupBy("ticker").agg(first).select("ticker", "p.*")


def keyed_by_ticker(rows: DataFrame, instruments: DataFrame, zero_filled: Sequence[str] = ()) -> DataFrame:
    """Replace the instrument id by its ticker; listed count columns read null as 0."""
    listed = instruments.where(F.length(F.trim("ticker")) > 0).select("instrument_id", "ticker")
    keep = [
        F.coalesce(F.col(c), F.lit(0)).alias(c) if c in zero_filled else F.col(c)
        for c in rows.columns
        if c != "instrument_id"
    ]
    return rows.join(listed, "instrument_id").select("ticker", *keep)


def macro_row(indicators: DataFrame, bonds: DataFrame) -> DataFrame:
    """One macro row per country: last non-null indicators, bond yields as the fallback."""
    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("reference_date"))).alias(name)

    ind = indicators.groupBy("country").agg(last("gdp_growth"), last("short_rate"), last("long_rate"))
    def maturity(label: str, name: str) -> Column:
        hit = (F.col("maturity") == label) & F.col("yield").isNotNull()
        return F.max_by("yield", F.when(hit, F.col("reference_date"))).alias(name)

    yields = bonds.groupBy("country").agg(maturity("2Y", "y2"), maturity("10Y", "y10"))
    short, long_ = F.coalesce("short_rate", "y2"), F.coalesce("long_rate", "y10")
    return ind.join(yields, "country", "full").select(
        "country",
        "gdp_growth",
        short.alias("short_rate"),
        long_.alias("long_rate"),
        (long_ - short).alias("yield_spread"),
    )


def dataset_summary(panel: DataFrame, fundamentals: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """(item, n): distinct tickers and dates, sectors, and the row count of every table."""
    def one(df: DataFrame, name: str, agg: Column) -> DataFrame:
        return df.agg(agg.cast("long").alias("n")).select(F.lit(name).alias("item"), "n")

    parts = [
        one(panel, "tickers", F.count_distinct("ticker")),
        one(panel, "trading_days", F.count_distinct("date")),
        one(fundamentals, "sectors", F.count_distinct("sector")),
        one(panel, "rows_panel", F.count(F.lit(1))),
        one(fundamentals, "rows_fundamentals", F.count(F.lit(1))),
    ]
    parts += [one(df, f"rows_{name}", F.count(F.lit(1))) for name, df in others.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def range_read(history: DataFrame, instrument_id, start=None, end=None, limit: int = 5000) -> DataFrame:
    """Newest-first slice of one instrument's rows."""
    rows = history.where(F.col("instrument_id") == instrument_id)
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end))
    return rows.orderBy(F.col("date").desc()).limit(limit)


def complete_dates(returns: DataFrame) -> DataFrame:
    """Rows of the dates on which every ticker of the panel has a return."""
    rows = returns.where(F.col("r").isNotNull())
    names = rows.agg(F.count_distinct("ticker").alias("n_names"))
    full = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n_here"))
    full = attach_one(full, names).where(F.col("n_here") == F.col("n_names"))
    return rows.join(full.select("date"), "date", "left_semi").select("date", "ticker", "r")
