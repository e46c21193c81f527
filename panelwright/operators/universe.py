"""Universe predicates, investability screens and instrument filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.config import Band, InstrumentRules, ScreenConfig
from panelwright.functions.dist import attach_one, group_quantiles
from panelwright.sources.panel import last_rows, with_axis


def band_pass(value: Column, band: Band, member: Column) -> Column:
    """At or above entry, or a member at or above exit; null fails."""
    return F.coalesce((value >= band.entry) | (member & (value >= band.exit)), F.lit(False))


def flag_members(df: DataFrame, members: DataFrame | None, out: str = "member") -> DataFrame:
    if members is None:
        return df.withColumn(out, F.lit(False))
    return df.join(
        members.select("ticker").distinct().withColumn(out, F.lit(True)), "ticker", "left"
    ).withColumn(out, F.coalesce(out, F.lit(False)))


def screen(values: DataFrame, value: str, band: Band, members: DataFrame | None = None) -> DataFrame:
    """Hysteresis screen."""
    return (
        flag_members(values, members)
        .where(band_pass(F.col(value), band, F.col("member")))
        .drop("member")
    )


def average_dollar_volume(panel: DataFrame, window: int) -> DataFrame:
    """Mean of close * volume over the last ``window`` panel rows, nulls skipped."""
    return last_rows(panel, window).groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("addv"))


def trading_frequency(panel: DataFrame, window: int) -> DataFrame:
    """Share of the last panel rows with volume above 0; a missing cell is not traded.

    All tickers of the panel are kept: the rows before the window only add the name.
    """
    rows = with_axis(panel)
    recent = F.col("idx") > F.col("n_dates") - window
    return rows.groupBy("ticker").agg(
        (F.count_if(recent & (F.col("volume") > 0)) / F.max(F.least("n_dates", F.lit(window)))).alias("frequency")
    )


def listing_age(panel: DataFrame) -> DataFrame:
    return panel.groupBy("ticker").agg(F.count("close").alias("age"))


def statement_counts(index: DataFrame, period_type: str, lookback_days: int | None = None) -> DataFrame:
    """Statements per ticker, optionally only those near the latest period."""
    rows = index.where(F.col("period_type") == period_type)
    if lookback_days is not None:
        latest = rows.agg(F.max("period_date").alias("latest"))
        rows = attach_one(rows, latest).where(
            F.col("period_date") >= F.date_sub("latest", lookback_days)
        )
    return rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_statements"))


def cap_thresholds(caps: DataFrame, percentiles: dict[str, float], min_size: int = 10) -> DataFrame:
    """Market-cap percentile per exchange; 0 where the exchange is small."""
    known = caps.where(F.col("market_cap").isNotNull() & F.col("exchange").isNotNull())
    q = group_quantiles(known, ["exchange"], "market_cap", percentiles, n_out="n_names")
    return q.select(
        "exchange",
        *[F.when(F.col("n_names") >= min_size, F.col(p)).otherwise(0.0).alias(p) for p in percentiles],
    )


def cap_percentile_screen(
    caps: DataFrame, band: Band, min_size: int = 10, members: DataFrame | None = None
) -> DataFrame:
    """Entry and exit percentile of the own exchange; unmapped names have threshold 0."""
    t = cap_thresholds(caps, {"entry_cut": band.entry, "exit_cut": band.exit}, min_size)
    rows = flag_members(caps.where(F.col("market_cap").isNotNull()), members).join(t, "exchange", "left")
    cap = F.col("market_cap")
    ok = (cap >= F.coalesce("entry_cut", F.lit(0.0))) | (F.col("member") & (cap >= F.coalesce("exit_cut", F.lit(0.0))))
    return rows.where(ok).select(*caps.columns)


def investable(
    fundamentals: DataFrame,
    panel: DataFrame | None,
    statements: DataFrame | None = None,
    config: ScreenConfig | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """Tickers that pass every screen.

    The thresholds do not depend on each other, so the cascade is one join of
    per-ticker aggregates and one predicate; the panel is read once.
    """
    c = config or ScreenConfig()
    rows = flag_members(fundamentals, members)
    member = F.col("member")
    tests: list[Column] = []
    if "market_cap" in fundamentals.columns:
        tests.append(band_pass(F.col("market_cap"), c.market_cap, member))
        if "exchange" in fundamentals.columns:
            cuts = cap_thresholds(
                fundamentals, {"entry_cut": c.cap_percentile.entry, "exit_cut": c.cap_percentile.exit}, c.min_exchange_size
            )
            rows = rows.join(cuts, "exchange", "left")
            cap = F.col("market_cap")
            tests.append(
                (cap >= F.coalesce("entry_cut", F.lit(0.0)))
                | (member & (cap >= F.coalesce("exit_cut", F.lit(0.0))))
            )
    if "current_price" in fundamentals.columns:
        tests.append(band_pass(F.col("current_price"), c.price_us if c.region == "us" else c.price_europe, member))
    if panel is not None:
        p = with_axis(panel)
        def recent(window):
            return F.col("idx") > F.col("n_dates") - window
        dollars = F.col("close") * F.col("volume")
        stats = p.groupBy("ticker").agg(
            F.avg(F.when(recent(c.window_long), dollars)).alias("addv_long"),
            F.avg(F.when(recent(c.window_short), dollars)).alias("addv_short"),
            (F.count_if(recent(c.window_long) & (F.col("volume") > 0)) / F.max(F.least("n_dates", F.lit(c.window_long)))).alias("frequency"),
            F.count("close").alias("age"),
        )
        rows = rows.join(stats, "ticker", "left")
        tests += [
            band_pass(F.col("addv_long"), c.addv_long, member),
            band_pass(F.col("addv_short"), c.addv_short, member),
            band_pass(F.col("frequency"), c.frequency, member),
            F.coalesce(F.col("age") >= max(c.min_history, c.min_seasoning), F.lit(False)),
        ]
    if statements is not None:
        n = statements.groupBy("ticker").agg(
            F.count_if(F.col("period_type") == "annual").alias("n_annual"),
            F.count_if(F.col("period_type") == "quarterly").alias("n_quarterly"),
        )
        rows = rows.join(n, "ticker", "left")
        tests.append(
            (F.coalesce("n_annual", F.lit(0)) >= c.min_annual)
            | (F.coalesce("n_quarterly", F.lit(0)) >= c.min_quarterly)
        )
    keep = F.lit(True)
    for t in tests:
        keep = keep & t
    return rows.where(keep).select("ticker")


# Instrument filters: a rule is a Column that is null for a pass and else the reason.


def price_reason(rules: InstrumentRules) -> Column:
    """Current price, else regular price (0 counts as missing), inside the range."""
    p = F.coalesce(F.nullif(F.col("current_price"), F.lit(0.0)), F.col("regular_price"))
    return (
        F.when(p.isNull(), "no price")
        .when(p < rules.min_price, "price below minimum")
        .when(p > rules.max_price, "price above maximum")
    )


def market_cap_reason(rules: InstrumentRules) -> Column:
    c = F.col("market_cap")
    return F.when(c.isNull(), "no market cap").when(c < rules.min_market_cap, "market cap below minimum")


def cap_segment(rules: InstrumentRules) -> Column:
    c = F.col("market_cap")
    return F.when(c >= rules.large_cap, "large_cap").when(c >= rules.small_cap, "mid_cap").otherwise("small_cap")


def liquidity_reason(rules: InstrumentRules) -> Column:
    """Dollar and share volume against the tier of the cap segment."""
    seg = cap_segment(rules)
    def need(attr):
        e = F.lit(None).cast("double")
        for name, tier in rules.tiers.items():
            e = F.when(seg == name, float(getattr(tier, attr))).otherwise(e)
        return e
    price = F.coalesce(F.nullif(F.col("current_price"), F.lit(0.0)), F.col("regular_price"))
    shares = F.col("average_volume")
    return (
        F.when(F.col("market_cap").isNull(), "no market cap")
        .when(price.isNull(), "no price")
        .when(shares.isNull(), "no volume")
        .when(shares * price < need("min_dollars"), F.concat(seg, F.lit(": dollar volume")))
        .when(shares < need("min_shares"), F.concat(seg, F.lit(": share volume")))
    )


def missing_categories(categories: dict[str, tuple[Sequence[str], bool]]) -> Column:
    """Names of categories whose fields are missing; each maps to (fields, any field is enough)."""
    parts = []
    for name, (fields, any_of) in categories.items():
        have = [F.col(f).isNotNull() for f in fields]
        ok = have[0]
        for h in have[1:]:
            ok = (ok | h) if any_of else (ok & h)
        parts.append(F.when(~ok, name))
    return F.array_compact(F.array(*parts))


def coverage_reason(categories: dict[str, tuple[Sequence[str], bool]]) -> Column:
    missing = missing_categories(categories)
    more = F.when(F.size(missing) > 3, F.concat(F.lit(" +"), (F.size(missing) - 3).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(F.slice(missing, 1, 3), ", "), more))


def history_reason(rules: InstrumentRules) -> Column:
    n = F.coalesce(F.col("n_rows"), F.lit(0))
    return F.when(n < rules.min_history_rows, "short history")


def first_failure(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """First failing rule and its reason per row; both null for a pass."""
    name = F.coalesce(*[F.when(r.isNotNull(), F.lit(n)) for n, r in rules.items()])
    return df.withColumn("failed_rule", name).withColumn("reason", F.coalesce(*rules.values()))


def rule_counts(checked: DataFrame, names: Sequence[str]) -> DataFrame:
    """Passed and failed rows per rule; a row reaches only the rules up to its first failure. Rules that none reaches have 0 of both."""
    order = F.array(*[F.lit(n) for n in names])
    at = F.coalesce(F.array_position(order, F.col("failed_rule")), F.lit(len(names) + 1))
    reached = checked.groupBy(at.cast("int").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    steps = reached.select(
        F.explode(F.sequence(F.lit(1), F.least(F.col("at"), F.lit(len(names))))).alias("step"), "at", "n"
    )
    counts = steps.groupBy("step").agg(
        F.sum(F.when(F.col("at") > F.col("step"), F.col("n")).otherwise(0)).alias("passed"),
        F.sum(F.when(F.col("at") == F.col("step"), F.col("n")).otherwise(0)).alias("failed"),
    )
    every = checked.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names, 1)], "step int, rule string")
    return every.join(counts, "step", "left").select("rule", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("passed", "failed")])


def exchange_stocks(exchanges: DataFrame, instruments: DataFrame, allowed: Sequence[str], suffixes: dict[str, str]) -> DataFrame:
    """Instruments of type STOCK on allowed exchanges, joined over the schedule ids,
    with the ticker candidates (symbol with exchange suffix first, bare symbol next)."""
    schedules = exchanges.where(F.col("name").isin(*allowed)).select(
        F.col("name").alias("exchange"), F.explode("schedules").alias("schedule")
    ).select("exchange", F.col("schedule.id").alias("schedule_id"))
    suffix = F.create_map(*[F.lit(x) for kv in suffixes.items() for x in kv])
    symbol = F.replace(F.col("symbol"), F.lit("/"), F.lit("-"))
    return (
        instruments.where(F.col("type") == "STOCK")
        .join(schedules, "schedule_id")
        .withColumn("symbol", symbol)
        .withColumn("_suffix", F.element_at(suffix, F.col("exchange")))
        .select(
            "exchange", "instrument_id", "symbol",
            F.array_distinct(F.array_compact(F.array(F.concat("symbol", "_suffix"), F.col("symbol")))).alias("candidates"),
        )
    )
