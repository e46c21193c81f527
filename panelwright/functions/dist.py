"""Ranks, quantiles and statistics of groups that may not fit in one task.

A cross-section (all names of one date) grows with the data, so none of the
helpers sorts more than ``RANGE_ROWS`` rows of a group in one task. A larger group is
split into ranges by a monotone function, and a range that is still larger between its
own smallest and largest value, again and again, until each is small or holds a single
value. Counts per range (pre-aggregated before the shuffle) give its rank offset, and
only the values inside a range are sorted together. Results are exact. Rows are written
before the first split, as every round must meet the same doubles: two evaluations of
a sum may differ in the last digit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.session import cut

# ln(|x|) of a double lies in [-745, 710]; with 64 bins per e-fold the bin
# number has at most 2 * 93,120 values whatever the data are.
_BINS_PER_EFOLD = 64
_BIN_SHIFT = 745 * _BINS_PER_EFOLD + 1


def value_bin(x: Column) -> Column:
    """Monotone bin number of a double; equal values share a bin."""
    size = F.floor(F.ln(F.abs(x)) * _BINS_PER_EFOLD).cast("long") + F.lit(_BIN_SHIFT)
    return F.when(x == 0, F.lit(0).cast("long")).when(x > 0, size).otherwise(-size)


# Keys whose number of values is bounded whatever the data are: calendar days and factors.
_BOUNDED_KEYS = {"date", "factor"}


def by_calendar(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Broadcast hint for a table with a fixed few rows per date and factor.

    Thirty years of days times all factors stay in the tens of megabytes, so the long
    side need not be shuffled by date for the join. Other keys are left to adaptive
    execution, which goes by measured sizes.
    """
    return F.broadcast(table) if keys and set(keys) <= _BOUNDED_KEYS else table


# Rows of a range that one task sorts, and the parts a larger range is split into.
RANGE_ROWS = 100_000
SPLIT = 1024
# Doubles of one first range differ in 46 bits; each round but one in the denormal numbers takes ten of them.
MOST_ROUNDS = 32


def large_groups(rows: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a group has more rows than one task may sort; a count per group, whatever else the rows hold."""
    return not rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt")).where(F.col("_cnt") > RANGE_ROWS).isEmpty()


def in_ranges(rows: DataFrame, keys: Sequence[str], *order: Column) -> tuple[DataFrame, list[str], DataFrame]:
    """Rows with the numbers of their range, the names of these columns, and the ranges.

    Ranges follow the numbers ``order`` (no nulls), compared one after the other. The first split is
    by ``value_bin``; a range above ``RANGE_ROWS`` is split evenly between the least and the largest
    value of the first number that differs in it, which always takes these two apart. There are
    as many rounds as the data ask for, mostly none. A range has _cnt, _flat (all numbers equal),
    _off (rows of the group before it) and _n (rows of the group).
    """
    rows = cut(rows).select("*", value_bin(order[0]).alias("_b0"))
    path = ["_b0"]
    ends = [f(x).alias(f"_{n}{i}") for i, x in enumerate(order) for n, f in (("lo", F.min), ("hi", F.max))]
    flat = F.lit(True)
    for i in range(len(order)):
        flat = flat & (F.col(f"_lo{i}") == F.col(f"_hi{i}"))
    for left in reversed(range(MOST_ROUNDS)):
        counts = rows.groupBy(*keys, *path).agg(F.count(F.lit(1)).alias("_cnt"), *ends).withColumn("_flat", flat)
        large = counts.where((F.col("_cnt") > RANGE_ROWS) & ~F.col("_flat"))
        if not left or large.isEmpty():
            break
        level, lo, hi = F.lit(None), F.lit(None), F.lit(None)
        for i in reversed(range(len(order))):
            differs = F.col(f"_lo{i}") < F.col(f"_hi{i}")
            level = F.when(differs, i).otherwise(level)
            lo, hi = F.when(differs, F.col(f"_lo{i}")).otherwise(lo), F.when(differs, F.col(f"_hi{i}")).otherwise(hi)
        large = cut(large.select(*keys, *path, level.alias("_level"), lo.cast("double").alias("_lo"), hi.cast("double").alias("_hi")))
        x = F.lit(None)
        for i, o in enumerate(order):
            x = F.when(F.col("_level") == i, o.cast("double")).otherwise(x)
        part = F.least(F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SPLIT), F.lit(SPLIT - 1))
        new = f"_b{len(path)}"
        rows = rows.join(large, [*keys, *path], "left").withColumn(new, F.coalesce(part, F.lit(-1)).cast("int")).drop("_level", "_lo", "_hi")
        path.append(new)
    group = Window.partitionBy(*keys)
    before = group.orderBy(*path).rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.select(
        *keys, *path, "_cnt", "_flat", F.coalesce(F.sum("_cnt").over(before), F.lit(0).cast("long")).alias("_off"), F.sum("_cnt").over(group).alias("_n"))
    return rows, path, ranges


def with_average_ranks(df: DataFrame, keys: Sequence[str], outs: dict[str, str], n_out: str | None = None) -> DataFrame:
    """Average rank (ties share the mean rank) of each value column in its group.

    ``outs`` maps a value column to the name of its rank. Rows with a null in one of
    them are dropped. The offsets of all columns come from ``df`` itself, so ranking
    two columns does not rank one on top of the other.

    A range that holds one single value needs no sort: its rows are spread over salted
    window partitions and take the middle of the range, so a value shared by a third of
    the rows does not end up in one task.
    """
    rows = df
    for value in outs:
        rows = rows.where(F.col(value).isNotNull())
    if not large_groups(rows, keys):
        group = Window.partitionBy(*keys)
        ranks = {}
        for value, out in outs.items():
            inside = group.orderBy(F.col(value).cast("double"))
            peers = inside.rangeBetween(Window.currentRow, Window.currentRow)
            ranks[out] = F.rank().over(inside) - 1 + (F.count(F.lit(1)).over(peers) + 1) / 2.0
        if n_out:
            ranks[n_out] = F.count(F.lit(1)).over(group)
        return rows.select(*[c for c in rows.columns if c not in ranks], *[x.alias(c) for c, x in ranks.items()])
    ranked = rows
    for value, out in outs.items():
        have = ranked.columns
        dealt, path, ranges = in_ranges(ranked, keys, F.col(value).cast("double"))
        salt = F.pmod(F.xxhash64(*rows.columns), F.lit(64))
        # a window key of its own, so the partitions are cut anew after the join
        inside = Window.partitionBy(*keys, *path, "_slot").orderBy(value)
        peers = inside.rangeBetween(Window.currentRow, Window.currentRow)
        local = F.rank().over(inside) - 1 + (F.count(F.lit(1)).over(peers) + 1) / 2.0
        ranked = (
            dealt.join(ranges, [*keys, *path])
            .withColumn("_slot", F.when(F.col("_flat"), salt).otherwise(0))
            .withColumn("_local", local)
            .select(
                *[c for c in have if c != n_out],
                (F.col("_off") + F.when(F.col("_flat"), (F.col("_cnt") + 1) / 2.0).otherwise(F.col("_local"))).alias(out),
                *([F.col("_n").alias(n_out)] if n_out else []),
            )
        )
    return ranked


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, n_out: str | None = None) -> DataFrame:
    """``with_average_ranks`` of one column."""
    return with_average_ranks(df, keys, {value: out}, n_out)


def _text_code(c: Column, first: int = 1) -> Column:
    """Order-preserving number (1 or more) of six bytes of a string from ``first`` on; 0 for a null."""
    head = F.hex(F.substring(F.encode(c, "UTF-8"), first, 6))
    return F.coalesce(F.conv(F.rpad(head, 12, "0"), 16, 10).cast("long") + 1, F.lit(0).cast("long"))


def with_row_number(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: str,
    out: str,
    n_out: str,
) -> DataFrame:
    """Ascending row number of non-null values, ties broken by the string ``tie``, and the group size.

    Only rows of one range meet in one sort; rows of one value are dealt by the leading bytes of
    ``tie``, so that a value many rows share is split too.
    """
    x = F.col(value).cast("double")
    known = df.where(x.isNotNull())
    if not large_groups(known, keys):
        group = Window.partitionBy(*keys)
        return known.select(
            *df.columns, F.row_number().over(group.orderBy(x, tie)).cast("long").alias(out), F.count(F.lit(1)).over(group).alias(n_out))
    codes = [_text_code(F.col(tie), at) for at in (1, 7, 13, 19)]
    rows, path, ranges = in_ranges(known, keys, x, *codes)
    inside = Window.partitionBy(*keys, *path).orderBy(value, tie)
    return (
        rows.join(ranges, [*keys, *path])
        .withColumn("_in", F.row_number().over(inside))
        .select(*df.columns, (F.col("_off") + F.col("_in")).cast("long").alias(out), F.col("_n").alias(n_out))
    )


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], n_out: str | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Ranges that hold none of the wanted order statistics are dropped before any
    value is shuffled, so the second pass moves a small part of the rows.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    def at(p: float) -> Column:
        # Snapped, so that 0.6 * 95 is position 57 and not a hair beside it.
        return F.round(F.lit(float(p)) * (F.col("_n") - 1), 9)

    def low(p: float) -> Column:
        return F.floor(at(p))

    def high(p: float) -> Column:
        return F.ceil(at(p))

    if not large_groups(known, keys):
        group = Window.partitionBy(*keys)
        below = group.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        ranked = known.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")).select(
            *keys, "_v", F.sum("_c").over(group).alias("_n"), F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_less"))
    else:
        rows, path, offsets = in_ranges(known, keys, F.col("_v"))
        wanted = F.lit(False)
        for p in probs.values():
            for pos in (low(p), high(p)):
                wanted = wanted | ((F.col("_off") <= pos) & (pos < F.col("_off") + F.col("_cnt")))
        hit = offsets.where(wanted).select(*keys, *path, "_off", "_n")
        inside = Window.partitionBy(*keys, *path).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        ranked = (
            rows.join(by_calendar(hit, keys), [*keys, *path])
            .groupBy(*keys, *path, "_off", "_n", "_v")
            .agg(F.count(F.lit(1)).alias("_c"))
            .withColumn("_less", F.col("_off") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
        )
    picks: list[Column] = [F.max("_n").alias("_n")]
    for name, p in probs.items():
        picks.append(F.max(F.when(F.col("_less") <= low(p), F.col("_v"))).alias(f"_lo_{name}"))
        picks.append(F.max(F.when(F.col("_less") <= high(p), F.col("_v"))).alias(f"_hi_{name}"))
    found = ranked.groupBy(*keys).agg(*picks)
    out = []
    for name, p in probs.items():
        frac = at(p) - low(p)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * frac).alias(name))
    if n_out:
        out.append(F.col("_n").alias(n_out))
    return found.select(*keys, *out)


def with_group_stats(
    df: DataFrame, keys: Sequence[str], *aggs: Column, how: str = "left"
) -> DataFrame:
    """Join aggregates of the group back to its rows.

    A plain aggregate and join instead of a window: partial aggregation keeps a
    hot group cheap, and the join side has one row per group, which adaptive
    execution broadcasts when its measured size allows and skew-splits otherwise.
    """
    stats = df.groupBy(*keys).agg(*aggs)
    return df.join(by_calendar(stats, keys), list(keys), how) if keys else attach_one(df, stats)


def attach_one(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (a global aggregate) to every row.

    The broadcast is safe by construction: an aggregate without keys is one row.
    """
    return (
        df.withColumn("_k", F.lit(1))
        .join(F.broadcast(one.withColumn("_k", F.lit(1))), "_k")
        .drop("_k")
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rnk") -> DataFrame:
    """First k rows of each group; Spark trims every map task to k rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
