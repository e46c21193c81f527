"""Train and test folds over the dates of a panel, as (fold, role, idx, date) tables.

Fold bounds are functions of the date count, so the folds come from sequences
that are exploded and joined to the date axis by index.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.errors import ConfigurationError
from panelwright.functions.dist import attach_one
from panelwright.operators.research import icir
from panelwright.sources.panel import date_axis


def _count(axis: DataFrame) -> DataFrame:
    return axis.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("t"))


def _windows(rows: DataFrame, spans: dict[str, tuple[Column, Column]], axis: DataFrame, *more: str) -> DataFrame:
    """Explode inclusive index spans per role and attach the dates."""
    parts = []
    for role, (lo, hi) in spans.items():
        steps = F.when(hi >= lo, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))
        parts.append(rows.select("fold", *more, F.lit(role).alias("role"), F.explode(steps).alias("idx")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(axis.select("idx", "date"), "idx").select("fold", *more, "role", "idx", "date")


def rolling_folds(panel: DataFrame, train: int = 36, test: int = 12, step: int = 6) -> DataFrame:
    """Fold i trains on ``train`` dates from i * step and tests on up to ``test`` dates after them."""
    axis = date_axis(panel)
    n = F.greatest(F.lit(0), F.floor((F.col("t") - train) / step)).cast("int")
    rows = _count(axis).withColumn("n", n).where("n > 0").select("t", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("fold"))
    start = F.col("fold") * step
    spans = {
        "train": (start + 1, start + train),
        "test": (start + train + 1, F.least(start + train + test, F.col("t"))),
    }
    rows = rows.where(start + train < F.col("t"))
    return _windows(rows, spans, axis)


def walk_forward(
    panel: DataFrame, test: int = 63, train: int = 252, purge: int = 0, expanding: bool = False, short_last: bool = False
) -> DataFrame:
    """Consecutive test windows, each after its training window and the purged gap."""
    axis = date_axis(panel)
    rest = F.col("t") - train - purge
    n = (F.ceil(rest / test) if short_last else F.floor(rest / test)).cast("int")
    rows = _count(axis).withColumn("n", n).where("n > 0").select("t", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("fold"))
    first = F.col("fold") * test + train + purge
    spans = {
        "train": (F.lit(1) if expanding else F.col("fold") * test + 1, F.col("fold") * test + train),
        "test": (first + 1, F.least(first + test, F.col("t"))),
    }
    return _windows(rows, spans, axis)


def _combinations(spark, n_blocks: int, n_test: int) -> DataFrame:
    """(fold, blocks): every choice of test blocks in lexicographic order."""
    if not 1 <= n_test < n_blocks:
        raise ConfigurationError("need 1 <= test blocks < blocks")
    rows = spark.range(n_blocks).select(F.array(F.col("id").cast("int")).alias("blocks"))
    for k in range(1, n_test):
        later = F.sequence(F.get("blocks", F.lit(k - 1)) + 1, F.lit(n_blocks - 1))
        rows = rows.where(F.get("blocks", F.lit(k - 1)) < n_blocks - 1).select(
            "blocks", F.explode(later).alias("b")).select(F.concat("blocks", F.array("b")).alias("blocks"))
    return rows.select((F.row_number().over(Window.orderBy("blocks")) - 1).alias("fold"), "blocks")


def combinatorial_folds(
    panel: DataFrame, n_blocks: int = 10, n_test: int = 2, purge: int = 0, embargo: int = 0
) -> DataFrame:
    """Every choice of test blocks; training dates near a test block (purge, both sides)
    or right after one (embargo) are left out. Adds the block number of each date."""
    axis = date_axis(panel)
    combos = attach_one(_combinations(panel.sparkSession, n_blocks, n_test), _count(axis))
    rows = combos.select("fold", "blocks", "t", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("i"))
    size = F.floor(F.col("t") / n_blocks)
    block = F.least(F.floor(F.col("i") / size), F.lit(n_blocks - 1)).cast("int")
    start = lambda b: b * size
    end = lambda b: F.when(b == n_blocks - 1, F.col("t")).otherwise((b + 1) * size)
    i = F.col("i")
    is_test = F.array_contains("blocks", F.col("block"))
    near = F.exists("blocks", lambda b: (i >= start(b) - purge) & (i < end(b) + max(purge, embargo)))
    rows = rows.withColumn("block", block).withColumn("role", F.when(is_test, "test").when(~near, "train"))
    rows = rows.where(F.col("role").isNotNull()).withColumn("idx", F.col("i") + 1)
    both = Window.partitionBy("fold")
    rows = rows.withColumn("_tr", F.count_if(F.col("role") == "train").over(both)).where("_tr > 0")
    return rows.join(axis.select("idx", "date"), "idx").select("fold", "role", "block", "idx", "date")


def test_paths(folds: DataFrame) -> DataFrame:
    """(path, block, fold): the k-th fold that tests a block belongs to path k,
    so every path covers each block once."""
    tests = folds.where(F.col("role") == "test").select("block", "fold").distinct()
    return tests.select(
        (F.row_number().over(Window.partitionBy("block").orderBy("fold")) - 1).alias("path"), "block", "fold"
    )


def fold_count_search(
    panel: DataFrame, target_train: int, target_paths: int, weight_train: float = 1.0, weight_paths: float = 1.0, max_blocks: int = 20
) -> DataFrame:
    """Grid of (blocks, test blocks) scored by the relative distance of the mean training
    size and the path count to their targets; ``best`` marks the smallest."""
    grid = [
        (n, k, comb(n, k) * k // n) for n in range(3, max_blocks + 1) for k in range(2, n)
    ]
    rows = panel.sparkSession.createDataFrame(grid, "n_blocks int, n_test int, n_paths long")
    rows = attach_one(rows, _count(date_axis(panel)))
    train = F.col("t") / F.col("n_blocks") * (F.col("n_blocks") - F.col("n_test"))
    cost = (
        weight_train * F.abs(train - target_train) / target_train
        + weight_paths * F.abs(F.col("n_paths") - target_paths) / target_paths
    )
    rows = rows.withColumn("train_size", train).withColumn("cost", F.round(cost, 9))
    best = F.row_number().over(Window.orderBy("cost", "n_blocks", "n_test")) == 1
    return rows.select("n_blocks", "n_test", "n_paths", "train_size", "cost", best.alias("best"))


def random_subset_folds(
    panel: DataFrame, n_draws: int, n_assets: int, window: int, test: int, train: int, seed: int = 7
) -> DataFrame:
    """(draw, ticker, fold, role, idx, date): asset subsets x date windows x walk-forward.

    A draw keeps the assets with the smallest value of a whole-number hash of
    (asset, draw, seed) and starts its window at a hashed date, so a rerun or
    another engine gets the same draws.
    """
    axis = date_axis(panel)
    names = panel.select("ticker").distinct()
    draws = names.select("ticker", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw"))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", "ticker", "draw", F.lit(seed))), 1, 12), 16, 10).cast("long")
    w = Window.partitionBy("draw").orderBy("h", "ticker")
    subset = draws.withColumn("h", key).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n_assets)
    span = F.greatest(F.col("t") - window + 1, F.lit(1))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("window"), "draw", F.lit(seed))), 1, 12), 16, 10).cast("long")
    starts = _count(axis).select(F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw"), "t").withColumn("start", F.pmod(h, span))
    n = F.floor((F.least(F.lit(window), F.col("t")) - train) / test).cast("int")
    rows = starts.withColumn("n", n).where("n > 0").select("draw", "start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("fold"))
    first = F.col("start") + F.col("fold") * test
    spans = {"train": (first + 1, first + train), "test": (first + train + 1, first + train + test)}
    return _windows(rows, spans, axis, "draw").join(subset.select("draw", "ticker"), "draw")


def out_of_sample(ic: DataFrame, spreads: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, factor, mean_ic, mean_spread) over each fold's test dates.

    IC and spread are computed once per date; folds only average them.
    """
    tests = folds.where(F.col("role") == "test").select("fold", "date")
    a = tests.join(ic, "date").groupBy("fold", "factor").agg(F.avg("ic").alias("mean_ic"))
    b = tests.join(spreads.where(F.col("spread").isNotNull()), "date").groupBy("fold", "factor").agg(F.avg("spread").alias("mean_spread"))
    return a.join(b, ["fold", "factor"], "full")


def out_of_sample_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and ICIR of the fold ICs per factor."""
    rows = per_fold.select("factor", F.col("mean_ic").alias("ic"))
    return rows.groupBy("factor").agg(F.avg("ic").alias("mean_oos_ic")).join(icir(rows), "factor")
