"""Tables that are read more than once, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import fresh_path


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write as Parquet to the shared folder and read again: cut lineage, column pruning and statistics.

    ``batch_rows`` bounds the rows of an Arrow batch meanwhile, for functions over wide rows.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, label), spark.conf.get(BATCH_ROWS, None)
    if batch_rows:
        spark.conf.set(BATCH_ROWS, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        if batch_rows:
            spark.conf.unset(BATCH_ROWS) if before is None else spark.conf.set(BATCH_ROWS, before)
    return spark.read.parquet(path)


def components(links: DataFrame) -> DataFrame:
    """Smallest node that each linked node reaches: (node, label). ``links`` has longs a and b.

    Rounds of large and small stars: neighbours are hung on the smallest node around, until
    every edge is one from a node to its label. Every round is an aggregate and a join by node.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if mark == before or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
