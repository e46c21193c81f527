"""Session helpers: the shared folder for checkpoints, streams and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from panelwright.errors import ConfigurationError

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    one machine runs everything, may fall back to a fresh temporary folder.
    """
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not sc.master.startswith("local"):
        raise ConfigurationError(f"set {_SETTING} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="panelwright-")
    sc.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialize in the shared folder and drop the lineage."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
