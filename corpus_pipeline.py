"""Corpus cleaning as a chain of stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.decontaminate import drop_leaked
from panelwright.llm.jaccard import one_of_each
from panelwright.llm.packing import PackingConfig, pack
from panelwright.llm.quality import quality_report
from panelwright.llm.repeats import without_repeats
from panelwright.llm.store import BATCH_ROWS
from panelwright.session import fresh_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """What all stages read. Whole texts go to the workers in small Arrow batches, as every stage adds to the memory of the same executors."""
    spark.conf.set(BATCH_ROWS, "1000")
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_report(documents(spark, docs), keep=tuple(COLUMNS[1:])).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: five-word shingles, similarity 0.8."""
    return one_of_each(documents(spark, docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that occur earlier; a document of which nothing is left goes."""
    return without_repeats(documents(spark, docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaked(documents(spark, docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in the training sequences."""
    return pack(documents(spark, docs), PackingConfig(cache_chunks=80_000))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

# SQL expresses none of: suffix arrays over all documents, random walks, tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
