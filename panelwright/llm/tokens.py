"""Delta-maintained token counts.

A batch is a table of signed changes: an insert adds a document's counts, a delete takes them
back, a revision does both. Changes are summed to totals by source, language and tokenizer
version before they are stored, one folder per batch. A batch that is committed again changes
nothing, so a job may be repeated after a loss.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.registry import query, table
from panelwright.session import cut, fresh_path

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]

_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary in a rank file, loaded once per process."""
    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(rows: DataFrame, text_columns: list[str], tokenizers: dict[str, str], keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and, for every text column, the struct <column>: n_bytes and n_tokens per tokenizer version.

    ``tokenizers`` maps a version to its rank file. Null counts nothing. A text that equals the one
    in the column before is not encoded again.
    """
    rows = rows.select(*keep, *[F.col(c).alias(f"_{c}") for c in text_columns])
    versions = sorted(tokenizers)
    flat = [(c, v) for c in text_columns for v in ("n_bytes", *versions)]
    schema = rows.select(*keep).schema
    for c, v in flat:
        schema = schema.add(f"{c}.{v}", "long")

    def counts(text: str) -> list[int]:
        return [len(text.encode()), *(len(encoder(tokenizers[v]).encode_ordinary(text)) for v in versions)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for texts in zip(*(batch.column(f"_{c}").to_pylist() for c in text_columns)):
                got: list[int] = []
                for k, t in enumerate(texts):
                    got += got[-len(versions) - 1:] if k and t == texts[k - 1] else counts(t or "")
                out.append(got)
            columns = zip(*out) if out else [()] * len(flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in columns)], names=schema.names)

    made = rows.mapInArrow(run, schema)
    return made.select(*keep, *[
        F.struct(F.col(f"`{c}.n_bytes`").alias("n_bytes"), F.array(*[
            F.struct(F.lit(v).alias("tokenizer"), F.col(f"`{c}.{v}`").alias("n_tokens")) for v in versions]).alias("counts")).alias(c)
        for c in text_columns])


def long_counts(counted: DataFrame, column: str) -> DataFrame:
    """A row per document and tokenizer version."""
    return counted.select("source", "lang", F.col(f"{column}.n_bytes").alias("n_bytes"), F.explode(f"{column}.counts").alias("c")).select(
        "source", "lang", "c.tokenizer", "c.n_tokens", "n_bytes")


def inserted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_bytes")


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(
        *KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"), (-F.col("n_bytes")).alias("n_bytes"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Take the old counts back and add the new ones; a document may change its source or language."""
    return deleted(old).unionByName(inserted(new))


class TokenRollup:
    """Totals in a shared folder, kept as one summed table per committed batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self.root}/batch={batch}/_SUCCESS")

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Store a batch once. False if it was committed before; half-written tries are replaced."""
        if self.committed(batch):
            return False
        totals = deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        totals.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/batch={batch}")  # a row per key of the totals
        return True

    def totals(self, batches: list[str]) -> DataFrame:
        """Totals over the given batches that are committed; keys whose documents are all gone are left out."""
        paths = [f"{self.root}/batch={b}" for b in batches if self.committed(b)]
        if not paths:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long")
        stored = self.spark.read.parquet(*paths)
        return stored.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).filter("n_docs <> 0 or n_tokens <> 0 or n_bytes <> 0")


TOKENIZERS = {
    "byte_bpe_50k": public_tokenizers.path("byte_bpe_50k.tiktoken"),
    "byte_bpe_multi_50k": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
}


def rollup_documents(docs: DataFrame, root: str, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """Load, revise and thin out a table of documents as three batches, one of them sent twice.

    ``load`` inserts every document. ``squeeze`` revises those whose text has runs of blanks to
    the text with single ones. ``unique`` deletes documents whose text an earlier doc_id has too
    (null ids come first; rows that repeat the first id stay). A null text counts no tokens and
    equals other null texts. Null sources and languages are keys of their own. Other columns are
    ignored, an empty table gives no totals.
    """
    tokenizers = TOKENIZERS if tokenizers is None else tokenizers
    rows = docs.select(
        "doc_id", "source", "lang", "text", F.regexp_replace("text", "  +", " ").alias("squeezed"),
        F.xxhash64("text").alias("same"), F.xxhash64(F.lit(1), "text").alias("alike"))
    counted = cut(count_tokens(rows, ["text", "squeezed"], tokenizers, ("doc_id", "source", "lang", "same", "alike")))
    first = counted.groupBy("same", "alike").agg(F.min(F.struct("doc_id")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = counted.join(first, ["same", "alike"]).filter(F.struct("doc_id") > F.col("first"))
    changed = counted.filter(F.col("text") != F.col("squeezed"))
    rollup = TokenRollup(docs.sparkSession, root)
    rollup.commit("load", inserted(long_counts(counted, "text")))
    for _ in range(2):  # the second time it is known
        rollup.commit("squeeze", revised(long_counts(changed, "text"), long_counts(changed, "squeezed")))
    rollup.commit("unique", deleted(long_counts(later, "squeezed")))
    return rollup.totals(["load", "squeeze", "unique"])


@query("op1_token_counts")
def op1_token_counts(spark, folder):
    return rollup_documents(table(spark, folder, "documents"), fresh_path(spark, "token-rollup"))
