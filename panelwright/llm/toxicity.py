"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positive class. The unlabelled one is drawn from the rows that
were looked at, without regard to what was found, so its share of toxic texts is the prior. The risk estimator weighs positives by the class prior and takes their share
out of the unlabelled part; where that part falls below zero the model fits noise, and the
step goes the other way. Features are words and word beginnings.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.registry import query, table

LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityConfig:
    """``max_positives`` and ``max_unlabelled`` bound the training sample, taken by hash of the id."""

    max_positives: int = 1_500
    max_unlabelled: int = 3_000
    max_features: int = 1_024
    min_positives: int = 4  # positives that a feature must occur in
    prefixes: tuple[int, int] = (5, 9)
    members: int = 3  # classifiers, each on its own four fifths of the sample
    steps: int = 200
    rate: float = 0.05
    l2: float = 2e-4
    threshold: float = 0.3
    cache_words: int = 400_000


def features(word: str, lengths: tuple[int, int]) -> list[str]:
    """The word itself, and its beginnings of the given lengths."""
    return [f"{word} ", *(word[:n] for n in range(lengths[0], min(lengths[1], len(word)) + 1))]


def _count_features(texts: Iterable[str], names: dict[str, int], config: ToxicityConfig, grow: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its features as numbers and the distinct words that have them; unknown features are numbered or left out."""
    out = []
    for t in texts:
        found: dict[int, int] = {}
        for w in set(LETTERS.findall(t.lower())):
            for f in features(w, config.prefixes):
                k = names.setdefault(f, len(names)) if grow else names.get(f)
                if k is not None:
                    found[k] = found.get(k, 0) + 1
        out.append((np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.float32, len(found))))
    return out


def _log_loss_gradient(x: np.ndarray, z: np.ndarray, sign: int) -> np.ndarray:
    """Gradient of the mean logistic loss of margins ``sign * z``; the last entry is the bias."""
    if not len(x):
        return np.zeros(x.shape[1] + 1)
    g = (-sign / (1 + np.exp(np.clip(sign * z, -60, 60))) / len(z)).astype(np.float32)
    return np.append(x.T @ g, g.sum())


def _mean_loss(z: np.ndarray, sign: int) -> float:
    return float(np.logaddexp(0, -sign * z).mean()) if len(z) else 0.0


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, config: ToxicityConfig) -> np.ndarray:
    """Weights and bias of a logistic model by the non-negative risk estimator (Adam, full batches)."""
    w = np.zeros(positive.shape[1] + 1, np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, config.steps + 1):
        zp, zu = positive @ w[:-1] + w[-1], unlabelled @ w[:-1] + w[-1]
        negative_risk = _mean_loss(zu, -1) - prior * _mean_loss(zp, -1)
        of_negative = _log_loss_gradient(unlabelled, zu, -1) - prior * _log_loss_gradient(positive, zp, -1)
        grad = prior * _log_loss_gradient(positive, zp, 1) + of_negative if negative_risk >= 0 else -of_negative
        grad[:-1] += config.l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= config.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


@dataclass(frozen=True)
class ToxicityModel:
    names: dict[str, int]
    weights: np.ndarray  # one row per member, bias last
    config: ToxicityConfig

    def score(self, texts: list[str], cache: dict[str, tuple[int, ...]]) -> np.ndarray:
        """Mean probability of the members. ``cache`` keeps the features of words between calls."""
        if len(cache) > self.config.cache_words:
            cache.clear()
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            found: dict[int, int] = {}
            for word in set(LETTERS.findall(t.lower())):
                known = cache.get(word)
                if known is None:
                    known = cache[word] = tuple(self.names[f] for f in features(word, self.config.prefixes) if f in self.names)
                for k in known:
                    found[k] = found.get(k, 0) + 1
            z = self.weights[:, list(found)] @ np.log2(1 + np.fromiter(found.values(), np.float32, len(found))) + self.weights[:, -1]
            out[i] = (1 / (1 + np.exp(-np.clip(z, -30, 30)))).mean()
        return out


def train(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); the caller leaves out held-out rows of both."""
    known = labels.filter("toxic is not null and doc_id is not null").select("doc_id", "toxic")
    n, p = known.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    prior = min(max((p or 0) / n, 1e-4), 0.5) if n else 1e-4
    texts = docs.filter("text is not null").select("doc_id", "text")
    toxic = known.filter("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.max_positives)
    drawn = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(config.max_unlabelled)
    sample = toxic.withColumn("part", F.lit(1)).unionByName(drawn.withColumn("part", F.lit(0)))
    rows = texts.join(F.broadcast(sample), "doc_id").orderBy("part", F.xxhash64("doc_id"), "text").collect()  # the bounded sample
    numbers: dict[str, int] = {}
    positive = _count_features((r["text"] for r in rows if r["part"] == 1), numbers, config, grow=True)
    in_p = np.bincount(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in positive)]), minlength=len(numbers))
    often = {f: k for f, k in numbers.items() if in_p[k] >= config.min_positives}
    del numbers
    unlabelled = _count_features((r["text"] for r in rows if r["part"] == 0), often, config, grow=False)
    in_u = np.bincount(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in unlabelled)]), minlength=len(in_p))
    gain = {}
    for f, k in often.items():
        a, b = (in_p[k] + 0.5) / (len(positive) + 1), (in_u[k] + 0.5) / (len(unlabelled) + 1)
        if a > b:
            gain[f] = np.log(a / b) * a
    kept = sorted(gain, key=lambda f: (-gain[f], f))[: config.max_features]
    names = {f: i for i, f in enumerate(kept)}
    place = np.full(len(in_p) + 1, -1)
    place[[often[f] for f in kept]] = np.arange(len(kept))

    def matrix(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        x = np.zeros((len(found), len(names)), np.float32)
        for i, (k, n) in enumerate(found):
            at = place[k]
            x[i, at[at >= 0]] = np.log2(1 + n[at >= 0])
        return x

    if not positive or not unlabelled:
        w = np.zeros(len(names) + 1)
        w[-1] = np.log(prior / (1 - prior))
        return ToxicityModel(names, w[None, :], config)
    xp, xu = matrix(positive), matrix(unlabelled)
    members = []
    fold_p, fold_u = (np.array([zlib.crc32(b"%d" % r["doc_id"]) // 4 % 5 for r in rows if r["part"] == part]) for part in (1, 0))
    for k in range(config.members):  # a text is left out of both samples or of neither
        members.append(fit_nnpu(xp[fold_p != k], xu[fold_u != k], prior, config))
    return ToxicityModel(names, np.array(members), config)


def score_documents(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every document's whole text; a null text is scored as an empty one. One pass without a shuffle.

    Columns: doc_id, those of ``keep``, score (0 to 1), predicted.
    """
    carried = ["doc_id", *keep]
    rows = docs.select(*carried, F.col("text").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_features names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            got = shared.value.score([t or "" for t in batch.column("_text").to_pylist()], cache)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(got)], names=[*carried, "score"])

    scored = rows.mapInArrow(run, rows.select(*carried).schema.add("score", "double"))
    return scored.withColumn("predicted", (F.col("score") >= model.config.threshold).cast("int"))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """Train on the rows that are not held out and score all.

    Rows are held out by crc32 of the id; a null id is not, and has no label. Without a positive
    example every score is the class prior, without labels next to 0. Rows of the same id are
    scored one by one. Labels, lang, source and doc_id are no inputs of a score.
    """
    model = train(docs.filter(~held_out()), labels.filter(~held_out()), config)
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op5_toxicity")
def op5_toxicity(spark, folder):
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
