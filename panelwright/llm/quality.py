"""Quality rules by suffix arrays: repeated passages within a document.

The words of a batch of documents are ranked by prefix doubling. Neighbours in suffix order
with a common prefix of eight words or more bound the LCP intervals, whose maximal repeated
substrings are united to the covered part of a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import suffix
from panelwright.llm.registry import query, slices, table

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
BATCH_BYTES = 500_000


@dataclass(frozen=True)
class QualityRules:
    """Limits of a document that stays. ``window`` is the shortest repeat that counts, in words."""

    min_words: int = 20
    window: int = 8
    max_repeat_words: int = 30  # percent of the words in repeated windows
    max_covered: int = 30  # percent of the characters under repeated substrings
    max_longest: int = 25  # percent of the words in the longest repeated substring


def repeats(documents: list[list[str]], window: int) -> tuple[list[int], list[int], list[int]]:
    """Per document: words and characters covered by repeats of ``window`` words, and the longest repeat in words (0 below a window)."""
    codes, lengths, sizes = [], [], []
    base = 0
    for words in documents:
        known = {w: i for i, w in enumerate(dict.fromkeys(words))}
        codes.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)) + base)
        base += len(known) + 1
        codes.append(np.array([base - 1]))  # ends the document: equal to nothing
        lengths.append(len(words) + 1)
        sizes.append(np.fromiter(map(len, words), np.int64, len(words)))
        sizes.append(np.zeros(1, np.int64))
    if not documents:
        return [], [], []
    n_docs, code, size = len(documents), np.concatenate(codes), np.concatenate(sizes)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    ranked = suffix.levels(suffix.dense_ranks(code), 1)
    order = np.argsort(ranked[-1][1])
    near = max((r for r in ranked if r[0] <= window), key=lambda r: r[0])[1][order]
    pair = np.flatnonzero(near[1:] == near[:-1])  # neighbours that may share a window
    a, b = order[pair], order[pair + 1]
    lcp = suffix.common_prefix(ranked, a, b)
    longest = np.zeros(len(code), np.int64)  # longest repeat that starts here
    longest[b] = lcp
    longest[a] = np.maximum(longest[a], lcp)
    longest[longest < window] = 0
    at = np.flatnonzero(longest >= window)
    a, b = suffix.union_spans(at, at + longest[at])
    upto = np.concatenate(([0], np.cumsum(size)))
    doc = np.searchsorted(starts, a, side="right") - 1
    covered = np.bincount(doc, weights=b - a, minlength=n_docs).astype(int).tolist()
    chars = np.bincount(doc, weights=upto[b] - upto[a], minlength=n_docs).astype(int).tolist()
    most = np.maximum.reduceat(longest, starts[:-1]).tolist()
    return covered, chars, most


def _measure(texts: list[str], rules: QualityRules) -> dict[str, list]:
    words = [WORD.findall(t) for t in texts]
    n_words = [len(w) for w in words]
    word_chars = [sum(map(len, w)) for w in words]
    dup_lines = []
    for t in texts:
        lines = [x for x in t.split("\n") if WORD.search(x)]
        dup_lines.append(len(lines) - len(set(lines)))
    repeated, chars, longest = repeats(words, rules.window)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": [len(SYMBOL.findall(t)) for t in texts],
        "n_dup_lines": dup_lines, "n_repeat_words": repeated, "n_repeat_chars": chars, "n_longest_repeat": longest}


def quality_report(docs: DataFrame, rules: QualityRules = QualityRules(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Measures and verdict per document, in one pass without a shuffle.

    Words are runs of other characters than blank and U+0009 to U+000D. A null text has no words,
    fails ``min_words`` and is not kept. Repeated rows are judged one by one. ``keep`` names more
    columns to carry along; others are dropped. ``n_repeat_chars`` counts characters of covered
    words, ``n_longest_repeat`` the words of the longest repeated substring.
    """
    carried = ["doc_id", *keep]
    rows = docs.select(*carried, *([] if "text" in keep else ["text"]))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeat_chars", "n_longest_repeat"]
    schema = rows.select(*carried).schema
    for n in names:
        schema = schema.add(n, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, BATCH_BYTES):
                got = _measure([t or "" for t in part.column("text").to_pylist()], rules)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carried), *(pa.array(got[n], pa.int64()) for n in names)], names=[*carried, *names])

    n = F.col("n_words")
    base_failed = (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_words * n)
    method_failed = (100 * F.col("n_repeat_chars") > rules.max_covered * F.col("word_chars")) | (
        (F.col("n_longest_repeat") >= rules.window) & (100 * F.col("n_longest_repeat") > rules.max_longest * n))
    return (
        rows.mapInArrow(run, schema).withColumn("base_failed", base_failed)
        .withColumn("kept", ~(F.col("base_failed") | method_failed))
    )


@query("op6_quality_rules")
def op6_quality_rules(spark, folder):
    return quality_report(table(spark, folder, "documents"))
