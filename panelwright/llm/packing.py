"""Packing by non-negative least squares over shallow length combinations.

Documents are cut at multiples of the window; the last pieces are shorter. Only the histogram of
piece lengths, one number per length, reaches the driver. There combinations of two or three
lengths that fill the window are enumerated, their repeat counts are fitted to the histogram
without going below zero and rounded, and what is left over is packed greedily, longest first.
The plan says which ranks of a length go where; the pieces find their place by a join.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.registry import query, slices, table
from panelwright.llm.store import stored

_ENCODED = 20_000  # chunks that are encoded at a time
_MARK = r"([a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}])([.,]) "
_held: dict[str, list] = {}


@dataclass(frozen=True)
class PackingConfig:
    """``common`` lengths make up the triples; ``spread`` buckets number the pieces of one length in parallel.

    ``cache_chunks`` bounds a generation of chunks whose ids a process remembers.
    """

    window: int = 2048
    end_id: int = 1
    tokenizer: str = public_tokenizers.path("word_bpe_49k.json")
    common: int = 64
    sweeps: int = 200
    spread: int = 64
    cache_chunks: int = 250_000


def _chunk_ids(chunks: list[str], path: str, most: int) -> list[bytes]:
    """Ids of distinct chunks as little-endian unsigned 32-bit numbers.

    The process remembers two generations: when the younger is full it becomes the older, and what
    is met again moves up, so that frequent chunks stay.
    """
    if path not in _held:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; more threads hold more memory
        from tokenizers import Tokenizer

        _held[path] = [Tokenizer.from_file(path), {}, {}]
    tokenizer, young, old = _held[path]
    if len(young) > most:
        _held[path][1:] = young, old = {}, young
    made = [young.get(c) for c in chunks]
    missing = [i for i, x in enumerate(made) if x is None]
    new = []
    for i in missing:
        c = chunks[i]
        x = old.get(c)
        if x is None:
            new.append(i)
        else:
            made[i] = young[c] = x
    for j in range(0, len(new), _ENCODED):
        part = new[j: j + _ENCODED]
        for i, e in zip(part, tokenizer.encode_batch_fast([chunks[i] for i in part], add_special_tokens=False)):
            made[i] = young[chunks[i]] = array("I", e.ids).tobytes()
    return made


def encode(texts: pa.Array, path: str, cache_chunks: int = PackingConfig.cache_chunks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts, one after the other, and where each text's ids end.

    The vocabulary drops white space and never joins over it, so a text's ids are those of its
    chunks between blanks and line ends. To have fewer chunks, a mark that stands between a Latin
    letter (but for İ, whose lower case ends in a mark) and a blank is set apart, as the vocabulary
    does, and ASCII letters are lower-cased, as it does. Not so in texts with combining characters,
    which could make a difference, or ``<|``, with which the special tokens begin: those are known
    in their own spelling only.
    """
    texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
    as_is = pc.or_(pc.match_substring_regex(texts, r"\pM"), pc.match_substring(texts, "<|"))
    texts = pc.if_else(as_is, texts, pc.replace_substring_regex(pc.ascii_lower(texts), _MARK, r"\1 \2 "))
    split = pc.split_pattern(texts, " ")
    chunks = split.flatten().dictionary_encode()
    made = _chunk_ids(chunks.dictionary.to_pylist(), path, cache_chunks)
    sizes = np.array([len(x) for x in made], np.int64) // 4
    ids = np.frombuffer(b"".join(made), "<u4")
    which = chunks.indices.to_numpy(zero_copy_only=False)
    size = sizes[which]
    ends = np.cumsum(size)
    first = (np.cumsum(sizes) - sizes)[which]
    out = ids[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
    per_text = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
    return out, np.concatenate(([0], ends))[per_text]


def cut_pieces(docs: DataFrame, config: PackingConfig, batch_bytes: int = 3_000_000) -> DataFrame:
    """Pieces of at most a window: doc_id, start, length, ids_crc32, doc_tokens."""
    size, end = 4 * config.window, int(config.end_id).to_bytes(4, "little")
    schema = docs.select("doc_id").schema
    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        schema = schema.add(name, "long")

    def pieces(doc_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        ids, ends = encode(texts, config.tokenizer, config.cache_chunks)
        rows, begin = [], 0
        for i, stop in enumerate(ends.tolist()):
            raw = ids[begin:stop].tobytes() + end
            begin = stop
            rows += [(i, at // 4, len(raw[at: at + size]) // 4, zlib.crc32(raw[at: at + size]), len(raw) // 4) for at in range(0, len(raw), size)]
        row, *columns = zip(*rows)
        return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row)), *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch_bytes):
                yield pieces(part.column("doc_id"), part.column("text"))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def combinations(counts: np.ndarray, common: int) -> list[tuple[int, ...]]:
    """Pairs and triples of present lengths that fill the window; triples have two of the most common lengths."""
    window = len(counts) - 1
    present = np.flatnonzero(counts[:window]).tolist()
    have = set(present)
    out = {(window - a, a) for a in present if a <= window - a and window - a in have}
    top = sorted(present, key=lambda n: (-counts[n], n))[:common]
    for i, a in enumerate(top):
        for b in top[i:]:
            if (c := window - a - b) > 0 and c in have:
                out.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(out, reverse=True)


def fit_repeats(counts: np.ndarray, combos: list[tuple[int, ...]], sweeps: int) -> np.ndarray:
    """Non-negative least squares: repeats of each combination whose summed lengths come closest to the histogram.

    Coordinate descent; a combination touches three lengths at most.
    """
    left = counts.astype(float).copy()
    x = np.zeros(len(combos))
    columns = [tuple((n, c.count(n)) for n in sorted(set(c))) for c in combos]
    norm = [sum(k * k for _, k in col) for col in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, col in enumerate(columns):
            step = max(sum(k * left[n] for n, k in col) / norm[j], -x[j])
            if step:
                x[j] += step
                for n, k in col:
                    left[n] -= k * step
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def plan_sequences(counts: np.ndarray, config: PackingConfig = PackingConfig()) -> list[tuple[int, int, int, int, int, int]]:
    """Places of pieces: (length, first rank, end rank, first sequence, pieces per sequence, first offset).

    ``counts[n]`` pieces have length n, up to the window. Every rank of every length has one place.
    """
    window = len(counts) - 1
    left = counts.astype(np.int64).copy()
    used = np.zeros(window + 1, np.int64)
    plan, sequences = [], 0

    def place(lengths: tuple[int, ...], times: int) -> None:
        nonlocal sequences
        offset = 0
        for n in sorted(set(lengths), reverse=True):
            k = lengths.count(n)
            plan.append((n, int(used[n]), int(used[n]) + k * times, sequences, k, offset))
            used[n] += k * times
            left[n] -= k * times
            offset += k * n
        sequences += times

    if left[window]:
        place((window,), int(left[window]))
    combos = combinations(left, config.common)
    repeats = np.rint(fit_repeats(left, combos, config.sweeps)).astype(np.int64)
    for j in sorted(range(len(combos)), key=lambda j: (-repeats[j], j)):
        most = min(int(left[n]) // combos[j].count(n) for n in set(combos[j]))
        if times := min(int(repeats[j]), most):
            place(combos[j], times)
    while left.any():
        lengths, room = [], window
        free = left.copy()
        while room and (fit := np.flatnonzero(free[: room + 1])).size:
            n = int(fit[-1])
            k = min(int(free[n]), room // n)
            lengths += [n] * k
            free[n] -= k
            room -= k * n
        place(tuple(lengths), min(int(left[n]) // lengths.count(n) for n in set(lengths)))
    return plan


def pack(docs: DataFrame, config: PackingConfig = PackingConfig()) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` ids.

    A document's ids are those of its whole text (null: none) and the end id, so an empty text is
    one piece of one id. Repeated rows are packed one by one. Columns: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset; other columns are ignored, an empty table gives none.
    """
    pieces = cut_pieces(docs, config).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(config.spread)))
    pieces = stored(pieces, "pieces", batch_rows=1024)
    per_bucket = pieces.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))  # window * spread rows at most
    counts = np.zeros(config.window + 1, np.int64)
    for n, k in per_bucket.groupBy("length").agg(F.sum("_n")).collect():
        counts[n] = k
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("_rn", F.row_number().over(order)).join(offsets, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_rn") - 1)
    places = docs.sparkSession.createDataFrame(
        plan_sequences(counts, config) or [(0, 0, 0, 0, 1, 0)], "_length long, _from long, _to long, _first long, _each long, _offset long")
    rank, start, each = F.col("_rank"), F.col("_from"), F.col("_each")
    # the plan has as many rows as combinations and greedy patterns have lengths, whatever the number of pieces
    return ranked.join(F.broadcast(places), (F.col("length") == F.col("_length")) & (rank >= start) & (rank < F.col("_to"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_first") + F.floor((rank - start) / each)).cast("long").alias("sequence_id"),
        (F.col("_offset") + (rank - start) % each * F.col("length")).cast("long").alias("offset"))


@query("op3_packing")
def op3_packing(spark, folder):
    return pack(table(spark, folder, "documents"))
