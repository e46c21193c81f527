"""Removal of repeated byte strings across documents by longest-previous-factor arrays.

A byte goes when a string of ``length`` bytes covers it that also starts earlier. Sorting all
suffixes of a corpus would move many times its size, so the suffixes are first thinned out:

1. Every window of ``length`` bytes has an anchor, the ``GRAM``-byte gram in it with the smallest
   hash. Equal windows have equal anchors. The windows that share an anchor are a run; a run's
   context is all the bytes that its windows read. Runs meet by the anchor's hash.
2. A run whose context occurs earlier goes whole. A first context whose anchor occurs in no other
   context has no earlier match. Only first contexts of anchors with several contexts remain.
3. The remaining contexts meet by anchor, and each task builds a suffix array of its contexts.
   Previous and next smaller positions in suffix order give the longest previous factor.

An anchor with more than ``group_limit`` contexts is not gathered in a task: its windows meet
one by one by two 64-bit hashes, where the earliest place is a partial aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm import suffix
from panelwright.llm.registry import give_back, query, slices, table
from panelwright.session import cut

GRAM = 32
BLOCK = 7  # bytes that a rank of the lowest level holds, beside their number
CHUNK = 1 << 18  # bytes that are hashed at a time; longer documents are cut into overlapping parts
SLICE = 2_000_000  # bytes of text that a worker takes from an Arrow batch at a time
PLACE_BITS = 22
_MADE = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2**64, kept by the process up to the length of a buffer."""
    p = _known.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, CHUNK + 1), base, np.uint64)
        p[0] = 1
        p = np.cumprod(p, dtype=np.uint64)
        if n <= CHUNK + 1:
            _known[base] = p
    return p[:n]


class _Hashes:
    """Hashes of substrings of a buffer, by prefix sums modulo 2**64."""

    def __init__(self, buf: np.ndarray, which: int = 0):
        n = len(buf)
        self.back = _powers(pow(_BASE[which], -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[which][buf] * _powers(_BASE[which], n), dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.back[start])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step:]) if width > step else x


def _parts(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of at most ``CHUNK`` bytes: bytes, document of each piece, its start in the document, end in the buffer."""
    held, docs, begins, size = [], [], [], 0

    def flush():
        buf = np.frombuffer(b"".join(held), np.uint8)
        return buf, np.array(docs), np.array(begins), np.cumsum([len(x) for x in held])

    for d, text in enumerate(texts):
        if len(text) < length:
            continue
        for begin in range(0, len(text) - length + 1, CHUNK - length + 1):
            piece = text[begin: begin + CHUNK]
            if size + len(piece) > CHUNK:
                yield flush()
                held, docs, begins, size = [], [], [], 0
            held.append(piece)
            docs.append(d)
            begins.append(begin)
            size += len(piece)
    if held:
        yield flush()


def runs(texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Runs of windows with a common anchor: document, first window, number of windows, hashes of anchor and context."""
    width = length - GRAM + 1
    out: dict[str, list] = {k: [] for k in ("doc", "at", "n", "key", "context")}
    for buf, docs, begins, ends in _parts(texts, length):
        hashes = _Hashes(buf)
        first = np.arange(len(buf) - GRAM + 1)
        gram = hashes.of(first, first + GRAM)
        low = np.uint64(PLACE_BITS)
        anchor = _sliding_min((gram >> low << low) | first.astype(np.uint64), width)
        anchor = (anchor & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        inside = np.zeros(len(buf) + 1, np.int8)
        inside[starts] += 1
        np.add.at(inside, ends - length + 1, -1)
        window = np.flatnonzero(np.cumsum(inside[: len(anchor)]) > 0)
        chosen = anchor[window]
        edge = np.flatnonzero((np.diff(chosen) != 0) | (np.diff(window) != 1))
        a, b = window[np.concatenate(([0], edge + 1))], window[np.concatenate((edge, [len(window) - 1]))]
        pin = chosen[np.concatenate(([0], edge + 1))]
        piece = np.searchsorted(ends, a, side="right")
        # a context is told by its bytes, its length and where its anchor lies
        shape = ((b - a) * length + (pin - a)).astype(np.uint64)
        out["context"].append(_mix(hashes.of(a, b + length) + shape * np.uint64(0xC2B2AE3D27D4EB4F)))
        out["key"].append(gram[pin])
        out["doc"].append(docs[piece])
        out["at"].append(a - starts[piece] + begins[piece])
        out["n"].append(b - a + 1)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def _merge(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs per document."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    far = int(stop.max()) + 2 if len(stop) else 1
    a, b = suffix.union_spans(doc * far + start, doc * far + stop)
    return a // far, a % far, b - a // far * far


def _run_rows(length: int):
    """Arrow function: documents to their runs. Runs that repeat one of the same batch are merged to removed spans at once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 4 * SLICE)):
            doc_id, sub = batch.column("d").to_numpy(zero_copy_only=False), batch.column("sub").to_numpy(zero_copy_only=False)
            r = runs([(t or "").encode() for t in batch.column("text").to_pylist()], length)
            order = np.lexsort((r["at"], sub[r["doc"]], doc_id[r["doc"]], r["context"], r["key"]))
            r = {k: v[order] for k, v in r.items()}
            again = np.zeros(len(order), bool)
            again[1:] = (r["key"][1:] == r["key"][:-1]) & (r["context"][1:] == r["context"][:-1])
            doc, start, stop = _merge(r["doc"][again], r["at"][again], (r["at"] + r["n"] + length - 1)[again])
            new = {k: v[~again] for k, v in r.items()}
            which = np.concatenate((new["doc"], doc))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((new["key"].view(np.int64), _mix(doc_id[doc].view(np.uint64)).view(np.int64)))),
                pa.array(np.concatenate((new["context"].view(np.int64), np.zeros(len(doc), np.int64)))),
                pa.array(doc_id[which]), pa.array(sub[which]),
                pa.array(np.concatenate((new["at"], start))), pa.array(np.concatenate((new["n"], stop - start - length + 1)).astype(np.int32)),
                pa.array(np.concatenate((np.zeros(len(new["at"]), bool), np.ones(len(doc), bool)))),
            ], names=["key", "context", "d", "sub", "at", "n", "gone"])

    return rows


def _context_rows(length: int):
    """Arrow function: documents with the runs they must look into, to one row per run with its bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, SLICE)):
            key, d, sub, at, context = [], [], [], [], []
            for doc_id, s, text, open_runs in zip(*(batch.column(c).to_pylist() for c in ("d", "sub", "text", "open"))):
                raw = (text or "").encode()
                for r in open_runs:
                    key.append(r["key"])
                    d.append(doc_id)
                    sub.append(s)
                    at.append(r["at"])
                    context.append(raw[r["at"]: r["at"] + r["n"] + length - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(d, pa.int64()), pa.array(sub, pa.int32()), pa.array(at, pa.int64()),
                 pa.array(context, pa.binary())],
                names=["key", "d", "sub", "at", "bytes"])

    return rows


def previous_matches(contexts: list[bytes], least: int) -> np.ndarray:
    """For every byte of the concatenated contexts: its longest previous factor, if it has ``least`` bytes; no match leaves its context."""
    buf = np.frombuffer(b"".join(contexts), np.uint8)
    ends = np.cumsum([len(c) for c in contexts])
    n = len(buf)
    left = np.repeat(ends, [len(c) for c in contexts]) - np.arange(n)
    padded = np.concatenate((buf, np.zeros(BLOCK, np.uint8))).astype(np.uint64)
    packed = np.zeros(n, np.uint64)
    for k in range(BLOCK):
        packed = (packed << np.uint64(8)) | np.where(left > k, padded[k: k + n], 0).astype(np.uint64)
    packed = (packed << np.uint64(8)) | np.minimum(left, BLOCK).astype(np.uint64)  # an end comes before any byte
    ranked = suffix.levels(suffix.dense_ranks(packed), BLOCK, depth=least)
    sa = np.argsort(ranked[-1][1])
    sa = sa[left[sa] >= least]
    a, b = sa[:-1], sa[1:]
    most = np.minimum(left[a], left[b])
    shared = np.minimum(suffix.common_prefix(ranked, a, b), most)
    for _ in range(BLOCK - 1):  # the bytes below a block
        more = (shared < most) & (buf[np.minimum(a + shared, n - 1)] == buf[np.minimum(b + shared, n - 1)])
        shared += more
    factor = np.zeros(n, np.int64)
    if len(sa):
        order = np.argsort(sa)
        position = np.empty(len(sa), np.int64)
        position[order] = np.arange(len(sa))
        factor[sa[order]] = suffix.longest_previous(position, np.concatenate(([0], shared)), least)
    return factor


def _factor_rows(length: int, block: int = 1 << 18):
    """Arrow function over contexts sorted by anchor and place: removed spans."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        contexts = [x[4] for x in held]
        hit = np.flatnonzero(previous_matches(contexts, length) >= length)
        ends = np.cumsum([len(c) for c in contexts])
        row = np.searchsorted(ends, hit, side="right")
        starts = ends - [len(c) for c in contexts]
        at = hit - starts[row]
        which, a, b = _merge(row, at, at + length)
        at = np.array([x[3] for x in held], np.int64)[which]
        return pa.RecordBatch.from_arrays(
            [pa.array([held[i][1] for i in which], pa.int64()), pa.array([held[i][2] for i in which], pa.int32()),
             pa.array(at + a), pa.array(at + b)], names=["d", "sub", "start", "stop"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("key", "d", "sub", "at", "bytes"))):
                if size >= block and x[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(x)
                size += len(x[4])
        if held:
            yield solve(held)
        held = []
        give_back()

    return rows


def _window_rows(length: int):
    """Arrow function: contexts to the two hashes of every window."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, sub, at, raw in zip(*(batch.column(c).to_pylist() for c in ("d", "sub", "at", "bytes"))):
                buf = np.frombuffer(raw, np.uint8)
                first = np.arange(len(buf) - length + 1)
                one, two = (_Hashes(buf, k).of(first, first + length).view(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), pa.array(np.full(len(first), d)), pa.array(np.full(len(first), sub, np.int32)), pa.array(at + first)],
                    names=["one", "two", "d", "sub", "at"])

    return rows


def _keyed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with their place in the order: the id (null first) and a number among rows of the same id."""
    named = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("d"), *columns)
    ids = named.groupBy("d").agg(F.count("*").alias("n")).filter("n > 1")
    if ids.isEmpty():
        return named.select("d", F.lit(0).alias("sub"), *columns)
    order = Window.partitionBy("d").orderBy(*columns)  # rows of one repeated id
    return named.withColumn("sub", F.row_number().over(order)).select("d", "sub", *columns)


def removed_spans(keyed: DataFrame, length: int = 100, group_limit: int = 4096) -> DataFrame:
    """Spans (d, sub, start, stop) of bytes under strings that start earlier; spans of a document may overlap.

    ``keyed`` has d, sub and text. Other columns travel along, so that its exchange is the same
    as that of a later join and is reused.
    """
    made = keyed.select("d", "sub", "text").mapInArrow(_run_rows(length), "key long, context long, d long, sub int, at long, n int, gone boolean")
    anchor = Window.partitionBy("key", "gone")
    same = Window.partitionBy("key", "gone", "context").orderBy("d", "sub", "at")
    met = (
        made.repartition("key").withColumn("first", F.row_number().over(same) == 1)
        .withColumn("several", F.min("context").over(anchor) != F.max("context").over(anchor))
        .withColumn("contexts", F.sum(F.col("first").cast("long")).over(anchor))
    )
    # per document: its removed spans and the runs to look into; bounded by the document's own length
    gone = F.col("gone") | ~F.col("first")
    found = cut(
        met.filter(gone | F.col("several")).groupBy("d", "sub").agg(
            F.collect_list(F.when(gone, F.struct(F.col("at").alias("start"), (F.col("at") + F.col("n") + length - 1).alias("stop")))).alias("spans"),
            F.collect_list(F.when(~gone, F.struct("key", "at", "n", "contexts"))).alias("open")))
    schema = "key long, d long, sub int, at long, bytes binary"

    def contexts(wanted) -> DataFrame:
        runs_of = found.select("d", "sub", F.filter("open", lambda r: wanted(r["contexts"])).alias("open")).filter(F.size("open") > 0)
        return keyed.join(runs_of, ["d", "sub"]).mapInArrow(_context_rows(length), schema)

    small = contexts(lambda n: n <= group_limit).repartition("key")
    spans = small.sortWithinPartitions("key", "d", "sub", "at").mapInArrow(
        _factor_rows(length), "d long, sub int, start long, stop long")
    if not found.filter(F.exists("open", lambda r: r["contexts"] > group_limit)).isEmpty():
        windows = contexts(lambda n: n > group_limit).mapInArrow(
            _window_rows(length), "one long, two long, d long, sub int, at long")
        earliest = windows.groupBy("one", "two").agg(F.min(F.struct("d", "sub", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        spans = spans.unionByName(
            windows.join(earliest, ["one", "two"]).filter(F.struct("d", "sub", "at") != F.col("first")).select(
                "d", "sub", F.col("at").alias("start"), (F.col("at") + length).alias("stop")))
    whole = found.select("d", "sub", F.explode("spans").alias("s")).select("d", "sub", "s.start", "s.stop")
    return whole.unionByName(spans)


def _cut_rows(columns: list[str], with_bytes: bool):
    """Arrow function: texts and spans to what is left."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, SLICE)):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw = (text or "").encode()
                a = np.array(sorted((s["start"], s["stop"]) for s in spans or ()), np.int64).reshape(-1, 2)
                start, stop = suffix.union_spans(a[:, 0], a[:, 1])
                edges = [0, *np.column_stack((start, stop)).ravel().tolist(), len(raw)]
                left = b"".join(raw[edges[i]: edges[i + 1]] for i in range(0, len(edges), 2)) if len(start) else raw
                out.append((len(raw), int((stop - start).sum()), len(start), hashlib.sha256(left).hexdigest(), left if with_bytes else None))
            n, gone, spans, digests, left = zip(*out)
            made = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made][: len(columns) + 4 + with_bytes],
                                             names=[*columns, *_MADE][: len(columns) + 4 + with_bytes])

    return rows


def remove_repeats(docs: DataFrame, length: int = 100, keep: tuple[str, ...] = (), group_limit: int = 4096, with_bytes: bool = True) -> DataFrame:
    """Remove each byte under a string of ``length`` bytes that also starts earlier.

    Earlier is a smaller doc_id, or the same document and a smaller start; strings are judged on
    the input and don't cross documents; overlaps count. A null text is empty. Rows of the same id
    are ordered by their text and carried columns, a null id stands before all. Texts shorter than
    ``length`` stay whole. Columns: doc_id, those of ``keep``, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 and, unless ``with_bytes`` is off, kept (the bytes that are left). A
    kept column with one of these names is called in_<name>.
    """
    carried = [c for c in keep if c not in ("doc_id", "text")]
    inner = [f"_{i}" for i in range(len(carried))]  # names of their own, as columns may be called like those made here
    named = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(i) for c, i in zip(carried, inner)])
    source = _keyed(named, ["text", *inner])
    spans = removed_spans(source, length, group_limit)
    per_doc = spans.groupBy("d", "sub").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = source.join(per_doc, ["d", "sub"], "left")
    columns = ["d", *inner]
    schema = joined.select(*columns).schema
    made = _MADE if with_bytes else _MADE[:-1]
    for name in made:
        schema = schema.add(name, "string" if name == "kept_sha256" else "binary" if name == "kept" else "long")
    out = joined.mapInArrow(_cut_rows(columns, with_bytes), schema)
    doc_id = F.when(F.col("d") != -(1 << 63), F.col("d")).alias("doc_id")
    return out.select(doc_id, *[F.col(i).alias(f"in_{c}" if c in made else c) for c, i in zip(carried, inner)], *made)


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """The documents with what is left of their texts; those of which nothing is left go.

    Null and empty texts leave nothing and go; an empty table gives no rows; rows that repeat an id
    stay rows of their own. All columns stay, whatever their names. A character that loses some of
    its bytes goes whole. n_chars, if there, is counted anew.
    """
    schema = docs.schema
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {c: f"c{i}" for i, c in enumerate(carried)}
    rows = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    kept = remove_repeats(rows, length, keep=tuple(names.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, SLICE, "kept"):
                texts = [raw.decode(errors="ignore") for raw in batch.column("kept").to_pylist()]
                new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "doc_id": batch.column("doc_id")}
                out = pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(names[c]) for c in schema.names], names=schema.names)
                yield out.filter(pa.array([bool(t) for t in texts], pa.bool_()))

    return kept.select("doc_id", *names.values(), "kept").mapInArrow(run, schema)


@query("op2_repeats")
def op2_repeats(spark, folder):
    return remove_repeats(table(spark, folder, "documents"), with_bytes=False)
