"""Histogram sort: shards of nearly equal bytes from exact counts below candidate keys.

Rows are ordered by (hash of the text, hash of the id), so equal texts lie next to each
other. A splitter is searched like a radix: every round counts the exact bytes below the
candidate boundaries inside the key ranges that still hold a splitter, and keeps the one
range that holds the target. Rounds end when the count meets the tolerance, or the range
holds a single key; rows that repeat that key are cut by their number. Then the keys are
exchanged once, by shard and run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.registry import query, table
from panelwright.session import cut

FIRST_BITS, BITS = 12, 6
LOW, SIGN = -(1 << 63), 1 << 63
ALL = 1 << 62  # more rows than a key can have


@dataclass
class _Splitter:
    """State of one search. Bounds are unsigned 64-bit prefixes of the current key."""

    target: float
    tolerance: float
    below: int = 0  # bytes below the current range
    text: int | None = None  # the text hash, once the range is down to one text
    prefix: int = 0
    bits: int = 0
    found: tuple[int, int, int] | None = field(default=None)  # first key of the right side, and how many of its rows stay left


def _signed(u: int) -> int:
    return u - SIGN


def _prefix(c, bits: int):
    """The top bits of a signed key as a number from 0."""
    return F.shiftrightunsigned(c.bitwiseXOR(F.lit(LOW)), 64 - bits)


def find_splitters(keys: DataFrame, targets: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Keys (text hash, id hash, copies of it) with close to ``target`` bytes below them.

    ``keys`` has ``h``, ``d`` and ``size``; each target comes with the bytes that it may be
    off by. The third number tells how many of the rows with just this key lie below. What reaches the driver is a histogram of at most 2**6 cells per splitter.
    """
    todo = [_Splitter(t, tol) for t, tol in targets]
    while pending := [s for s in todo if s.found is None]:
        ranges: dict[tuple, list[_Splitter]] = {}
        for s in pending:
            ranges.setdefault((s.text, s.prefix, s.bits), []).append(s)
        for (in_text, bits) in sorted({(t is not None, b) for t, _, b in ranges}):
            own = {k: v for k, v in ranges.items() if (k[0] is not None, k[2]) == (in_text, bits)}
            more = min(64 - bits, BITS if bits or in_text else FIRST_BITS)
            cells = _histogram(keys, own, in_text, bits, more)
            for k, splitters in own.items():
                for s in splitters:
                    _refine(s, cells.get((k[0], k[1]), []), bits + more)
    return [s.found for s in todo]


def _histogram(keys, ranges, in_text, bits, more):
    key = F.col("d") if in_text else F.col("h")
    rows = keys.withColumn("_text", F.col("h") if in_text else F.lit(None).cast("long"))
    rows = rows.withColumn("_prefix", _prefix(key, bits) if bits else F.lit(0).cast("long"))
    if in_text or bits:
        wanted = keys.sparkSession.createDataFrame(
            [(t, p) for t, p, _ in ranges], "_text long, _prefix long")  # one row per splitter at most
        on = rows["_prefix"] == wanted["_prefix"]
        if in_text:
            on = on & (rows["_text"] == wanted["_text"])
        rows = rows.join(F.broadcast(wanted), on, "left_semi")
    got = (
        rows.groupBy("_text", "_prefix", _prefix(key, bits + more).alias("cell"))
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"),
             F.min("d").alias("d0"), F.max("d").alias("d1"))
        .collect()
    )
    cells: dict[tuple, list] = {}
    for r in got:
        cells.setdefault((r["_text"], r["_prefix"]), []).append(r)
    return {k: sorted(v, key=lambda r: r["cell"]) for k, v in cells.items()}


def _refine(s: _Splitter, cells: list, bits: int) -> None:
    for r in cells:
        in_text = s.text is not None
        start = (s.text, _signed(r["cell"] << (64 - bits)), 0) if in_text else (_signed(r["cell"] << (64 - bits)), LOW, 0)
        if abs(s.below - s.target) <= s.tolerance:
            s.found = start
            return
        if s.below + r["bytes"] > s.target:
            if (r["h0"], r["d0"]) == (r["h1"], r["d1"]):  # one key: its rows are of one size, the nearest number of them
                left = round((s.target - s.below) * r["n"] / r["bytes"])
                s.found = (r["h0"], r["d0"], left if left < r["n"] else ALL)
            elif not in_text and r["h0"] == r["h1"]:
                s.text, s.prefix, s.bits = r["h0"], 0, 0
            else:
                s.prefix, s.bits = r["cell"], bits
            return
        s.below += r["bytes"]
    s.found = (SIGN - 1, SIGN - 1, ALL)  # no rows, or all of them lie below


def _key(bound) -> F.Column:
    return F.struct(*(F.lit(b).cast("long").alias(n) for b, n in zip(bound, ("h", "d", "copy"))))


def number_copies(keys: DataFrame, cut_in: list[tuple[int, int]]) -> DataFrame:
    """Add ``copy``: numbers the rows of each key in ``cut_in`` from 0, and is 0 for the rows of other keys.

    Rows of one key are interchangeable, so they are numbered per input partition ``part`` and the
    partitions' counts are added up: the rows of a key, however many, meet in no task.
    """
    if not cut_in:
        return keys.withColumn("copy", F.lit(0).cast("long"))
    cuts = F.broadcast(keys.sparkSession.createDataFrame(cut_in, "h long, d long"))  # one row per splitter at most
    hot = keys.join(cuts, ["h", "d"])
    counts = hot.groupBy("h", "d", "part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("h", "d").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("h", "d", "part", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("h", "d", "part").orderBy("size"))
    ranked = hot.withColumn("_rn", rank).join(offsets, ["h", "d", "part"])
    return keys.join(cuts, ["h", "d"], "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(
        ranked.withColumn("copy", F.col("_before") + F.col("_rn") - 1).select(*keys.columns, "copy"))


def shard_by_bytes(docs: DataFrame, shards: int, runs: int = 8, tolerance: float = 0.001) -> DataFrame:
    """Deal documents into ``shards`` key ranges of nearly equal bytes.

    ``tolerance`` is the share of a shard's bytes that a boundary may be off by; it ends at
    whole documents in any case. Rows that repeat both id and text are dealt one by one, to
    neighbouring shards where they are many. Every shard is sorted as ``runs`` smaller ranges. A row counts the UTF-8 bytes of its text plus
    8, a null text as 8 and as another text than the empty one; a null id is an id like any
    other. An empty table gives an empty result. Other columns are ignored. Columns: doc_id,
    size, text_crc32, law, shard, slot (gapless in key order), grown_shard (null).
    """
    d = docs.select("doc_id", "text")
    keys = cut(d.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.xxhash64("text").alias("h"), F.xxhash64("doc_id").alias("d"), F.spark_partition_id().alias("part"),
    ))
    total = keys.agg(F.sum("size")).first()[0] or 0
    part = total / (shards * runs)
    bounds = find_splitters(keys, [
        (part * i, tolerance * part * runs if i % runs == 0 else 0.1 * part) for i in range(1, shards * runs)])
    bounds = [max(bounds[: i + 1]) for i in range(len(bounds))]
    keys = number_copies(keys, sorted({(h, d) for h, d, left in bounds if 0 < left < ALL}))
    key = F.struct("h", "d", "copy")
    outer, inner = bounds[runs - 1 :: runs], [bounds[i * runs : (i + 1) * runs - 1] for i in range(shards)]
    shard = sum(((key >= _key(b)).cast("int") for b in outer), F.lit(0))
    fine = F.element_at(F.array(*[F.array(*[_key(b) for b in bs]) for bs in inner]), F.col("shard") + 1)
    rows = keys.withColumn("shard", shard).withColumn("_run", F.size(F.filter(fine, lambda b: b <= key)) if runs > 1 else F.lit(0))
    counts = rows.groupBy("shard", "_run").agg(F.count("*").alias("_n"))  # shards * runs rows
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "_run", F.coalesce(before, F.lit(0)).alias("_before"))
    order = Window.partitionBy("shard", "_run").orderBy("h", "d", "copy", "doc_id", "size")
    return (
        rows.withColumn("_rn", F.row_number().over(order)).join(F.broadcast(offsets), ["shard", "_run"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                (F.col("_before") + F.col("_rn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


@query("op10_shards")
def op10_shards(spark, folder):
    return shard_by_bytes(table(spark, folder, "documents"), shards=24)
