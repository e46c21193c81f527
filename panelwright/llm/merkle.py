"""Merkle manifest of a dataset by time-forward processing.

A tree's nodes are labelled by the last leaf below them and their height, so every child comes
before its parent. Digests are messages to the parent's label. The external priority queue is a
Spark exchange sorted by label, which spills to disk; the part of the queue that is in use at a
time, a few messages for every level, is a heap in the task. One round sweeps blocks of
``arity ** LEVELS`` leaves upwards, then the blocks' heads are the leaves of the next round. The
reversed sweep goes through the labels from the last to the first: a node gets the proof from
itself to the root and sends it, one run of siblings longer, to its children.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.registry import query, table
from panelwright.llm.store import stored

ARITY = 16
LEVELS = 3  # levels that one round goes up
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "array<struct<slot:int,run:array<string>>>"
_ROWS = 1024  # rows of an Arrow batch that carry a proof
_HEAD = 99  # level of what comes into a block from above


def sha256_hex(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Digest of a row: every field as UTF-8 byte count, ``:`` and value, ``-`` if null."""
    parts = []
    for c in fields.values():
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


# Numbering


def numbered(leaves: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds pos, the place of a row in its tree from 0, without sorting a tree in one task.

    Rows are dealt by ranges of (tree, order), numbered inside a range, and the sizes of the
    earlier ranges are added. Rows that are equal in all of ``order`` are told apart by their
    place in the input, so that a range may end between them.
    """
    rows = leaves.withColumn("_again", F.monotonically_increasing_id())
    keys = [tree, *order, "_again"]
    columns = leaves.columns
    kind = leaves.schema.add("part", "integer").add("nth", "long")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            nth = []
            for t in batch.column(tree).to_pylist():
                n = n + 1 if t == last else 0
                last = t
                nth.append(n)
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())], names=kind.names)

    dealt = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys])
    made = stored(dealt.mapInArrow(number, kind), "merkle-numbers")
    sizes = made.groupBy("part", tree).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of the tree
    starts = sizes.select("part", F.col(tree).alias("_tree"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return made.join(starts.withColumnRenamed("part", "_part"), (F.col("part") == F.col("_part")) & F.col(tree).eqNullSafe(F.col("_tree"))).select(
        *columns, (F.col("_start") + F.col("nth")).alias("pos"))


# The sweep upwards


def _queue(messages: DataFrame, span: int, down: bool = False) -> DataFrame:
    """Messages dealt by block and sorted by label: the external priority queue."""
    keys = ["tree", "block", "end", "level"]
    dealt = messages.withColumn("block", F.floor(F.col("pos") / span)).repartition("tree", "block")
    return dealt.sortWithinPartitions(*[F.col(c).desc() if down else F.col(c).asc() for c in keys])


class _Block:
    """The sweep through one block: a heap of digests on their way, smallest label first."""

    def __init__(self, tree, block: int, height: int, levels: int, arity: int):
        self.tree, self.block, self.height, self.top, self.arity = tree, block, height, min(levels, height), arity
        self.heap: list[tuple[int, int, int, str]] = []
        self.nodes: list[tuple] = []

    def send(self, pos: int, level: int, digest: str) -> None:
        """A digest for the parent of a node; the label is the last leaf the parent may hold, then its level."""
        up = pos // self.arity
        heapq.heappush(self.heap, ((up + 1) * self.arity ** (level + 1) - 1, level + 1, pos, digest))

    def sweep(self, before: int | None) -> None:
        """Take all nodes off the queue whose leaves have all gone by."""
        while self.heap and (before is None or self.heap[0][0] < before):
            end, level = self.heap[0][:2]
            run = []
            while self.heap and self.heap[0][:2] == (end, level):
                _, _, pos, digest = heapq.heappop(self.heap)
                run.append(digest)
            up = pos // self.arity
            digest = sha256_hex(run)
            self.nodes.append((self.tree, up, level, end, self.height, digest, run))
            if level < self.top:
                self.send(up, level, digest)


_NODE = "tree string, place long, level int, end long, height int, digest string, run array<string>"


def _up(arity: int, levels: int):
    """Arrow function over the sorted queue of leaves to the nodes above them."""

    def table_of(nodes: list[tuple]) -> pa.RecordBatch:
        tree, place, level, end, height, digest, run = zip(*nodes) if nodes else [()] * 7
        return pa.RecordBatch.from_arrays(
            [pa.array(tree, pa.string()), pa.array(place, pa.int64()), pa.array(level, pa.int32()), pa.array(end, pa.int64()), pa.array(height, pa.int32()),
             pa.array(digest, pa.string()), pa.array(run, pa.list_(pa.string()))], names=["tree", "place", "level", "end", "height", "digest", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Block | None = None
        for batch in batches:
            for tree, block, pos, height, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "pos", "height", "digest"))):
                if now is None or (now.tree, now.block) != (tree, block):
                    if now:
                        now.sweep(None)
                        yield table_of(now.nodes)
                    now = _Block(tree, block, height, levels, arity)
                now.sweep(pos)
                now.send(pos, 0, digest)
                if len(now.nodes) >= _ROWS:
                    yield table_of(now.nodes)
                    now.nodes = []
        if now:
            now.sweep(None)
            yield table_of(now.nodes)

    return run


def _height(n: Column, arity: int) -> Column:
    """Levels above ``n`` leaves: 0 for one, else the least h with arity ** h >= n."""
    return reduce(lambda h, k: h + F.when(n > arity**k, 1).otherwise(0), range(int(63 / arity.bit_length())), F.lit(0)).cast("int")


class Forest:
    """Trees over (tree, pos, digest); the nodes of every round of the sweep are stored in the shared folder."""

    def __init__(self, leaves: DataFrame, arity: int = ARITY, levels: int = LEVELS):
        self.arity, self.levels, self.span = arity, levels, arity**levels
        self.rounds: list[DataFrame] = []
        last = leaves.groupBy("tree").agg(F.max("pos").alias("last"))
        self.heights = stored(last.select(F.col("tree").alias("_tree"), _height(F.col("last") + 1, arity).alias("height")), "merkle-heights")
        self.tallest = self.heights.agg(F.max("height")).first()[0] or 0
        now = leaves.join(self.heights, F.col("tree").eqNullSafe(F.col("_tree"))).select("tree", "pos", "digest", "height")
        roots = [now.filter("height = 0").select("tree", "digest")]
        now = now.filter("height > 0")
        for _ in range(0, self.tallest, levels):
            labelled = now.select("*", F.col("pos").alias("end"), F.lit(0).alias("level"))
            queue = _queue(labelled, self.span).select("tree", "block", "pos", "height", "digest")
            nodes = stored(queue.mapInArrow(_up(arity, levels), _NODE), "merkle-nodes")
            self.rounds.append(nodes)
            roots.append(nodes.filter("level = height").select("tree", "digest"))
            now = self._heads(len(self.rounds) - 1).select("tree", "pos", "digest", (F.col("height") - levels).alias("height"))
        self.roots = stored(reduce(DataFrame.unionByName, roots), "merkle-roots")

    def _heads(self, k: int) -> DataFrame:
        """Heads of the blocks of round k that are leaves of the next one."""
        return self.rounds[k].filter(f"level = {self.levels} and height > {self.levels}").withColumnRenamed("place", "pos")

    def proofs(self, leaves: DataFrame, above: DataFrame, finish, schema) -> DataFrame:
        """Rows of ``leaves`` (tree, pos, more) through ``finish(batch, paths)`` with the runs from each leaf to the root.

        ``above`` has (tree, path): what follows the tree's own root on the way. ``finish`` gets an
        Arrow batch of leaves and for each a list of steps {slot, run}.
        """
        last = F.greatest(F.floor((F.col("height") - 1) / self.levels), F.lit(0))  # the round of the tree's root
        start = above.join(self.heights, F.col("tree").eqNullSafe(F.col("_tree"))).select(
            "tree", F.lit(0).cast("long").alias("place"), "path", last.alias("last"))
        sent = None
        for k in reversed(range(max(1, len(self.rounds)))):
            heads = start.filter(F.col("last") == k).drop("last")
            heads = heads.unionByName(sent) if sent else heads
            under = self._heads(k - 1).select("tree", "pos") if k else leaves
            rows = heads.select("tree", (F.col("place") * self.span).alias("pos"), "path", ((F.col("place") + 1) * self.span).alias("end"), F.lit(_HEAD).alias("level"))
            if self.rounds:
                width = F.pow(F.lit(self.arity), "level").cast("long")
                rows = rows.unionByName(
                    self.rounds[k].select("tree", (F.col("place") * width).alias("pos"), "place", "level", "end", "run"), allowMissingColumns=True)
            else:
                rows = rows.select("*", F.lit(0).cast("long").alias("place"), F.array().cast("array<string>").alias("run"))
            rows = rows.unionByName(under.select("*", F.col("pos").alias("end"), F.lit(0).alias("level")), allowMissingColumns=True)
            more = [c for c in under.columns if c not in ("tree", "pos")]
            queue = _queue(rows, self.span, down=True).select("tree", "block", "pos", "place", "level", "end", "run", "path", *more)
            if not k:
                return queue.mapInArrow(_down(self.arity, more, finish), schema)
            sent = stored(queue.mapInArrow(_down(self.arity, more, _paths), f"tree string, place long, path {_STEP}"), "merkle-paths", _ROWS)


_STEP_KIND = pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.list_(pa.string()))]))


def _paths(batch: pa.RecordBatch, paths: list[list[dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("pos"), pa.array(paths, _STEP_KIND)], names=["tree", "place", "path"])


def _down(arity: int, more: list[str], finish):
    """Arrow function over the queue from the last label to the first: proofs reach the leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heap, head = None, [], []  # heap: messages by falling label
        for batch in batches:
            leaf, paths = [], []
            tree, block, pos, place, level, end = (batch.column(c).to_pylist() for c in ("tree", "block", "pos", "place", "level", "end"))
            runs, incoming = batch.column("run"), batch.column("path")
            for i in range(batch.num_rows):
                if (tree[i], block[i]) != at:
                    at, heap, head = (tree[i], block[i]), [], []
                if level[i] == _HEAD:
                    head = incoming[i].as_py() or []
                    continue
                path = head
                if heap and heap[0][:2] == (-end[i], -level[i]):
                    path = heapq.heappop(heap)[3]
                if not level[i]:
                    leaf.append(i)
                    paths.append(path)
                    continue
                below, digests = level[i] - 1, runs[i].as_py()
                for slot in range(len(digests)):
                    child = place[i] * arity + slot
                    heapq.heappush(heap, (1 - (child + 1) * arity**below, -below, child, [{"slot": slot, "run": digests}, *path]))
            rows = batch.select(["tree", "pos", *more]).take(pa.array(leaf, pa.int64()))
            for i in range(0, len(leaf), _ROWS):
                yield finish(rows.slice(i, _ROWS), paths[i: i + _ROWS])

    return run


# Manifest


def siblings(path: list[dict]) -> Iterator[str]:
    for step in path:
        yield from step["run"][: step["slot"]]
        yield from step["run"][step["slot"] + 1:]


def fold(leaf: str, path: list[dict]) -> str:
    """The root that a leaf leads to."""
    for step in path:
        run = list(step["run"])
        run[step["slot"]] = leaf
        leaf = sha256_hex(run)
    return leaf


class Manifest:
    """Leaves by tree and one tree over the trees' roots.

    ``leaves`` has the name of its tree (tree), a digest (leaf) and columns that give the ``order`` in
    the tree, null first, equal ones by digest. A null tree is a tree of its own and comes first;
    trees are in the order of their UTF-8 bytes. An empty table has no root. Rows that repeat one
    another are leaves of their own.
    """

    def __init__(self, leaves: DataFrame, order: list[str], arity: int = ARITY, levels: int = LEVELS):
        self.leaves = stored(numbered(leaves, "tree", [*order, "leaf"]), "merkle-leaves")
        self.trees = Forest(self.leaves.select("tree", "pos", F.col("leaf").alias("digest")), arity, levels)
        self.subroots = stored(numbered(self.trees.roots.select("tree", "digest", F.lit("").alias("all")), "all", ["tree"]), "merkle-subroots")
        self.top = Forest(self.subroots.select(F.col("all").alias("tree"), "pos", "digest"), arity, levels)

    def root(self) -> str | None:
        found = self.top.roots.first()
        return found["digest"] if found else None

    def proofs(self, finish, schema) -> DataFrame:
        """Leaves with the steps from each to the root, through ``finish(batch, paths)``."""
        start = self.top.roots.select("tree", F.array().cast(_STEP).alias("path"))
        rows = self.subroots.select(F.col("all").alias("tree"), "pos", F.col("tree").alias("name"))

        def named(batch: pa.RecordBatch, paths: list[list[dict]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("name"), pa.array(paths, _STEP_KIND)], names=["tree", "path"])

        above = stored(self.top.proofs(rows, start, named, f"tree string, path {_STEP}"), "merkle-above", _ROWS)
        return self.trees.proofs(self.leaves, above, finish, schema)


def audit(docs: DataFrame, tampered: Column | None = None, every: int = 5, with_proof: bool = True) -> DataFrame:
    """Manifest of documents and a check of each row after tampering.

    Leaves are digests of doc_id, source, lang, n_chars and text as they are (null is ``-``, an empty
    text ``0:``, texts are taken whole). ``tampered`` tells the rows whose text comes back in lower
    case (A-Z), by default those with crc32(doc_id) divisible by ``every``; a null id is not tampered
    with. Rows that repeat one another are leaves of their own; other columns are ignored; an empty
    table gives no rows. Columns: doc_id, source, leaf, subroot, root, proof_sha256, folded_root,
    verified and, unless ``with_proof`` is off, proof (steps of slot and run).
    """
    if tampered is None:
        tampered = F.crc32(F.col("doc_id").cast("string")) % every == 0
    columns = {c: F.col(c) for c in FIELDS}
    other = F.when(tampered & F.col("text").rlike("[A-Z]"), leaf_digest(columns | {"text": F.translate("text", _UPPER, _LOWER)}))
    leaves = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("tree"), leaf_digest(columns).alias("leaf"), other.alias("other"))
    made = Manifest(stored(leaves, "merkle-rows"), ["doc_id"])
    root, above = made.root(), made.top.tallest
    schema = "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def finish(batch: pa.RecordBatch, paths: list[list[dict]]) -> pa.RecordBatch:
        leaf = batch.column("leaf").to_pylist()
        inside, outside = [p[: len(p) - above] for p in paths], [p[len(p) - above:] for p in paths]
        subroots = [fold(x, p) for x, p in zip(leaf, inside)]
        heads = [fold(o, p) if o else s for o, p, s in zip(batch.column("other").to_pylist(), inside, subroots)]
        folded = [fold(h, p) for h, p in zip(heads, outside)]
        columns = {
            "doc_id": batch.column("doc_id"), "source": batch.column("tree"), "leaf": batch.column("leaf"), "subroot": pa.array(subroots, pa.string()),
            "root": pa.array([root] * len(leaf), pa.string()), "proof_sha256": pa.array([sha256_hex(siblings(p)) for p in paths], pa.string()),
            "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_())}
        if with_proof:
            columns["proof"] = pa.array(paths, _STEP_KIND)
        return pa.RecordBatch.from_pydict(columns)

    return made.proofs(finish, f"{schema}, proof {_STEP}" if with_proof else schema)


@query("op11_merkle")
def op11_merkle(spark, folder):
    return audit(table(spark, folder, "documents"), with_proof=False).drop("source")
