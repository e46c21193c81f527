"""Ranked lexical search of items over all documents by a dual tree.

A document's coordinates are its terms' impacts, an item's are its terms' weights; the score is
their inner product. Documents that share their heaviest term lie together: up to ``batch`` of
them are a leaf, ``fanout`` leaves a middle node, ``fanout`` of those a top node, and every node
holds the largest impact of each term below it. The items have a tree of the same height. The
inner product of two nodes' maxima bounds the score of every pair below them, so a pair of nodes
whose bound is less than the weakest k-th score of its items is left out whole, and the result
is exact. First the leaf with the best bound of each item is opened, for k-th scores to start with.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.registry import query, slices, table
from panelwright.llm.store import stored

NO_ID = -(1 << 63)  # stands for a null doc_id, which comes first among ties
_SLICE = 1 << 20
_LEAVES = 32  # leaves in an Arrow batch
# letters and digits, A-Z to a-z; all bytes above ASCII belong to terms; the rest parts them
_TERM_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


@dataclass(frozen=True)
class SearchConfig:
    """``block_bytes`` bounds the items that one pass over the documents searches for, and with it all that is broadcast."""

    k: int = 10
    batch: int = 256
    batch_postings: int = 1 << 16
    fanout: int = 8
    item_batch: int = 8
    block_bytes: int = 16 << 20


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def impact(tf, n, docs: int, length: int):
    """(10**9 tf) div (1000 tf + 8 m) with m = 100 - 75 + (75 n N) div L; all in whole numbers."""
    m = 25 + (75 * n * docs) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


# Trees


def _csr(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    off = np.concatenate(([0], np.cumsum([len(t) for t, _ in rows]))).astype(np.int64)
    return off, np.concatenate([t for t, _ in rows]), np.concatenate([w for _, w in rows])


def maxima(terms: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms and the largest value of each."""
    order = np.argsort(terms, kind="stable")
    terms, values = terms[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1])))
    return terms[first], np.maximum.reduceat(values, first)


class ItemTree:
    """Items with at least one weighted term; level 0 are the items, each level above groups of the one below."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], batch: int, fanout: int):
        order = sorted(range(len(items)), key=lambda i: (int(items[i][0][np.argmax(items[i][1])]), i))
        self.order = np.array(order, np.int64)  # position in the tree to number of the item
        rows = [items[i] for i in order]
        self.levels, self.first = [_csr(rows)], [np.arange(len(rows) + 1)]  # first item of each node
        for width in (batch, batch * fanout):
            starts = np.arange(0, len(rows), width)
            groups = [rows[a: a + width] for a in starts]
            self.levels.append(_csr([maxima(np.concatenate([t for t, _ in g]), np.concatenate([w for _, w in g])) for g in groups]))
            self.first.append(np.append(starts, len(rows)))
        self.below = [None, batch, fanout]

    def __len__(self) -> int:
        return len(self.order)

    def bounds(self, level: int, nodes: np.ndarray, work: np.ndarray) -> np.ndarray:
        off, terms, weights = self.levels[level]
        size = off[nodes + 1] - off[nodes]
        starts = np.cumsum(size) - size
        at = np.repeat(off[nodes] - starts, size) + np.arange(int(size.sum()))
        return np.add.reduceat(work[terms[at]] * weights[at], starts)

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Nodes of the level below."""
        n, width = len(self.first[level - 1]) - 1, self.below[level]
        found = (nodes[:, None] * width + np.arange(width)).ravel()
        return found[found < n]

    def open(self, level: int, nodes: np.ndarray, work: np.ndarray, least: np.ndarray, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The nodes whose bound reaches the smallest of ``least`` among their items, and the bounds."""
        if not len(nodes):
            return nodes, nodes
        b = self.bounds(level, nodes, work)
        weakest = np.minimum.reduceat(least, self.first[level][:-1])[nodes]
        keep = (b > 0) & ((b > weakest) if strict else (b >= weakest))
        return nodes[keep], b[keep]


class Leaf:
    """A batch of documents: ids, where each one's terms begin, terms, impacts and the maxima."""

    def __init__(self, name: int, docs, begins, terms, impacts, top_terms, top):
        self.name, self.docs, self.begins, self.terms, self.impacts = name, docs, begins, terms, impacts
        self.maxima = (top_terms, top)

    def scores(self, work: np.ndarray) -> np.ndarray:
        return np.add.reduceat(work[self.terms] * self.impacts, self.begins)


class Top:
    """The best k (score, doc_id) of every item so far; ``least`` is what a score must reach to come in."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.k = k
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        self.least = np.ones(n, np.int64) if least is None else least.copy()

    def add(self, item: int, docs: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least[item]
        if not good.any():
            return
        s, d = np.concatenate((self.best[item][0], scores[good])), np.concatenate((self.best[item][1], docs[good]))
        order = np.lexsort((d, -s))[: self.k]
        self.best[item] = s[order], d[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], s[order[-1]])


class Search:
    """Dual traversal of the item tree and streams of leaves."""

    def __init__(self, tree: ItemTree, vocabulary: int, cfg: SearchConfig):
        self.tree, self.cfg = tree, cfg
        self.work, self.weights = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)
        self.opened = 0  # pairs of an item and a leaf that were scored

    def score(self, item: int, leaf: Leaf, top: Top) -> None:
        off, terms, weights = self.tree.levels[0]
        own = slice(off[item], off[item + 1])
        self.weights[terms[own]] = weights[own]
        top.add(item, leaf.docs, leaf.scores(self.weights))
        self.weights[terms[own]] = 0
        self.opened += 1

    def _against(self, node: tuple[np.ndarray, np.ndarray], level: int, items: np.ndarray, least: np.ndarray, strict: bool = False):
        terms, values = node
        self.work[terms] = values
        found = self.tree.open(level, items, self.work, least, strict)
        self.work[terms] = 0
        return found

    def visit(self, leaves: list[Leaf], at_leaf, least, strict: bool = False) -> None:
        """Go down both trees at once; ``at_leaf(leaf, items, bounds)`` gets the items that the leaf is open for.

        ``least()`` are the scores to reach now.
        """

        def joint(parts: list[Leaf]) -> tuple[np.ndarray, np.ndarray]:
            return maxima(np.concatenate([x.maxima[0] for x in parts]), np.concatenate([x.maxima[1] for x in parts]))

        tree, f = self.tree, self.cfg.fanout
        upper, _ = self._against(joint(leaves), 2, np.arange(len(tree.first[2]) - 1), least(), strict)
        for i in range(0, len(leaves) if len(upper) else 0, f):
            middle, _ = self._against(joint(leaves[i: i + f]), 1, tree.children(2, upper), least(), strict)
            for leaf in leaves[i: i + f] if len(middle) else ():
                items, bounds = self._against(leaf.maxima, 0, tree.children(1, middle), least(), strict)
                if len(items):
                    at_leaf(leaf, items, bounds)

    def best(self, leaves: list[Leaf], top: Top) -> None:
        def at_leaf(leaf, items, bounds):
            for q in items[np.argsort(-bounds, kind="stable")]:
                self.score(int(q), leaf, top)

        self.visit(leaves, at_leaf, lambda: top.least)


# Rows


_LEAF = "leaf long, docs array<long>, begins array<int>, terms array<int>, impacts array<long>, top_terms array<int>, top array<long>"


def _lists(column) -> Iterator[np.ndarray]:
    flat, off = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(off[:-1], off[1:]):
        yield flat[a:b]


def _array(rows: list[np.ndarray], kind) -> pa.Array:
    off = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(rows) if rows else np.zeros(0), kind))


def _posting_rows(vocabulary):
    """Arrow function: whole texts to number of terms, and the items' terms with their counts; texts without terms go."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for part in slices(batch, _SLICE):
                ids, n, terms, counts = [], [], [], []
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    found = terms_of(raw) if raw else ()
                    if found:
                        c = Counter([known[t] for t in found if t in known])
                        ids.append(NO_ID if doc_id is None else doc_id)
                        n.append(len(found))
                        terms.append(np.fromiter(c.keys(), np.int32, len(c)))
                        counts.append(np.fromiter(c.values(), np.int64, len(c)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), _array(terms, pa.int32()), _array(counts, pa.int64())], names=["doc_id", "n", "terms", "counts"])

    return rows


def _statistics(size: int):
    """Arrow function: partial sums; term -1 counts the documents, -2 all their terms."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            docs, length = docs + len(n), length + int(n.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((at, [-1, -2])), pa.int64()), pa.array(np.concatenate((df[at], [docs, length])), pa.int64())], names=["term", "n"])

    return rows


def _impact_rows(docs: int, length: int, weights):
    """Arrow function: postings to impacts and the heaviest term; documents without a term that weighs go."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            ids, heavy, terms, impacts = [], [], [], []
            for doc_id, n, t, tf in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), _lists(batch.column("terms")), _lists(batch.column("counts"))):
                t, tf = t[w[t] > 0], tf[w[t] > 0]
                x = impact(tf, n, docs, length)
                t, x = t[x > 0], x[x > 0]
                if len(t):
                    ids.append(doc_id)
                    heavy.append(int(t[np.argmax(x * w[t])]))
                    terms.append(t)
                    impacts.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(heavy, pa.int32()), _array(terms, pa.int32()), _array(impacts, pa.int64())], names=["doc_id", "heavy", "terms", "impacts"])

    return rows


def _leaf_rows(cfg: SearchConfig):
    """Arrow function over sorted documents to leaves."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def leaf() -> pa.RecordBatch:
            terms, impacts = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            begins = np.cumsum([0, *(len(x[1]) for x in held[:-1])])
            top_terms, top = maxima(terms, impacts)
            return pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int64()), _array([np.array([x[0] for x in held])], pa.int64()), _array([begins], pa.int32()), _array([terms], pa.int32()),
                 _array([impacts], pa.int64()), _array([top_terms], pa.int32()), _array([top], pa.int64())],
                names=["leaf", "docs", "begins", "terms", "impacts", "top_terms", "top"])

        for batch in batches:
            for x in zip(batch.column("doc_id").to_pylist(), _lists(batch.column("terms")), _lists(batch.column("impacts"))):
                held.append(x)
                size += len(x[1])
                if len(held) >= cfg.batch or size >= cfg.batch_postings:
                    yield leaf()
                    name, held, size = name + 1, [], 0
        if held:
            yield leaf()

    return rows


def _groups(batches: Iterator[pa.RecordBatch], cfg: SearchConfig, whole: bool = True) -> Iterator[list[Leaf]]:
    """Top nodes: consecutive leaves, at most fanout squared or 16 leaves' worth of postings."""
    held, size = [], 0
    for batch in batches:
        names = ["docs", "begins", "terms", "impacts"] if whole else []
        parts = [_lists(batch.column(c)) for c in [*names, "top_terms", "top"]]
        for name, *x in zip(batch.column("leaf").to_pylist(), *parts):
            held.append(Leaf(name, *(x if whole else (None, None, None, None, *x))))
            size += len(x[2]) if whole else 0
            if len(held) >= cfg.fanout**2 or size >= 16 * cfg.batch_postings:
                yield held
                held, size = [], 0
    if held:
        yield held


def _block(items: DataFrame, keys: list[str], vocabulary: dict[bytes, int]) -> list[Counter]:
    """Terms of a block of items; ``vocabulary`` is filled."""
    found = []
    for row in items.collect():  # at most block_bytes of distinct texts, but for one longer item
        keys.append(row["key"])
        found.append(Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(row["text"].encode())))
    return found


def _search_block(docs: DataFrame, items: DataFrame, cfg: SearchConfig) -> DataFrame | None:
    """(key, doc_id, score): at most k rows for every item and task, the best ones among them."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    keys: list[str] = []
    vocabulary: dict[bytes, int] = {}
    counts = _block(items, keys, vocabulary)
    if not vocabulary:
        return None
    postings = stored(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_posting_rows(sc.broadcast(vocabulary)), "doc_id long, n long, terms array<int>, counts array<long>"),
        "search-postings")
    sums = postings.mapInArrow(_statistics(len(vocabulary)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in sums.collect()}  # a row per term of the block
    n, length = found.pop(-1, 0), found.pop(-2, 0)
    w = np.zeros(len(vocabulary), np.int64)
    for t, df in found.items():
        w[t] = weight(n, df)
    known = [(np.fromiter(c.keys(), np.int32, len(c)), np.fromiter(c.values(), np.int64, len(c))) for c in counts]
    known = [(t[w[t] > 0], (c * w[t])[w[t] > 0]) for t, c in known]
    living = [i for i, (t, _) in enumerate(known) if len(t)]
    if not living:
        return None
    made = postings.filter(F.size("terms") > 0).mapInArrow(
        _impact_rows(n, length, sc.broadcast(w)), "doc_id long, heavy int, terms array<int>, impacts array<long>").withColumn("again", F.monotonically_increasing_id())
    order = ["heavy", "doc_id", "again"]
    leaves = stored(made.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_leaf_rows(cfg), _LEAF), "search-leaves", cfg.batch)
    tree = sc.broadcast(ItemTree([known[i] for i in living], cfg.item_batch, cfg.fanout))
    size, n_items = len(vocabulary), len(living)

    def best_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each item the leaf of the task with the largest bound."""
        search = Search(tree.value, size, cfg)
        bound, leaf = np.zeros(n_items, np.int64), np.zeros(n_items, np.int64)

        def at_leaf(x, items, bounds):
            bound[items], leaf[items] = bounds, x.name

        for group in _groups(batches, cfg, whole=False):
            search.visit(group, at_leaf, lambda: bound, strict=True)
        at = np.flatnonzero(bound)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bound[at]), pa.array(leaf[at])], names=["item", "bound", "leaf"])

    def first_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, top = Search(tree.value, size, cfg), Top(n_items, cfg.k)
        for batch in batches:
            wanted = list(_lists(batch.column("items")))
            for i, x in enumerate(zip(*(_lists(batch.column(c)) for c in ("docs", "begins", "terms", "impacts")))):
                for item in wanted[i]:
                    search.score(int(item), Leaf(0, *x, None, None), top)
                yield pa.RecordBatch.from_arrays([pa.array(wanted[i], pa.int32()), pa.array(top.least[wanted[i]], pa.int64())], names=["item", "least"])

    bounds = leaves.select("leaf", "top_terms", "top").mapInArrow(best_leaves, "item int, bound long, leaf long")
    bounds = stored(bounds, "search-bounds", cfg.batch)
    seeds = bounds.groupBy("item").agg(F.max_by("leaf", F.struct("bound", "leaf")).alias("leaf")).groupBy("leaf").agg(F.collect_list("item").alias("items"))
    started = leaves.drop("top_terms", "top").join(seeds, "leaf").select("docs", "begins", "terms", "impacts", "items").mapInArrow(first_scores, "item int, least long")
    least = np.ones(n_items, np.int64)
    for r in stored(started, "search-started", _LEAVES).collect():  # a row per item of the block
        least[r["item"]] = r["least"]
    start, names = sc.broadcast(least), sc.broadcast(np.array([keys[i] for i in living], object))

    def search_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, top = Search(tree.value, size, cfg), Top(n_items, cfg.k, start.value)
        for group in _groups(batches, cfg):
            search.best(group, top)
        for q, (scores, ids) in enumerate(top.best):
            if len(ids):
                key = names.value[tree.value.order[q]]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(ids)), pa.array(ids), pa.array(scores)], names=["key", "doc_id", "score"])

    return stored(leaves.mapInArrow(search_rows, "key string, doc_id long, score long"), "search-found", _LEAVES)


def search(docs: DataFrame, items: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """The ``k`` best documents of every item: (item_id, rank, doc_id, score), scores above 0 only.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case, of
    whole texts. N documents have terms, L in all; a term's weight is floor(1000 ln((2N + 2) / (2 df +
    1))), its impact on a document (10**9 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L. Equal
    scores are in the order of doc_id, a null id first; rows that repeat an id are documents of their
    own. A null or empty text has no terms, an item without known terms no rows; the same item (id and
    text) given twice counts once; other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    asked = stored(items.select(F.col("item_id").cast("long"), "text").filter(F.length("text") > 0).distinct().withColumn("key", F.sha2("text", 256)), "search-items", 64)
    texts = asked.select("key", "text").dropDuplicates(["key"])
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // cfg.block_bytes)
    found = None
    for b in range(blocks):
        part = _search_block(docs, texts.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b), cfg)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= cfg.k)
    return asked.select("item_id", "key").join(ranked, "key").select(
        "item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


@query("op12_search")
def op12_search(spark, folder):
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
