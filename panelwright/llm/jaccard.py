"""Similarity join of word shingles by a token-group matrix.

Documents of equal shingle sets are one class. A class's rarest shingles, one more than it may
lack in common with a partner, are its prefix; partners share a prefix shingle. All classes with
a prefix shingle form a group, named after the member in whose prefix the shingle stands first:
the one with the fewest shingles of its own, which is most likely the original of its copies.

The matrix has a row of ``COLUMNS`` counts per class, shingles hashed to columns, and for a block
of a group the largest count in each column. The part of a query's counts above a row bounds what
they can share. First every member meets its group's namesake; that links most copies. Then only
members of different components are compared, block by block: a block is opened to a query if its
row allows enough in common. What the bounds allow is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.registry import query, slices, table
from panelwright.llm.store import components, stored

COLUMNS = 256
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class JoinConfig:
    """``percent`` is the Jaccard similarity of a link, ``words`` the length of a shingle.

    ``heavy_tokens`` bounds the list of frequent shingles that order the prefixes, ``filter_words``
    the Bloom filter of documents whose sets are read again; neither changes the result.
    """

    words: int = 5
    percent: int = 80
    block: int = 256
    heavy_local: int = 3
    heavy_tokens: int = 200_000
    filter_words: int = 1 << 19
    batch_bytes: int = 1_500_000
    heavy_bytes: int = 3_000_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and where each text's set ends."""
    spaced = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), "[ \\t-\\r]+", " ")
    trimmed = pc.utf8_trim(spaced, " ")
    split = pc.split_pattern(trimmed, " ")
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten().dictionary_encode()
    code = np.array([xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64)
    code = code[flat.indices.to_numpy(zero_copy_only=False)]
    empty = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(n) - n
    text_of = np.repeat(np.arange(len(n)), n)
    # a shingle of all words of a shorter text; its length is hashed too
    size = np.minimum(n, words)[text_of]
    head = np.arange(len(code)) - starts[text_of]
    valid = (head + size <= n[text_of]) & ~empty[text_of]
    at = np.flatnonzero(valid)
    h = size[at].astype(np.uint64)
    for k in range(words):
        h = np.where(k < size[at], _mix(h * np.uint64(0x9E3779B97F4A7C15) + code[np.minimum(at + k, len(code) - 1)]), h)
    doc = text_of[at]
    order = np.argsort(h)
    if len(n) < 1 << 16:  # a radix sort then
        order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    if len(h):
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
        h, doc = h[new], doc[new]
    return h, np.cumsum(np.bincount(doc, minlength=len(n)))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap with any partner of a set of ``n``."""
    return -(-percent * n // 100)


def heavy_shingles(docs: DataFrame, config: JoinConfig) -> np.ndarray:
    """Shingles that occur again and again within batches, at most ``heavy_tokens`` of them, with their order: rarest first.

    A hint for the order of prefixes, the same for all documents; any order gives the same links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(pa.RecordBatch.from_arrays([pc.unique(batch.column("text"))], names=["text"]), config.heavy_bytes):
                h = np.sort(shingle_sets(part.column("text"), config.words)[0])
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(h)))
                often = n >= config.heavy_local
                yield pa.RecordBatch.from_arrays([pa.array(h[first][often].view(np.int64)), pa.array(n[often])], names=["token", "n"])

    found = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "token").limit(config.heavy_tokens).toPandas()
    return top["token"].to_numpy(np.int64).view(np.uint64)[::-1]


def _sums(values: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return upto[begin + n] - upto[begin]


def _prefixes(h: np.ndarray, rank: np.ndarray, doc: np.ndarray, begin: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``most`` shingles of each text in order of rank and hash: shingle, place, text. ``h`` is sorted within texts."""
    rare = np.cumsum(rank == 0)
    rare_before = np.concatenate(([0], rare))[begin]
    place = rare - 1 - rare_before[doc]
    take = np.flatnonzero((rank == 0) & (place < most[doc]))
    heavy = np.flatnonzero(rank > 0)
    heavy = heavy[np.lexsort((rank[heavy], doc[heavy]))]
    owner = doc[heavy]
    n_rare = np.bincount(doc[rank == 0], minlength=len(begin))
    first = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(begin)))))[owner]
    heavy_place = n_rare[owner] + np.arange(len(heavy)) - first
    late = heavy_place < most[owner]
    at, places = np.concatenate((take, heavy[late])), np.concatenate((place[take], heavy_place[late]))
    order = np.lexsort((places, doc[at]))
    return h[at[order]], places[order], doc[at[order]]


def signatures(docs: DataFrame, heavy: np.ndarray, config: JoinConfig) -> DataFrame:
    """Per document: d, n, s1 and s2 (two sums of the set), prefix (shingles in order), columns (counts)."""
    spark = docs.sparkSession
    order = np.argsort(heavy)
    shared = spark.sparkContext.broadcast((heavy[order], order.astype(np.int64) + 1))  # at most heavy_tokens entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = shared.value
        for batch in batches:
            for part in slices(batch, config.batch_bytes):
                h, ends = shingle_sets(part.column("text"), config.words)
                n = np.diff(np.concatenate(([0], ends)))
                doc = np.repeat(np.arange(len(n)), n)
                rank = np.zeros(len(h), np.int64)
                if len(known) and len(h):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, weight[at], 0)
                begin = ends - n
                s1 = _sums(h, begin, n)
                s2 = _sums(_mix(h ^ np.uint64(0x5851F42D4C957F2D)), begin, n)
                # a copy of another text of the batch has the same prefix, which is only told once
                first = np.zeros(len(n), bool)
                first[np.unique(np.stack([s1, s2]), axis=1, return_index=True)[1]] = True
                most = np.where(first, n - needed(n, config.percent) + 1, 0)
                prefix, position, owner = _prefixes(h, rank, doc, begin, most)
                lengths = np.bincount(owner, minlength=len(n))
                counts = np.bincount(doc * COLUMNS + (h >> np.uint64(56)).astype(np.int64), minlength=len(n) * COLUMNS)
                rows = np.minimum(counts, 65535).astype("<u2").reshape(len(n), COLUMNS)
                yield pa.RecordBatch.from_arrays([
                    part.column("d"), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(prefix.view(np.int64))),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                ], names=["d", "n", "s1", "s2", "prefix", "columns"])

    return docs.select("d", "text").mapInArrow(run, "d long, n long, s1 long, s2 long, prefix array<long>, columns binary")


def _bits(d: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    h = _mix(d.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(4):
        h = _mix(h + np.uint64(k + 1))
        yield (h % np.uint64(words)).astype(np.int64), np.uint64(1) << (h >> np.uint64(58))


def sets_of(docs: DataFrame, wanted: DataFrame, config: JoinConfig) -> DataFrame:
    """Whole sets (node, tokens) of the wanted classes, read from their first documents (node, d).

    A Bloom filter of fixed size keeps most other documents from being shingled; a join leaves the right ones.
    """
    spark, words = docs.sparkSession, config.filter_words

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column("d").to_numpy(zero_copy_only=False)
            for word, bit in _bits(d, words):
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], names=["word", "bit"])

    got = wanted.select("d").mapInArrow(marks, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bloom = np.zeros(words, np.uint64)
    bloom[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in batches:
            d = batch.column("d").to_numpy(zero_copy_only=False)
            keep = np.ones(len(d), bool)
            for word, bit in _bits(d, words):
                keep &= (filled[word] & bit) != 0
            for part in slices(batch.filter(pa.array(keep)), config.batch_bytes):
                h, ends = shingle_sets(part.column("text"), config.words)
                n = np.diff(np.concatenate(([0], ends)))
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("d"), pa.array(n), pa.array(_sums(h, ends - n, n).view(np.int64)), tokens], names=["d", "n", "s1", "tokens"])

    read = docs.select("d", "text").mapInArrow(run, "d long, n long, s1 long, tokens array<long>")
    return read.join(wanted, ["d", "n", "s1"]).dropDuplicates(["node"]).select("node", "tokens")


def _may_link(n: np.ndarray, rows: np.ndarray, n2: np.ndarray, rows2: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and columns leave room for a link, pair by pair or by broadcasting."""
    above = np.maximum(rows.astype(np.int32) - rows2, 0).sum(axis=-1)
    above2 = np.maximum(rows2.astype(np.int32) - rows, 0).sum(axis=-1)
    shared = np.minimum(n - above, n2 - above2)
    return 100 * shared >= percent * (n + n2 - shared)


def _rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, COLUMNS)


def _star_pairs(percent: int):
    """Arrow function: members beside their group's namesake, to the pairs that the matrix allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, n2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "n2"))
            ok = _may_link(n, _rows_of(batch.column("columns")), n2, _rows_of(batch.column("columns2")), percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _met(q: list[dict], g: list[dict], same: bool, percent: int) -> tuple[list[int], list[int]]:
    """Pairs of a query and a member of a block that lie in different components and that the matrix allows."""
    out_a: list[int] = []
    out_b: list[int] = []
    if not q or not g:
        return out_a, out_b
    (qi, qn, ql, qc), (gi, gn, gl, gc) = ((
        [m["node"] for m in x], np.array([m["n"] for m in x]), np.array([m["label"] for m in x]),
        np.frombuffer(b"".join(m["columns"] for m in x), "<u2").reshape(-1, COLUMNS)) for x in (q, g))
    union = gc.max(axis=0).astype(np.int32)  # the block's row of the matrix
    shared = qn - np.maximum(qc.astype(np.int32) - union, 0).sum(axis=1)
    for i in np.flatnonzero(shared >= needed(qn, percent)).tolist():
        near = np.flatnonzero((gl != ql[i]) & (100 * np.minimum(gn, qn[i]) >= percent * np.maximum(gn, qn[i])))
        ok = near[_may_link(qn[i], qc[i][None, :], gn[near], gc[near], percent)]
        for j in ok.tolist():
            if not same or qi[i] < gi[j]:
                out_a.append(qi[i])
                out_b.append(gi[j])
    return out_a, out_b


def _block_pairs(percent: int):
    """Arrow function: two blocks of a group, or a group that is one block, to the pairs that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, left, right in zip(*(batch.column(c).to_pylist() for c in ("same", "queries", "members"))):
                a, b = _met(left, left if same else right, same, percent)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _with_partners(percent: int):
    """Arrow function over members sorted by group and size, to those with a neighbour of another component in reach of their size.

    Sizes are looked at up and down to the nearest member of another label; if that one is out of
    reach, all others are.
    """

    def solve(table: pa.Table) -> tuple[np.ndarray, int]:
        """Which members to keep, and where the last run of a label begins."""
        group, n, label = (table.column(c).to_numpy() for c in ("group", "n", "label"))
        keep = np.zeros(len(n), bool)
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (label[1:] != label[:-1])))
        start = np.flatnonzero(new)  # runs of a label
        stop = np.append(start[1:], len(n))
        run_of = np.cumsum(new) - 1
        for other, inside in ((start - 1, start > 0), (stop, stop < len(n))):
            at = np.clip(other, 0, len(n) - 1)
            ok = (inside & (group[at] == group[start]))[run_of]
            m = n[at][run_of]
            keep |= ok & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        return keep, int(start[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last run, whose next neighbour is not known yet
        known = 0  # rows before it: its last neighbour
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if len(held) > 1 and all((batch.column(c).to_numpy() == held[-2].column(c)[-1].as_py()).all() for c in ("group", "label")):
                continue
            table = pa.Table.from_batches(held)
            keep, last = solve(table)
            if last > known:
                yield from table.slice(known, last - known).filter(pa.array(keep[known:last])).to_batches()
                known = 1
                held = table.slice(last - 1).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from table.slice(known).filter(pa.array(solve(table)[0][known:])).to_batches()

    return run


def verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, config: JoinConfig) -> DataFrame:
    """The pairs (a, b) of classes that link, by their whole sets."""
    if pairs.isEmpty():
        return pairs
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored(sets_of(docs, classes.join(nodes, "node").select("node", "d", "n", "s1"), config), "sets")
    x = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    met = pairs.join(x, "a").join(y, "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    return stored(met.filter(100 * F.col("shared") >= config.percent * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b"), "links")


def _cross_pairs(groups: DataFrame, labels: DataFrame, matrix: DataFrame, config: JoinConfig) -> DataFrame:
    """Pairs of different components within groups, as far as sizes and the matrix allow.

    Members without a partner of fitting size in another component are left out first. A group of
    at most a block meets at once. Of a larger one the largest component is not compared with
    itself; it and the rest are cut into blocks, and only pairs of blocks with a block of the rest meet.
    """
    members = groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    schema = "group long, node long, n long, label long"
    members = members.select("group", "node", "n", "label").repartition("group").sortWithinPartitions("group", "n", "label").mapInArrow(
        _with_partners(config.percent), schema)
    members = stored(members, "members")
    sizes = members.groupBy("group", "label").agg(F.count("*").alias("k")).groupBy("group").agg(
        F.max_by("label", F.struct("k", "label")).alias("main"), F.max("k").alias("in_main"), (F.sum("k") - F.max("k")).alias("others"))
    split = members.join(sizes.filter("others > 0"), "group").join(matrix.select("node", "columns"), "node")
    whole = F.col("in_main") + F.col("others") <= config.block
    is_main = F.col("label") == F.col("main")
    blocks_main, blocks_rest = (F.ceil(F.col(c) / config.block).cast("int") for c in ("in_main", "others"))
    own = F.pmod(F.xxhash64("node"), F.when(is_main, blocks_main).otherwise(blocks_rest)).cast("int")
    # a block of the rest asks all blocks: of the rest from itself on, and of the main component
    seq = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0)
    place = lambda kind, i, j, asks: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(asks).alias("asks"))
    as_main = F.transform(seq(zero, blocks_rest - 1), lambda i: place("main", i, F.col("own"), False))
    as_rest = F.concat(
        F.transform(seq(zero, blocks_main - 1), lambda j: place("main", F.col("own"), j, True)),
        F.transform(seq(F.col("own"), blocks_rest - 1), lambda j: place("rest", F.col("own"), j, True)),
        F.transform(seq(zero, F.col("own") - 1), lambda i: place("rest", i, F.col("own"), False)))
    places = F.when(whole, F.array(place("rest", zero, zero, True))).when(is_main, as_main).otherwise(as_rest)
    met = split.withColumn("own", own).select("group", F.struct("node", "n", "label", "columns").alias("m"), F.explode(places).alias("at"))
    pairs = met.groupBy("group", "at.kind", "at.i", "at.j").agg(  # about two blocks to a row
        F.collect_list(F.when(F.col("at.asks"), F.col("m"))).alias("queries"),
        F.collect_list(F.when(~F.col("at.asks"), F.col("m"))).alias("members"))
    return pairs.select(((F.col("kind") == "rest") & (F.col("i") == F.col("j"))).alias("same"), "queries", "members").mapInArrow(
        _block_pairs(config.percent), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similarity_classes(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """Shingle count and component of every document.

    Words are runs of other characters than blank and U+0009 to U+000D, A-Z lower-cased. A set is
    the distinct shingles of ``words`` words; fewer words are one shingle; no words, an empty or a
    null text are an empty set, linked with nothing. Documents link when percent * union <= 100 *
    intersection. component_id is the smallest doc_id that links reach; rows of the same id are
    documents of their own with that id; null ids come before all. Classes are told by 64-bit
    hashes of their sets. Columns: doc_id, n_shingles, component_id; other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), "text")
    seen = stored(signatures(rows, heavy_shingles(rows, config), config).withColumn(
        "node", F.when(F.col("n") > 0, F.xxhash64("n", "s1", "s2"))), "signatures", batch_rows=2048)
    full = seen.filter("n > 0")
    classes = stored(full.groupBy("node").agg(F.min("d").alias("d"), F.first("n").alias("n"), F.first("s1").alias("s1")), "classes")
    postings = full.select("node", F.posexplode("prefix").alias("pos", "token")).repartition("token")
    by_token = Window.partitionBy("token")
    groups = postings.withColumn("several", F.min("node").over(by_token) != F.max("node").over(by_token)).withColumn(
        "group", F.first("node").over(by_token.orderBy("pos", "node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    groups = groups.filter("several").select("group", "node").distinct()
    groups = stored(groups.join(classes.select("node", "n"), "node"), "groups")
    # the matrix row of a class is that of its first document
    matrix = stored(full.join(classes.join(groups.select("node").distinct(), "node", "left_semi").select("node", "d"), ["node", "d"], "left_semi")
                    .dropDuplicates(["node"]).select("node", "n", "columns"), "matrix")
    small, large = F.least("n", "n2"), F.greatest("n", "n2")
    star = groups.filter(F.col("group") != F.col("node")).join(classes.select(F.col("node").alias("group"), F.col("n").alias("n2")), "group").filter(
        100 * small >= config.percent * large)
    star = star.join(matrix.select("node", "columns"), "node").join(
        matrix.select(F.col("node").alias("group"), F.col("columns").alias("columns2")), "group").select(
        F.col("group").alias("a"), F.col("node").alias("b"), "n", "n2", "columns", "columns2")
    lean = classes.select("node", "d", "n", "s1")
    links = verify(rows, stored(star.mapInArrow(_star_pairs(config.percent), "a long, b long"), "pairs", batch_rows=4096), lean, config)
    more = verify(rows, stored(_cross_pairs(groups, components(links), matrix, config), "pairs", batch_rows=256), lean, config)
    labels = components(links.unionByName(more))
    labelled = lean.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = labelled.groupBy("label").agg(F.min("d").alias("component"))
    of_class = labelled.join(smallest, "label").select("node", "component")
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return seen.select("d", "n", "node").join(of_class, "node", "left").select(
        back("d").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), back("d")).otherwise(back("component")).alias("component_id"))


def one_of_each(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """The document with the smallest id of every component; documents without a word are components of their own.

    Rows that repeat an id stay or go together.
    """
    first = similarity_classes(docs, config).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_first")).distinct()
    return docs.join(first, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")


@query("op4_jaccard_join")
def op4_jaccard_join(spark, folder):
    return similarity_classes(table(spark, folder, "documents"), JoinConfig(words=3, percent=90))
