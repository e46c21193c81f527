"""Benchmark decontamination: random-walk embedding and LSH, then an exact check of the rest.

Windows of an item begin with an anchor gram. Wherever a document holds an anchor, the window from
there is embedded by the CGK walk, which turns edits into few differing places, and keys of sampled
places find the item's windows that it is close to. Edit distance over the whole item decides.

What the keys may miss is searched for exactly: an item is cut into blocks and these into pieces, so
many that a copy within the edit limit has one piece unchanged in a block within the block's share
of the edits. Grams of the pieces are looked up at every character, the block about a gram is
compared by bit-parallel edit distance, and whatever is left is verified as before. No copy is lost,
so recall does not hang on the length of an item or on blanks in a text.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelwright.llm.registry import query, slices, table


SLICE = 1 << 20  # bytes of text that are searched at a time
WORD = 64  # characters of a block at most: the bits of a word
GRAM = 9  # characters of a piece that are looked up; at a limit of a tenth pieces are about as long
CHARS = 64  # numbers of characters in a block's masks, 0 for those of no item
STEP = 1 << 16  # places that are hashed at a time
PAIRS = 1 << 18  # pairs of a place and a piece at a time
LANES = 1 << 14  # blocks that are compared at a time
ITEM_CHARS = 512  # longer items in the mean make an index of fewer
WINDOW = 24  # characters that are embedded; shorter items have the exact check only
ANCHOR = 8  # characters at the beginning of a window that a copy must hold unchanged
STRIDE = 8  # characters between the windows of an item at most
FEW = 10  # windows of which one makes an item a candidate; of more, a sixteenth and at least two, as common phrases are alike


@dataclass(frozen=True)
class LeakConfig:
    """``target_recall`` is that of the keys of one window, of whose places ``agreement`` are as in the copy.

    ``block_items`` bounds the index that is sent to the executors; more items go in more passes.
    """

    max_edits: float = 0.10  # share of the item's characters
    target_recall: float = 0.95
    agreement: float = 0.74
    places: int = 6  # of the embedding in a key
    block_items: int = 10_000
    seed: int = 11

    @property
    def repeats(self) -> int:
        return math.ceil(math.log(1 - self.target_recall) / math.log(1 - self.agreement**self.places))


def normalize(texts: pa.Array) -> pa.Array:
    """Lower-case letters of ASCII, single blanks for white space."""
    return pc.ascii_trim_whitespace(pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), r"[ \t\n\r\f\v]+", " "))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the grams of ``q`` characters at every place."""
    n = len(codes) - q + 1
    out = np.zeros(n, np.uint64)
    for j in range(q):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += codes[j: j + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers ``first[k]``, ``first[k] + 1``, ... of every k, ``many[k]`` of them."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + many, many)


class Embedding:
    """The CGK walk. At step ``j`` the byte ``c`` is read, and left behind if ``moves[j, c]`` is set."""

    def __init__(self, window: int, config: LeakConfig):
        rng = np.random.default_rng([config.seed, window])
        self.steps = 2 * window  # a byte is read twice in the mean
        self.moves = rng.integers(0, 2, (self.steps, 256), dtype=np.int8)
        first = self.steps // 4  # the first places read the start word, which is equal anyway
        self.places = np.array([np.sort(rng.choice(np.arange(first, self.steps), config.places, replace=False)) for _ in range(config.repeats)])
        self.salt = rng.integers(1, 1 << 63, config.repeats, dtype=np.uint64)

    def keys(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray, word: np.ndarray) -> np.ndarray:
        """LSH keys of the windows that begin at ``start`` with ``word``, one row per repeat; bytes from ``stop`` on read as 0."""
        at = start.astype(np.int64).copy()
        out = self.salt[:, None] + word.astype(np.uint64)[None, :]
        use = defaultdict(list)
        for r, places in enumerate(self.places):
            for j in places:
                use[int(j)].append(r)
        for j in range(max(use) + 1):
            byte = np.where(at < stop, buf[np.minimum(at, len(buf) - 1)], 0)
            wide = byte.astype(np.uint64)
            for r in use.get(j, ()):
                x = (out[r] ^ wide) * np.uint64(0x9E3779B97F4A7C15)
                out[r] = x ^ (x >> np.uint64(29))
            at += self.moves[j][byte]
        return out


def edit_distance_within(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of ``pattern`` to a substring of ``text``, and where such a substring ends (bit-parallel)."""
    if (k := text.find(pattern)) >= 0:
        return 0, k + len(pattern)
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    pv, mv, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


def _cut(size: int, parts: int) -> list[int]:
    """Edges of ``parts`` stretches of nearly equal size."""
    return [size * k // parts for k in range(parts + 1)]


def _n_blocks(size: int, limit: int) -> int:
    """Blocks of half a WORD to a WORD of characters, such that the pieces of a block (one more than its share of the edits) are longest."""
    least = -(-size // WORD)
    return max(range(least, max(least, 2 * size // WORD) + 1), key=lambda j: (min(GRAM, size // j // (limit // j + 1)), -j))


def _bytes(codes: np.ndarray) -> np.ndarray:
    """A byte per character, for the walk."""
    return (codes ^ (codes >> np.uint32(8))).astype(np.uint8)


class Lookup:
    """Rows by hash; a bitmap of the hashes' upper bits tells most of those that are not held."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, first = np.unique(hashes[order], return_index=True)
        self.edges, self.rows = np.append(first, len(rows)), rows[order]
        self.shift = np.uint64(64 - min(24, max(16, len(self.hashes).bit_length() + 5)))
        self.bitmap = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bitmap[self.hashes >> self.shift] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are held, and their numbers."""
        hit = np.flatnonzero(self.bitmap[h >> self.shift])
        k = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
        same = self.hashes[k] == h[hit]
        return hit[same], k[same]

    def parts(self, k: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The rows of the numbers ``k`` and which of ``k`` each is of, about PAIRS at a time."""
        many = self.edges[k + 1] - self.edges[k]
        for part in np.split(np.arange(len(k)), np.flatnonzero(np.diff(np.cumsum(many) // PAIRS)) + 1):
            yield np.repeat(part, many[part]), self.rows[_ranges(self.edges[k[part]], many[part])]


class LeakIndex:
    """Items of one part of the benchmark: keys of their windows, their blocks, and the grams of the pieces of these.

    Of ``j`` blocks of an item one has at most ``limit // j`` edits, and of one piece more than that
    one has none: every copy within the limit holds a gram of the index as it stands.
    """

    def __init__(self, items: list[tuple], config: LeakConfig):
        self.ids = [i for i, _ in items]
        self.texts = normalize(pa.array([t for _, t in items], pa.string())).to_pylist() if items else []
        equal: dict[str, list[int]] = defaultdict(list)
        for n, text in enumerate(self.texts):
            if text:
                equal[text].append(n)
        self.items, self.numbers = list(equal), list(equal.values())  # distinct texts, and the items that have them
        self.limits = np.array([int(config.max_edits * len(x)) for x in self.items], np.int64)
        owners: dict[tuple[str, int], list[tuple[int, int]]] = defaultdict(list)  # (block, its edits): (item, offset)
        for n, (text, limit) in enumerate(zip(self.items, self.limits.tolist())):
            j = _n_blocks(len(text), limit)
            edges = _cut(len(text), j)
            for low, high in zip(edges, edges[1:]):
                owners[text[low:high], limit // j].append((n, low))
        blocks = list(owners)
        self.size = np.array([len(x) for x, _ in blocks], np.int64)
        self.edits = np.array([k for _, k in blocks], np.int64)
        self.owners = np.array([x for xs in owners.values() for x in xs], np.int64).reshape(-1, 2)
        self.owner_edges = np.cumsum([0, *map(len, owners.values())])
        # characters by frequency; the rare ones share a number, which lets distances be too small but never too large
        common = Counter(c for x, _ in blocks for c in x).most_common()
        self.number = np.zeros(0x110000, np.uint8)
        for k, (c, _) in enumerate(common):
            self.number[ord(c)] = 1 + min(k, CHARS - 2)
        self.masks = np.zeros((len(blocks), CHARS), np.uint64)
        grams: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # length of gram: (hash, block, offset)
        for b, (text, k) in enumerate(blocks):
            codes = _codes(text)
            np.bitwise_or.at(self.masks[b], self.number[codes], np.uint64(1) << np.arange(len(text), dtype=np.uint64))
            edges = _cut(len(text), k + 1)
            q = min(GRAM, *np.diff(edges).tolist()) if k else min(GRAM, len(text))
            grams[q] += [(h, b, o) for h, o in zip(_hashes(codes, q)[edges[:-1]].tolist(), edges)]
        self.grams = {q: Lookup(np.array([h for h, _, _ in rows], np.uint64), np.array([(b, o) for _, b, o in rows], np.int64)) for q, rows in grams.items()}
        self._embed(config)

    def _embed(self, config: LeakConfig) -> None:
        """LSH keys of the items' windows; of equal windows of an item the first."""
        self.embedding = Embedding(WINDOW, config)
        windows: dict[tuple[int, str], int] = {}
        for n, text in enumerate(self.items):
            spare = len(text) - WINDOW
            for o in range(0, spare + 1, max(1, min(STRIDE, spare // STRIDE))):
                windows.setdefault((n, text[o: o + WINDOW]), o)
        if not windows:
            self.anchors = self.windows = None
            return
        codes = _codes("".join(x for _, x in windows))
        start = np.arange(len(windows)) * WINDOW
        word = _hashes(codes, ANCHOR)[start]
        many = np.bincount([n for n, _ in windows], minlength=len(self.items))
        self.needed = np.where(many > FEW, np.maximum(2, many // 16), 1)
        rows = np.array([(n, o) for (n, _), o in windows.items()], np.int64)
        keys = self.embedding.keys(_bytes(codes), start, start + WINDOW, word)
        self.anchors = Lookup(word, rows)
        self.windows = Lookup(keys.reshape(-1), np.tile(rows, (len(keys), 1)))

    def _near(self, codes: np.ndarray, block: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a block lies within its edits about ``start``, in the text from ``low`` to ``high`` (bit-parallel, all at once)."""
        size, edits = self.size[block], self.edits[block]
        top = np.uint64(1) << (size - 1).astype(np.uint64)
        pv, mv = np.full(len(block), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(block), np.uint64)
        score, best = size.copy(), size.copy()
        masks, row = self.masks.reshape(-1), block * CHARS
        low, high = np.maximum(low, start - edits), np.minimum(high, start + size + edits)
        for j in range(int((high - low).max(initial=0))):
            at = low + j
            char = np.where(at < high, self.number[codes[np.minimum(at, high - 1)]], 0)
            eq = masks[row + char]
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            score += ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0)
            ph <<= np.uint64(1)
            mh <<= np.uint64(1)
            pv = mh | ~(xv | ph)
            mv = ph & xv
            np.minimum(best, score, out=best)
        return best <= edits

    def embedded(self, texts: list[str]) -> dict[tuple[int, int], set[int]]:
        """(text, distinct item) to where the item may begin, in steps of its limit, by the keys of embedded windows. ``texts`` are normalized."""
        out: dict[tuple[int, int], set[int]] = defaultdict(set)
        if self.anchors is None:
            return out
        found_windows: dict[tuple[int, int], set[int]] = defaultdict(set)
        codes = _codes("".join(texts))
        stops, buf = np.cumsum([len(x) for x in texts]), _bytes(codes)
        for begin in range(0, len(codes) - ANCHOR + 1, STEP):
            h = _hashes(codes[begin: begin + STEP + ANCHOR - 1], ANCHOR)
            hit, _ = self.anchors.find(h)
            for a in range(0, len(hit), LANES):
                word, at = h[hit[a: a + LANES]], hit[a: a + LANES] + begin
                text = np.searchsorted(stops, at, side="right")
                found, k = self.windows.find(self.embedding.keys(buf, at, np.minimum(at + WINDOW, stops[text]), word).reshape(-1))
                for which, rows in self.windows.parts(k):
                    lane = found[which] % len(at)
                    self._collect(out, text[lane], rows[:, 0], (at - np.append(0, stops)[text])[lane] - rows[:, 1])
                    for t, n, o in np.unique(np.stack([text[lane], *rows.T], axis=1), axis=0).tolist():
                        found_windows[t, n].add(o)
        return defaultdict(set, {pair: places for pair, places in out.items() if len(found_windows[pair]) >= self.needed[pair[1]]})

    def candidates(self, texts: list[str]) -> dict[tuple[int, int], set[int]]:
        """As ``embedded``, but by pieces and without a loss."""
        codes = _codes("".join(texts))
        stops = np.cumsum([len(x) for x in texts])
        out: dict[tuple[int, int], set[int]] = defaultdict(set)
        for q, known in self.grams.items():
            for begin in range(0, len(codes) - q + 1, STEP):
                hit, k = known.find(_hashes(codes[begin: begin + STEP + q - 1], q))
                for which, rows in known.parts(k):
                    self._add(out, codes, stops, hit[which] + begin, *rows.T)
        return out

    def _collect(self, out: dict, text: np.ndarray, item: np.ndarray, start: np.ndarray) -> None:
        step = self.limits[item] + 1
        for t, n, o in np.unique(np.stack([text, item, start // step * step], axis=1), axis=0).tolist():
            out[t, n].add(o)

    def _add(self, out: dict, codes: np.ndarray, stops: np.ndarray, at: np.ndarray, block: np.ndarray, offset: np.ndarray) -> None:
        """Candidates of the blocks that have a gram at ``offset`` and lie near ``at``."""
        text = np.searchsorted(stops, at, side="right")
        low = np.append(0, stops)[text]
        for a in range(0, len(at), LANES):
            x = slice(a, a + LANES)
            near = a + np.flatnonzero(self._near(codes, block[x], at[x] - offset[x], low[x], stops[text[x]]))
            b, many_owners = block[near], self.owner_edges[block[near] + 1] - self.owner_edges[block[near]]
            item, within = self.owners[_ranges(self.owner_edges[b], many_owners)].T
            self._collect(out, np.repeat(text[near], many_owners), item, np.repeat((at - offset - low)[near], many_owners) - within)

    def _closest(self, text: str, n: int, offsets: set[int]) -> tuple[int, int]:
        """Edits and end of the closest match of an item about ``offsets``; edits beyond the limit without one."""
        item, limit = self.items[n], int(self.limits[n])
        stretches: list[list[int]] = []
        for o in sorted(offsets):
            low, high = max(0, o - limit), o + len(item) + 2 * limit
            if stretches and low <= stretches[-1][1]:
                stretches[-1][1] = high
            else:
                stretches.append([low, high])
        best = (limit + 1, 0)
        for low, high in stretches:
            edits, end = edit_distance_within(item, text[low:high])
            best = min(best, (edits, low + end))
            if not best[0]:
                break
        return best

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, end): the closest match of every item that a text holds within the limit; ``end`` in characters."""
        clean = normalize(texts).to_pylist()
        places = self.embedded(clean)
        for pair, offsets in self.candidates(clean).items():
            places[pair] |= offsets
        out = []
        for (t, n), offsets in sorted(places.items()):
            best = self._closest(clean[t], n, offsets)
            if best[0] <= self.limits[n]:
                out += [(t, k, *best) for k in self.numbers[n]]
        return out

    def leaked(self, texts: pa.Array) -> np.ndarray:
        """Whether a text holds an item: by the keys, and what they leave by the exact check."""
        clean = normalize(texts).to_pylist()
        out = np.zeros(len(clean), bool)
        for search in (self.embedded, self.candidates):
            rest = np.flatnonzero(~out).tolist()
            for (t, n), offsets in search([clean[t] for t in rest]).items():
                if not out[rest[t]]:
                    out[rest[t]] = self._closest(clean[rest[t]], n, offsets)[0] <= self.limits[n]
        return out


def _indexes(docs: DataFrame, benchmark: DataFrame, config: LeakConfig) -> list:
    """Broadcast indexes of the benchmark, a block of bounded size each."""
    items = benchmark.filter("length(trim(text)) > 0").select("item_id", "text")
    count, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n_blocks = max(1, math.ceil(max(count, chars / ITEM_CHARS) / (config.block_items / 2)))
    blocks = items.withColumn("_block", F.pmod(F.xxhash64("text"), F.lit(n_blocks)))
    out = []
    for k in range(n_blocks):
        rows = blocks.filter(F.col("_block") == k).orderBy("item_id", "text").collect()
        out.append(docs.sparkSession.sparkContext.broadcast(LeakIndex([(r["item_id"], r["text"]) for r in rows], config)))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig()) -> DataFrame:
    """Documents that hold a benchmark item, a row per document and item.

    An item is held by a substring within ``max_edits`` of its length, both with ASCII letters
    lower-cased and white space made single. Null and empty texts and items hold and are nothing;
    repeated documents are reported one by one, equal items too; other columns are ignored.
    Documents are not shuffled; the benchmark is read in blocks of bounded size.
    Columns: doc_id, item_id, n_edits, item_chars.
    """
    schema = docs.select("doc_id").schema.add(benchmark.schema["item_id"]).add("n_edits", "long").add("item_chars", "long")
    id_type = to_arrow_type(benchmark.schema["item_id"].dataType)

    def search(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = index.value
            for batch in batches:
                for part in slices(batch, SLICE):
                    found = known.leaks(part.column("text"))
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id").take(pa.array([t for t, *_ in found], pa.int64())), pa.array([known.ids[n] for _, n, *_ in found], id_type),
                        pa.array([e for _, _, e, _ in found], pa.int64()), pa.array([len(known.texts[n]) for _, n, *_ in found], pa.int64()),
                    ], names=schema.names)

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, map(search, _indexes(docs, benchmark, config)))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig()) -> DataFrame:
    """Documents that hold no benchmark item, with all their columns; as ``find_leaks`` finds them, without a shuffle."""
    for index in _indexes(docs, benchmark, config):
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, SLICE):
                    yield part.filter(pa.array(~index.value.leaked(part.column("text"))))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


@query("op7_decontamination")
def op7_decontamination(spark, folder):
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
