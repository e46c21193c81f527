"""Sums over asset pairs as a blocked matrix product.

Assets are cut into blocks that hold whole series. The blocks are the points of a projective
plane and a task is a line: any two blocks meet on one line only, so a block is copied to the
few lines through it (8 of 57) and not once for every other block. A task multiplies its blocks
tile by tile (BLOCK x BLOCK assets, CHUNK dates at a time) and emits finished rows, one per
asset pair, so pairs are never shuffled; measures that only need some of the pairs drop the
others there. No row is ever emitted per pair and date, and pairs with missing cells are
handled by multiplying the presence masks the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions.dist import attach_one
from panelwright.session import cut

BLOCK = 256
CHUNK = 1024
STRIP = 64  # partners of an asset whose pairs stand together where both orders of a pair are returned
CELLS = 1 << 20  # observed cells of a block of ``pair_tasks``, in the mean
SPREAD = 24  # blocks that larger panels have at least; ``pair_tasks`` copies each once per block
LINES = 57  # blocks, and lines, that larger panels have at least
LINE_CELLS = 6 << 20  # observed cells of a line, in the mean; the largest plane holds more
# Points of a plane: the points of its first line; adding 1 to all of them gives the next line.
# Two points differ by one number, which is the difference of two points of the line in one way only.
PLANES = {
    1: [0],
    3: [0, 1],
    7: [0, 1, 3],
    13: [0, 1, 3, 9],
    31: [0, 1, 3, 8, 12, 18],
    57: [0, 1, 3, 13, 32, 36, 43, 52],
    133: [0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109],
    307: [0, 1, 3, 44, 56, 61, 67, 75, 82, 91, 95, 124, 160, 178, 200, 210, 237, 262],
    993: [0, 1, 3, 22, 37, 57, 69, 143, 231, 257, 303, 308, 347, 351, 358, 449, 458, 529, 596, 621, 634, 674, 753, 782, 798, 840, 857, 863,
          871, 881, 933, 966],
}

Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def asset_axis(cells: DataFrame) -> DataFrame:
    """(ticker, pos): dense numbering of the assets. The pair table has the square of this size."""
    return cells.select("ticker").distinct().select(
        "ticker", (F.row_number().over(Window.orderBy("ticker")) - 1).alias("pos")
    )


def _even(assets: Column, cells: Column) -> Column:
    """Blocks of CELLS cells, at least SPREAD of larger panels."""
    return F.least(F.greatest(F.ceil(cells / CELLS), F.least(F.ceil(assets / BLOCK), F.lit(SPREAD))), assets)


def _plane(assets: Column, cells: Column) -> Column:
    """Points of the smallest plane with LINES blocks, or fewer of BLOCK assets, and LINE_CELLS cells on a line."""
    number = F.lit(max(PLANES))
    for n, line in sorted(PLANES.items(), reverse=True)[1:]:
        number = F.when((F.least(F.ceil(assets / BLOCK), F.lit(LINES)) <= n) & (cells * (len(line) / n) <= LINE_CELLS), F.lit(n)).otherwise(number)
    return number


def _blocks(cells: DataFrame, value: str, number: Callable[[Column, Column], Column] = _even) -> DataFrame:
    """A row per block: its number, the number of blocks, the names, and the observed cells sorted by asset and date.

    ``number`` tells how many blocks there are from the numbers of assets and of cells.
    """
    known = cells.where(F.col(value).isNotNull())
    dates = cells.select("date").distinct().select(
        "date", (F.row_number().over(Window.orderBy("date")) - 1).alias("t")
    )
    size = known.agg(F.count(F.lit(1)).alias("_cells"))
    names = asset_axis(cells)
    count = names.agg(F.count(F.lit(1)).alias("_n"))
    names = attach_one(attach_one(names, count), size)
    nb = number(F.col("_n"), F.col("_cells")).cast("int")
    block = F.floor(F.col("pos") * F.col("nb") / F.col("_n")).cast("int")
    names = names.withColumn("nb", nb).select("ticker", "pos", "nb", block.alias("block"))
    labels = names.groupBy("block").agg(
        F.min("pos").alias("first"), F.max("nb").alias("nb"), F.sort_array(F.collect_list(F.struct("pos", "ticker"))).alias("l"))
    rows = (
        known
        .join(dates, "date")
        .join(names.select("ticker", "pos", "block"), "ticker")
        .groupBy("block")
        .agg(
            F.sort_array(F.collect_list(
                F.struct(F.col("pos").cast("int").alias("a"), F.col("t").cast("int").alias("t"), F.col(value).cast("double").alias("v"))
            )).alias("c")
        )
    )
    return rows.join(labels, "block").select(
        "block", "nb", F.col("l.ticker").alias("names"), F.transform("c.a", lambda a: a - F.col("first").cast("int")).alias("a"),
        F.col("c.t").alias("t"), F.col("c.v").alias("v"),
    )


def pair_tasks(cells: DataFrame, value: str) -> DataFrame:
    """One row per (i, j), i <= j: the two blocks whose product the task computes.

    Each block is copied to the pairs it takes part in, so the tasks spread over (i, j).
    """
    b = _blocks(cells, value)
    names = ["names", "a", "t", "v"]
    left = b.select(
        F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("nb") - 1)).alias("j"),
        *[F.col(c).alias(f"{c}1") for c in names],
    )
    right = b.select(
        F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"),
        *[F.col(c).alias(f"{c}2") for c in names],
    )
    return left.join(right, ["i", "j"])


def line_tasks(cells: DataFrame, value: str) -> DataFrame:
    """One row per line of the plane: ``points``, its blocks by number, and of which of them the task also computes the inner pairs (``own``).

    Every two blocks are on one line, and every block is the own one of one line.
    """
    lines = F.lit(None).cast("array<int>")
    for n, line in PLANES.items():
        lines = F.when(F.col("nb") == n, F.array(*[F.pmod(F.col("block") - d, F.lit(n)) for d in line])).otherwise(lines)
    b = _blocks(cells, value, _plane)
    b = b.select(F.posexplode(lines).alias("k", "line"), F.struct("block", "names", "a", "t", "v").alias("point"))
    return b.groupBy("line").agg(
        F.sort_array(F.collect_list("point")).alias("points"), F.max(F.when(F.col("k") == 0, F.col("point.block"))).alias("own"))


def _matrix(a, t, v, n: int, first: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((n, width))
    m = np.zeros((n, width))
    a, t = np.asarray(a), np.asarray(t) - first
    x[a, t] = v
    m[a, t] = 1.0
    return x, m


def tiles(n1: int, n2: int, same: bool) -> Iterator[tuple[slice, slice, bool]]:
    """Tiles of at most BLOCK x BLOCK assets of two blocks and whether the tile lies on the diagonal; of one block with itself the upper half."""
    for a in range(0, n1, BLOCK):
        for b in range(a if same else 0, n2, BLOCK):
            yield slice(a, a + BLOCK), slice(b, b + BLOCK), same and a == b


def _met(row) -> Iterator[tuple]:
    """Pairs of blocks that a line computes: names, values and presence of each, over the dates that the line spans, and whether they are one block."""
    first = int(min(np.min(p["t"]) for p in row.points))
    width = int(max(np.max(p["t"]) for p in row.points)) - first + 1
    blocks = [(np.asarray(p["names"]), *_matrix(p["a"], p["t"], p["v"], len(p["names"]), first, width)) for p in row.points]
    for i, one in enumerate(blocks):
        if row.points[i]["block"] == row.own:
            yield (*one, *one, True)
        for other in blocks[i + 1:]:
            yield (*one, *other, False)


def _total(kernel: Kernel, x1, m1, x2, m2, chunk: int | None) -> dict[str, np.ndarray]:
    """The kernel's matrices, added over chunks of dates."""
    total = kernel(x1[:, :chunk], m1[:, :chunk], x2[:, :chunk], m2[:, :chunk])
    for t in range(chunk or x1.shape[1], x1.shape[1], chunk or 1):
        part = (x[:, t: t + chunk] for x in (x1, m1, x2, m2))
        total = {o: total[o] + v for o, v in kernel(*part).items()}
    return total


def _ordered(i: np.ndarray, j: np.ndarray, n: int, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the pairs of a tile of ``n`` assets by others stand, in both orders, and the first asset of each.

    Pair k is number k and, in the other order, len(i) + k; the tile's other assets count from ``n`` on. An asset's
    pairs with STRIP partners are followed by the partners' pairs with it: the values come twice in the same order
    and a name stands in a run, which columnar files store in little room.
    """
    other = np.flatnonzero(i != j) if diagonal else np.arange(len(i))
    strip = j // STRIP * n + i
    order = np.argsort(np.concatenate([strip, strip[other]]).astype(np.min_scalar_type(BLOCK * BLOCK // STRIP)), kind="stable")
    return np.concatenate([np.arange(len(i)), len(i) + other])[order], np.concatenate([i, n + j[other]])[order]


def blocked_pairs(cells: DataFrame, kernel: Kernel, outputs: list[str], value: str = "r", chunk: int | None = CHUNK, swapped: dict[str, str] | None = None) -> DataFrame:
    """Run ``kernel(x_i, m_i, x_j, m_j)`` on tiles of asset pairs and add its matrices over the chunks.

    Returns (asset_i, asset_j, *outputs) for asset_i <= asset_j. ``chunk=None``
    hands whole series to the kernel, for measures that do not add up over dates.
    With ``swapped`` it returns both orders of a pair; it names the outputs that another one replaces in the second.
    """
    schema = "asset_i string, asset_j string, " + ", ".join(f"{o} double" for o in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names1, x1, m1, names2, x2, m2, same in chain.from_iterable(map(_met, batch.to_pandas().itertuples(index=False))):
                for a, b, diagonal in tiles(len(names1), len(names2), same):
                    got = _total(kernel, x1[a], m1[a], x2[b], m2[b], chunk)
                    keep = (m1[a] @ m2[b].T) > 0
                    if diagonal:
                        keep &= np.triu(np.ones(keep.shape, dtype=bool))
                    i, j = np.nonzero(keep)
                    one, two = names1[a], names2[b]
                    columns = [got[o][i, j] for o in outputs]
                    first, second = i, len(one) + j
                    if swapped is not None:
                        at, first = _ordered(i, j, len(one), diagonal)
                        columns = [np.concatenate([v, got[swapped.get(o, o)][i, j]])[at] for o, v in zip(outputs, columns)]
                        second = np.concatenate([len(one) + j, i])[at]
                    names = pa.array(np.concatenate([one, two]), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(first)), names.take(pa.array(second)), *(pa.array(v, pa.float64(), from_pandas=True) for v in columns)],
                        names=["asset_i", "asset_j", *outputs],
                    )

    return line_tasks(cells, value).mapInArrow(run, schema)


SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _sum_kernel(x1, m1, x2, m2):
    if m1.all() and m2.all():
        shape = (len(x1), len(x2))
        rows, columns = x1.sum(axis=1), x2.sum(axis=1)
        squares = (x1 * x1).sum(axis=1), (x2 * x2).sum(axis=1)
        return {
            "n": np.full(shape, float(x1.shape[1])), "sx": np.broadcast_to(rows[:, None], shape), "sy": np.broadcast_to(columns, shape),
            "sxx": np.broadcast_to(squares[0][:, None], shape), "syy": np.broadcast_to(squares[1], shape), "sxy": x1 @ x2.T,
        }
    return {
        "n": m1 @ m2.T, "sx": x1 @ m2.T, "sy": m1 @ x2.T,
        "sxx": (x1 * x1) @ m2.T, "syy": m1 @ (x2 * x2).T, "sxy": x1 @ x2.T,
    }


def pair_sums(cells: DataFrame, value: str = "r", both: bool = False) -> DataFrame:
    """Counts, sums and product sums over the dates both assets have, i <= j or ``both`` orders."""
    swapped = {"sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"} if both else None
    return blocked_pairs(cells, _sum_kernel, SUMS, value, swapped=swapped)


def _product_kernel(x1, m1, x2, m2):
    return {"p1": x1 @ x2.T, "p2": (x1 * x1) @ (x2 * x2).T}


def product_sums(cells: DataFrame, value: str = "r") -> DataFrame:
    """Sums of x*y (p1) and of (x*y)^2 (p2), i <= j."""
    return blocked_pairs(cells, _product_kernel, ["p1", "p2"], value)


def with_moments(sums: DataFrame) -> DataFrame:
    """Adds cov (T-1) and corr from pair sums; null where fewer than two dates or no variance."""
    n = F.col("n")
    sxy = F.col("sxy") - F.col("sx") * F.col("sy") / n
    sxx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    syy = F.col("syy") - F.col("sy") * F.col("sy") / n
    return sums.select(
        "asset_i", "asset_j", n.cast("long").alias("n"),
        F.try_divide(sxy, n - 1).alias("cov"),
        F.when((sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy)).alias("corr"),
    )


def correlations_above(cells: DataFrame, threshold: float, absolute: bool = False, value: str = "r") -> tuple[DataFrame, DataFrame]:
    """Pairs (asset_i, asset_j, corr), i < j, above the threshold, and (asset, m): the mean correlation with all assets, itself included.

    Correlations (of ``absolute`` size, if asked for) are rounded to 12 digits; undefined ones count
    nowhere. The tasks keep the pairs above the threshold and one sum per asset and pair of
    blocks, so the table of all pairs does not exist.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for names1, x1, m1, names2, x2, m2, same in chain.from_iterable(map(_met, frame.itertuples(index=False))):
                sums1, sums2 = np.zeros((2, len(names1))), np.zeros((2, len(names2)))
                for a, b, diagonal in tiles(len(names1), len(names2), same):
                    s = _total(_sum_kernel, x1[a], m1[a], x2[b], m2[b], CHUNK)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        vx, vy = s["sxx"] - s["sx"] * s["sx"] / s["n"], s["syy"] - s["sy"] * s["sy"] / s["n"]
                        corr = (s["sxy"] - s["sx"] * s["sy"] / s["n"]) / np.sqrt(vx * vy)
                    known = (vx > 0) & (vy > 0)
                    corr = np.round(np.where(known, np.abs(corr) if absolute else corr, 0.0), 12)
                    sums1[:, a] += corr.sum(axis=1), known.sum(axis=1)
                    if not diagonal:
                        sums2[:, b] += corr.sum(axis=0), known.sum(axis=0)
                    above = known & (corr > threshold)
                    if diagonal:
                        above &= np.triu(np.ones(above.shape, dtype=bool), 1)
                    i, j = np.nonzero(above)
                    if len(i):
                        yield pd.DataFrame({"asset_i": names1[a][i], "asset_j": names2[b][j], "corr": corr[i, j], "n": 0})
                for names, sums in ((names1, sums1), (names2, sums2)):
                    yield pd.DataFrame({"asset_i": names, "asset_j": None, "corr": sums[0], "n": sums[1].astype(np.int64)})

    parts = cut(line_tasks(cells, value).mapInPandas(run, "asset_i string, asset_j string, corr double, n long"))
    mean = parts.where("asset_j IS NULL").groupBy(F.col("asset_i").alias("asset")).agg(F.try_divide(F.sum("corr"), F.sum("n")).alias("m"))
    return parts.where("asset_j IS NOT NULL").drop("n"), mean


def mirrored(pairs: DataFrame) -> DataFrame:
    """All ordered pairs from the i <= j half, without reading it twice."""
    rest = [c for c in pairs.columns if c not in ("asset_i", "asset_j")]
    both = F.when(
        F.col("asset_i") == F.col("asset_j"), F.array(F.struct("asset_i", "asset_j"))
    ).otherwise(
        F.array(
            F.struct("asset_i", "asset_j"),
            F.struct(F.col("asset_j").alias("asset_i"), F.col("asset_i").alias("asset_j")),
        )
    )
    return pairs.select(F.explode(both).alias("_p"), *rest).select("_p.asset_i", "_p.asset_j", *rest)


def _numbered(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row among the distinct combinations of the columns, and where each first stands."""
    codes = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        coded = c.dictionary_encode(null_encoding="encode")
        codes = codes * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
    _, first, number = np.unique(codes, return_index=True, return_inverse=True)
    return number, first


def rectangular(left: DataFrame, right: DataFrame, keys: Sequence[str], inner: str, col: str, out: str) -> DataFrame:
    """(keys, col, out): sums of a * b over ``inner``, for ``left`` (keys, inner, a) and ``right`` (inner, col, b).

    Both sides are cut into blocks of about ``BLOCK`` distinct keys and inner values and ``CHUNK``
    columns, by hash. A task multiplies two blocks as matrices and emits a row per key and column
    that meet, so a row per key, inner value and column never exists; partial sums over the
    inner blocks are then added. Absent cells count as zero, nulls are absent.
    """
    left = left.where(F.col("a").isNotNull()).select(*keys, inner, F.col("a").cast("double").alias("a"))
    right = right.where(F.col("b").isNotNull()).select(inner, col, F.col("b").cast("double").alias("b"))
    sizes = attach_one(
        left.agg(F.ceil(F.approx_count_distinct(F.struct(*keys)) / BLOCK).cast("int").alias("_nk")),
        right.agg(F.ceil(F.approx_count_distinct(inner) / BLOCK).cast("int").alias("_ni"), F.ceil(F.approx_count_distinct(col) / CHUNK).cast("int").alias("_nc")),
    )

    def number(names: Sequence[str], n: str):
        return F.pmod(F.xxhash64(*names), F.greatest(F.col(n), F.lit(1))).cast("int")

    rows = attach_one(left, sizes).withColumn("_i", number([inner], "_ni")).withColumn("_k", number(keys, "_nk"))
    rows = rows.groupBy("_i", "_k").agg(F.collect_list(F.struct(*keys, inner, "a")).alias("l"), F.max("_nc").alias("_nc"))
    rows = rows.select("_i", "_k", F.explode(F.sequence(F.lit(0), F.greatest("_nc", F.lit(1)) - 1)).alias("_c"), "l")
    cells = attach_one(right, sizes).withColumn("_i", number([inner], "_ni")).withColumn("_c", number([col], "_nc"))
    cells = cells.groupBy("_i", "_c").agg(F.collect_list(F.struct(inner, col, "b")).alias("r"), F.max("_nk").alias("_nk"))
    cells = cells.select("_i", "_c", F.explode(F.sequence(F.lit(0), F.greatest("_nk", F.lit(1)) - 1)).alias("_k"), "r")
    schema = left.select(*keys).schema
    schema = schema.add(right.schema[col]).add("v", "double")
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                l, r = (batch.column(c).slice(n, 1).flatten() for c in ("l", "r"))
                at, _ = _numbered([pa.concat_arrays([l.field(inner), r.field(inner)])])
                who, first = _numbered([l.field(k) for k in names])
                when, day = _numbered([r.field(col)])
                a, b = (np.zeros((len(first), at.max() + 1)) for _ in range(2))
                x, y = (np.zeros((at.max() + 1, len(day))) for _ in range(2))
                np.add.at(a, (who, at[: len(l)]), l.field("a").to_numpy(zero_copy_only=False))
                np.add.at(x, (at[len(l):], when), r.field("b").to_numpy(zero_copy_only=False))
                b[who, at[: len(l)]], y[at[len(l):], when] = 1.0, 1.0
                i, j = np.nonzero(b @ y)
                columns = [l.field(k).take(pa.array(first[i])) for k in names]
                yield pa.RecordBatch.from_arrays([*columns, r.field(col).take(pa.array(day[j])), pa.array((a @ x)[i, j])], names=[*names, col, "v"])

    parts = rows.join(cells, ["_i", "_k", "_c"]).select("l", "r").mapInArrow(run, schema)
    return parts.groupBy(*keys, col).agg(F.sum("v").alias(out))
