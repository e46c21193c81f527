import numpy as np
import pyarrow as pa

from panelwright.llm.jaccard import _with_partners


def members(rng, rows, groups, labels):
    x = np.sort(rng.integers(0, [groups, 12, labels], (rows, 3)).astype(np.int64).view("i8,i8,i8"), axis=0).view(np.int64).reshape(-1, 3)
    return pa.table({"group": x[:, 0], "node": np.arange(rows), "n": x[:, 1] + 10, "label": x[:, 2]})


def test_partners_do_not_hang_on_batches():
    rng = np.random.default_rng(1)
    for rows, groups, labels in [(1, 1, 1), (200, 1, 1), (200, 1, 2), (300, 40, 3), (300, 3, 50)]:
        t = members(rng, rows, groups, labels)
        g, n, label = (t[c].to_numpy() for c in ("group", "n", "label"))
        fits = (g[:, None] == g) & (label[:, None] != label) & (100 * np.minimum(n[:, None], n) >= 90 * np.maximum(n[:, None], n))
        for size in (1, 2, 7, 64, 1000):
            got = [b for b in _with_partners(90)(iter(t.to_batches(max_chunksize=size)))]
            assert [k for b in got for k in b.column("node").to_pylist()] == np.flatnonzero(fits.any(axis=1)).tolist()


def test_members_leave_before_the_partition_ends():
    t = members(np.random.default_rng(2), 20_000, 1, 5_000)
    for groups in (t["group"], pa.chunked_array([np.arange(20_000) // 37])):  # a hot group, and groups across the edges of batches
        read = []
        batches = (read.append(1) or b for b in t.set_column(0, "group", groups).combine_chunks().to_batches(max_chunksize=100))
        next(_with_partners(80)(batches))
        assert len(read) < 5
