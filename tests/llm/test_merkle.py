import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from panelwright.llm import merkle


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def lower(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def build(digests):
    """Levels of one tree, leaves first."""
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i: i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def walk(levels, at, leaf):
    """Siblings on the way up and what a leaf leads to."""
    siblings = []
    for level in levels[:-1]:
        run = level[at // 16 * 16: at // 16 * 16 + 16]
        slot = at % 16
        siblings += run[:slot] + run[slot + 1:]
        leaf = h([*run[:slot], leaf, *run[slot + 1:]])
        at //= 16
    return siblings, leaf


def brute(rows):
    """(doc_id, source, lang, n_chars, text) rows to rows of the audit."""
    trees = defaultdict(list)
    for r in rows:
        other = h(map(field, (*r[:4], lower(r[4])))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else None
        trees[r[1]].append((r[0] is not None, r[0] or 0, h(map(field, r)), other))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        trees[s].sort(key=lambda x: x[:3])
        built[s] = build([x[2] for x in trees[s]])
    top = build([built[s][-1][0] for s in order])
    out = Counter()
    for place, s in enumerate(order):
        for at, (known, doc_id, leaf, other) in enumerate(trees[s]):
            siblings, head = walk(built[s], at, other or leaf)
            more, folded = walk(top, place, head)
            out[doc_id if known else None, leaf, built[s][-1][0], top[-1][0], h(siblings + more), folded, folded == top[-1][0]] += 1
    return out


def audited(spark, rows, partitions=3):
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows],
                                 "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, leaf string, level int")
    got = merkle.audit(docs.repartition(partitions)).collect()
    for r in got:
        assert merkle.fold(r.leaf, [s.asDict() for s in r.proof]) == r.root
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got)


@pytest.mark.parametrize("size, sources", [(1, 1), (17, 1), (700, 3), (300, 40)])
def test_audit_against_brute_force(spark, size, sources):
    rng = random.Random(size)
    rows = [(i * 7 - 50, f"s{min(rng.randrange(sources), rng.randrange(sources))}", "en", i, f"Text {rng.random()} É") for i in range(size)]
    assert audited(spark, rows) == brute(rows)


def test_awkward_rows(spark, awkward):
    rows = [(d, s, "de" if d else None, None if d == 5 else len(t or ""), t) for d, t in awkward for s in (None, "", "é", "z")]
    rows += [(9, "hot", "en", 3, "ABC")] * 60  # rows that repeat one another
    assert audited(spark, rows) == brute(rows)
    assert audited(spark, []) == Counter()


def test_rounds_of_a_tall_tree(spark):
    """Two levels a round, two children a node: the sweeps go over several rounds and back."""
    rows = [(f"t{i % 3}" if i % 3 else None, i, h([str(i)])) for i in range(0, 400)] + [("lone", 1, h(["lone"]))]
    made = merkle.Manifest(spark.createDataFrame(rows, "tree string, key long, leaf string").repartition(5), ["key"], arity=2, levels=2)
    assert len(made.trees.rounds) == 4 and made.trees.tallest == 8

    def ends(batch, paths):
        leaf = batch.column("leaf").to_pylist()
        return pa.RecordBatch.from_pydict({"leaf": batch.column("leaf"), "steps": pa.array([len(p) for p in paths], pa.int32()),
                                           "root": pa.array([fold(x, p) for x, p in zip(leaf, paths)], pa.string())})

    fold = merkle.fold
    got = made.proofs(ends, "leaf string, steps int, root string").collect()
    assert Counter(r.leaf for r in got) == Counter(r[2] for r in rows)
    assert {r.root for r in got} == {made.root()} and {r.steps for r in got} == {10, 2}
