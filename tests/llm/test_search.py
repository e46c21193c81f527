import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from panelwright.llm.search import ItemTree, Leaf, Search, SearchConfig, Top, maxima, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(pairs, items, k=10):
    """Every item against every document."""
    docs = [(d, split(t)) for d, t in pairs]
    docs = [(d, t) for d, t in docs if t]
    n, length = len(docs), sum(len(t) for _, t in docs)
    counts = [Counter(t) for _, t in docs]
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in sorted({i for i in items if i[1]}):
        scored = []
        for (d, t), c in zip(docs, counts):
            m = 100 - 75 + (75 * len(t) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 8 * m)) for x in split(text) if c[x])
            if score > 0:
                scored.append((-score, d is not None, d or 0))
        out += [(item, rank, d if known else None, -s) for rank, (s, known, d) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def items_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "item_id long, text string, key string, rank int").repartition(2)


def words(rng, n, names):
    return " ".join(rng.choice(names) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.mark.parametrize("cfg", [SearchConfig(), SearchConfig(k=3, batch=4, batch_postings=60, fanout=2, item_batch=2), SearchConfig(batch=8, block_bytes=700)])
def test_search_against_brute_force(spark, make_docs, cfg):
    rng = random.Random(5)
    names = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "x_y", "Tie"]
    pairs = [(rng.randrange(10_000), words(rng, int(rng.paretovariate(0.7)) % 400 + 1, names[: rng.choice([5, 30, 64])])) for _ in range(300)]
    items = [(i, words(rng, rng.randint(1, 30), names)) for i in range(25)] + [(90, "w1 w1 w1"), (91, "W1 w1 w1"), (92, "unknown"), (93, "."), (94, None), (95, "")]
    got = search(make_docs(pairs), items_table(spark, items), cfg)
    assert Counter(map(tuple, got.collect())) == brute(pairs, items, cfg.k)


def test_search_of_awkward_tables(spark, make_docs, awkward):
    items = [(1, "one two lost"), (1, "one two lost"), (None, "TIE é"), (2, "tie"), (3, "w1 w29999 " + "x" * 99), (4, None)]
    rows = awkward + [(8, "Tie " * 40)] * 12  # ties over the tenth place, rows that repeat
    got = Counter(map(tuple, search(make_docs(rows), items_table(spark, items)).collect()))
    assert got == Counter({(i if i != -9 else None, *r): n for (i, *r), n in brute(rows, [(-9 if i is None else i, t) for i, t in items]).items()})
    assert search(make_docs([]), items_table(spark, items)).count() == 0 and search(make_docs(rows), items_table(spark, [])).count() == 0
    assert search(make_docs([(1, None), (2, " .")]), items_table(spark, items)).count() == 0


def test_terms():
    text = "A-b_c D4é中 x\x00y\x7fz\n@q[r`s{t"
    assert [t.decode() for t in terms_of(text.encode())] == split(text)


def test_pairs_of_nodes_are_pruned():
    """Twelve topics that share no heavy term: only the leaves of an item's topic are scored, and the result is that of all."""
    rng = np.random.default_rng(3)
    topics, per = 12, 40
    cfg = SearchConfig(k=5, batch=10, fanout=4, item_batch=4)
    leaves, docs = [], []
    for topic in range(topics):
        for part in range(per // cfg.batch):
            rows = [(np.append(topic * 5 + np.arange(5), 60), np.append(rng.integers(100, 200, 5), rng.integers(1, 5))) for _ in range(cfg.batch)]
            terms, values = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
            ids = np.arange(cfg.batch) + len(docs)
            docs += rows
            leaves.append(Leaf(len(leaves), ids, np.arange(cfg.batch) * 6, terms, values, *maxima(terms, values)))
    items = [(np.array([t * 5 + int(rng.integers(5)), 60]), np.array([1000, 1])) for t in range(topics) for _ in range(3)]
    tree = ItemTree(items, cfg.item_batch, cfg.fanout)
    least = None
    for _ in range(2):  # the second time with k-th scores to start with
        run, top = Search(tree, 61, cfg), Top(len(items), cfg.k, least)
        for a in range(0, len(leaves), cfg.fanout**2):
            run.best(leaves[a: a + cfg.fanout**2], top)
        least = top.least
    for q, (scores, ids) in enumerate(top.best):
        terms, weights = items[tree.order[q]]
        dense = np.zeros(61, int)
        dense[terms] = weights
        exact = sorted(((-int((dense[t] * v).sum()), d) for d, (t, v) in enumerate(docs)))[: cfg.k]
        assert [(-s, d) for s, d in exact] == list(zip(scores.tolist(), ids.tolist()))
    assert run.opened <= len(items) * per / cfg.batch < 0.1 * len(items) * len(leaves)
