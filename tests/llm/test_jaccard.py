import itertools
import random
import re

import pytest

from panelwright.llm.jaccard import JoinConfig, one_of_each, similarity_classes
from panelwright.llm.store import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(pairs, words, percent):
    sets = []
    for _, text in pairs:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i: i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(pairs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(pairs):
        low.setdefault(find(i), []).append(d)
    first = {k: None if None in v else min(v) for k, v in low.items()}
    return sorted(((d, len(s), first[find(i)]) for i, ((d, _), s) in enumerate(zip(pairs, sets))), key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("config", [JoinConfig(words=3, percent=90), JoinConfig(words=3, percent=90, block=2, heavy_local=2, heavy_tokens=50), JoinConfig()])
def test_equals_all_pairs(make_docs, config):
    rng = random.Random(4)
    pairs, d = [], 0
    for _ in range(8):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.randint(30, 160))]
        for _ in range(rng.randint(1, 12)):
            text = edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 4, 6]))
            pairs.append((d, text.upper() if rng.random() < 0.2 else text))
            d += 1
    assert rows(similarity_classes(make_docs(pairs, 4), config)) == brute(pairs, config.words, config.percent)


def test_chain_of_links_reaches_the_smallest(make_docs):
    words = [f"w{i}" for i in range(200)]
    pairs = []
    for k in range(12):
        words = [*words[:k * 15], f"new{k}", *words[k * 15 + 1:]]
        pairs.append((100 - k, " ".join(words)))
    got = rows(similarity_classes(make_docs(pairs), JoinConfig(words=3, percent=90)))
    assert got == brute(pairs, 3, 90) and {c for _, _, c in got} == {89}


def test_awkward_rows(make_docs, awkward):
    assert rows(similarity_classes(make_docs(awkward), JoinConfig(words=3, percent=90))) == brute(awkward, 3, 90)


def test_empty_table_and_table_without_words(make_docs):
    assert similarity_classes(make_docs([])).count() == 0
    assert rows(similarity_classes(make_docs([(1, None), (2, " ")]))) == [(1, 0, 1), (2, 0, 2)]


def test_one_of_each(make_docs):
    text = " ".join(f"a{i}" for i in range(60))
    docs = make_docs([(5, text), (3, text), (4, "other words entirely"), (6, None)])
    assert sorted(r.doc_id for r in one_of_each(docs).collect()) == [3, 4, 6]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (10, 11), (11, 12), (7, 7), (4, 1)], "a long, b long")
    assert {r.node: r.label for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10}
