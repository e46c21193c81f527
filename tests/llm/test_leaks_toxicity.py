import random

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm.decontaminate import Embedding, LeakConfig, drop_leaked, edit_distance_within, find_leaks, normalize
from panelwright.llm.toxicity import ToxicityConfig, fit_nnpu, toxicity

SYLLABLES = ["ka", "to", "ri", "men", "sol", "va", "der", "pi", "lun", "est"]


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def items_table(spark, items):
    return spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, doc_id double")


def edit(rng, text, edits):
    x = list(text)
    for _ in range(edits):
        k, what = rng.randrange(len(x)), rng.random()
        if what < 0.33:
            x[k] = rng.choice("aeiou")
        elif what < 0.66:
            del x[k]
        else:
            x.insert(k, rng.choice("aeiou "))
    return "".join(x)


def semi_global(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, p in enumerate(pattern, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_edit_distance_against_the_table():
    rng = random.Random(2)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(low, 14))) for low in (1, 0))
        assert edit_distance_within(p, t)[0] == semi_global(p, t)


def test_embedding_falls_into_step_again():
    rng = random.Random(3)
    e = Embedding(64, LeakConfig())
    near = far = 0
    for _ in range(40):
        a = words(rng, 40)[:160]
        # the window begins with the same word
        for other, name in ((a[:30] + "x" + a[30:], "near"), (words(rng, 40)[:160], "far")):
            buf = np.frombuffer((a + other).encode(), np.uint8)
            keys = e.keys(buf, np.array([0, len(a)]), np.array([len(a), len(buf)]), np.array([7, 7]))
            same = (keys[:, 0] == keys[:, 1]).sum()
            near, far = (near + same, far) if name == "near" else (near, far + same)
    assert near > 40 * LeakConfig().repeats * 0.2 and far < near / 10


def test_exact_leaks_are_all_found_and_clean_documents_left(spark, make_docs):
    rng = random.Random(5)
    items = [(i, words(rng, rng.randint(15, 60))) for i in range(30)] + [(90, None), (91, "")]
    pairs = [(d, words(rng, 300)) for d in range(60)]
    for d in range(30):
        pairs.append((100 + d, f"{words(rng, 50)}\n{items[d][1].upper()}  {words(rng, 30)}"))
    docs, bench = make_docs([*pairs, (500, None), (501, ""), (502, items[0][1].replace(" ", " \n"))]), items_table(spark, items)
    got = {(r.doc_id, r.item_id): r.n_edits for r in find_leaks(docs, bench).collect()}
    assert got == {(100 + d, d): 0 for d in range(30)} | {(502, 0): 0}
    assert {r.doc_id for r in drop_leaked(docs, bench).select("doc_id").collect()} == {*range(60), 500, 501}
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, bench, LeakConfig(block_items=16)).collect()} == set(got)


@pytest.mark.parametrize("share, recall", [(0.03, 0.99), (0.09, 0.9)])
def test_recall_of_edited_items(spark, make_docs, share, recall):
    rng = random.Random(7)
    items = [(i, normalize(pa.array([words(rng, rng.randint(20, 60))]))[0].as_py()) for i in range(120)]
    pairs = [(i, f"{words(rng, 60)} {edit(rng, t, int(share * len(t)))} {words(rng, 20)}") for i, t in items]
    within = {(i, i) for (i, t), (_, text) in zip(items, pairs) if edit_distance_within(t, normalize(pa.array([text]))[0].as_py())[0] <= 0.1 * len(t)}
    got = {(r.doc_id, r.item_id) for r in find_leaks(make_docs(pairs), items_table(spark, items)).collect()}
    assert got <= {(i, i) for i, _ in items} and len(got & within) >= recall * len(within)


def test_leaks_of_awkward_tables(spark, make_docs, awkward):
    docs = make_docs(awkward)
    assert find_leaks(docs, items_table(spark, [])).count() == 0 and drop_leaked(docs, items_table(spark, [])).count() == len(awkward)
    assert {r.doc_id for r in find_leaks(docs, items_table(spark, [(1, "one two"), (2, "x" * 100)])).collect()} == {-3, 5, 11, 12}
    assert find_leaks(make_docs([]), items_table(spark, [(1, "one two three")])).count() == 0


def labelled(spark, rows):
    return spark.createDataFrame([(d, 1, t, "z") for d, t in rows], "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy(spark, make_docs):
    rng = random.Random(9)
    bad = ["mivorable", "grustag", "plenkomet"]
    pairs, labels = [], []
    for d in range(1200):
        toxic = rng.random() < 0.15
        w = words(rng, rng.randint(20, 80)).split()
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        pairs.append((d, " ".join(w)))
        if d % 2:
            labels.append((d, int(toxic)))
    got = toxicity(make_docs(pairs), labelled(spark, labels)).collect()
    truth = {d: any(b in t for b in bad) for d, t in pairs}
    out = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out]
    assert len(got) == 1200 and all(0 <= r.score <= 1 for r in got) and len(out) > 200
    assert sum(p and t for p, t in out) >= 0.95 * sum(t for _, t in out) and sum(p and not t for p, t in out) <= 0.03 * len(out)


def test_risk_goes_not_below_zero():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3)).astype(np.float32)
    x[:, 0] = rng.random(400) < 0.2
    w = fit_nnpu(x[x[:, 0] == 1], x, 0.2, ToxicityConfig())
    score = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert score[x[:, 0] == 1].min() > score[x[:, 0] == 0].max()


def test_toxicity_of_awkward_tables(spark, make_docs, awkward):
    docs = make_docs(awkward)
    got = toxicity(docs, labelled(spark, [(4, 1), (5, 0), (None, 1), (6, None)])).collect()
    assert len(got) == len(awkward) and all(r.score is not None and r.predicted in (0, 1) for r in got)
    assert toxicity(docs, labelled(spark, [])).count() == len(awkward)
    assert toxicity(make_docs([]), labelled(spark, [(1, 1)])).count() == 0
