import random

import pyarrow as pa
import pytest
from test_leaks_toxicity import edit, items_table, semi_global, words

from panelwright.llm.decontaminate import LeakConfig, LeakIndex, drop_leaked, edit_distance_within, find_leaks, normalize


@pytest.mark.parametrize("size", [1_000, 2_000, 4_000])
def test_edited_copies_of_long_items(spark, make_docs, size):
    rng = random.Random(size)
    items = [(i, words(rng, size // 3)[:size].strip()) for i in range(24)]
    pairs = [(i, f"{words(rng, 60)} {edit(rng, t, int(0.09 * len(t)))} {words(rng, 20)}") for i, t in items]
    clean = normalize(pa.array([text for _, text in pairs])).to_pylist()
    within = {(i, i): e for (i, t), text in zip(items, clean) if (e := edit_distance_within(t, text)[0]) <= int(0.1 * len(t))}
    got = {(r.doc_id, r.item_id): r.n_edits for r in find_leaks(make_docs(pairs), items_table(spark, items)).collect()}
    assert len(within) > 20 and got == within


def brute(pairs, items, share=0.1):
    """Every item of every document by the whole table of distances."""
    clean = lambda xs: normalize(pa.array([x for _, x in xs], pa.string())).to_pylist()
    held = [(d, i, semi_global(t, text), len(t)) for (d, _), text in zip(pairs, clean(pairs)) for (i, _), t in zip(items, clean(items)) if t]
    return sorted(x for x in held if x[2] <= int(share * x[3]))


def test_copies_in_text_without_blanks_and_beside_marks(spark, make_docs):
    items = [(1, "北京大学位于中国的首都"), (2, "https://example.org/a/very/long/path?x=1&y=2"), (3, "x**2+3*x-17==0or(y<4)"), (4, "to be or not to be, that is")]
    pairs = [(1, "我们知道北京大学位于中国的首都，历史悠久"), (2, 'see"https://example.org/a/very/long/path?x=1&y=2".'), (3, "if(x**2+3*x-17==0or(y<4)):pass"),
             (4, 'he said: "To be or not to be, that is" all'), (5, "我们知道北京大学位在中国的首都，历史悠久"), (6, "nothing of the kind")]
    got = find_leaks(make_docs(pairs), items_table(spark, items))
    assert sorted(map(tuple, got.collect())) == brute(pairs, items) == [(1, 1, 0, 11), (2, 2, 0, 44), (3, 3, 0, 21), (4, 4, 0, 27), (5, 1, 1, 11)]
    assert [r.doc_id for r in drop_leaked(make_docs(pairs), items_table(spark, items)).collect()] == [6]


@pytest.mark.parametrize("share", [0.0, 0.1, 0.25])
def test_short_items_against_the_table_of_distances(spark, make_docs, share):
    rng = random.Random(4)
    items = [(i, words(rng, 12)[: rng.randint(1, 80)]) for i in range(30)] + [(90, "a"), (91, "Ka To"), (92, "x" * 30), (93, "x" * 30), (94, None), (95, "")]
    pairs = [(i, f"{words(rng, 5)}{rng.choice(['', ' '])}{edit(rng, t, int(share * len(t)))}{rng.choice(['', ' ', '"'])}{words(rng, 4)}") for i, t in items if t]
    pairs += [(100, "x" * 200), (101, "x" * 29), (102, "x"), (103, ""), (104, None)]
    got = find_leaks(make_docs(pairs), items_table(spark, items), LeakConfig(max_edits=share, block_items=30))
    assert sorted(map(tuple, got.collect())) == brute(pairs, items, share)


def test_awkward_documents_against_the_table_of_distances(spark, make_docs, awkward):
    items = [(1, "one two"), (2, "x" * 100)]
    got = find_leaks(make_docs(awkward), items_table(spark, items))
    assert sorted((r.doc_id, r.n_edits) for r in got.collect()) == [(-3, 0), (5, 0), (11, 1), (12, 0)]
    assert find_leaks(make_docs(awkward), items_table(spark, [])).count() == 0
    assert find_leaks(make_docs([]), items_table(spark, [(1, "one two three")])).count() == 0


@pytest.mark.parametrize("size", [40, 60, 200, 1_000, 4_000])
def test_recall_of_the_embedding_without_the_exact_check(size, monkeypatch):
    rng = random.Random(size)
    items = [(i, words(rng, size)[:size].strip()) for i in range(40)]
    pairs = [f"{words(rng, 60)} {edit(rng, t, int(0.09 * len(t)))} {words(rng, 20)}" for _, t in items] + [words(rng, 300) for _ in range(40)]
    index, texts = LeakIndex(items, LeakConfig()), pa.array([*pairs, None, ""])
    exact = index.leaked(texts)
    assert exact.tolist() == [True] * 40 + [False] * 42 and {t for t, *_ in index.leaks(texts)} == set(range(40))
    monkeypatch.setattr(index, "candidates", lambda texts: {})
    by_keys = index.leaked(texts)
    assert by_keys.sum() >= LeakConfig().target_recall * exact.sum() and not (by_keys & ~exact).any()


def test_the_exact_check_gets_what_the_embedding_leaves(monkeypatch):
    rng = random.Random(3)
    items = [(1, words(rng, 30)), (2, "zq vx wj")]  # the second is shorter than a window
    texts = [f"{words(rng, 9)} {items[0][1]}", f"{words(rng, 9)} zq vxwj", words(rng, 50), items[0][1]]
    index, searched = LeakIndex(items, LeakConfig(max_edits=0.13)), []
    exactly = index.candidates
    monkeypatch.setattr(index, "candidates", lambda texts: searched.append(texts) or exactly(texts))
    assert index.leaked(pa.array(texts)).tolist() == [True, True, False, True] and searched == [texts[1:3]]
