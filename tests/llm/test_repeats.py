import hashlib
import random

import numpy as np
import pytest

from panelwright.llm import repeats, suffix
from panelwright.llm.repeats import previous_matches, remove_repeats, without_repeats


def brute(pairs, length):
    seen, out = set(), []
    order = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or ""))
    for d, text in order:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if raw[i: i + length] in seen:
                gone[i: i + length] = b"\1" * length
            else:
                seen.add(raw[i: i + length])
        left = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("group_limit", [4096, 1])
def test_equals_brute_force_on_passages_and_copies(make_docs, group_limit):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(4)]
    pairs = []
    for d in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            cut = rng.randint(0, 60)
            parts += [rng.choice(passages)[cut:], " ".join(word() for _ in range(rng.randint(0, 9)))]
        pairs.append((d, "\n".join(parts)))
    pairs += [(200 + k, pairs[5][1]) for k in range(30)] + [(300, "ab" * 500), (301, "ab" * 300), (302, "é" * 200)]
    assert rows(remove_repeats(make_docs(pairs, 5), group_limit=group_limit)) == brute(pairs, 100)


def test_awkward_rows(make_docs, awkward):
    assert rows(remove_repeats(make_docs(awkward))) == brute(awkward, 100)


def test_empty_table(make_docs):
    assert remove_repeats(make_docs([])).count() == 0


def test_without_repeats_drops_what_is_empty_and_keeps_columns(make_docs):
    docs = make_docs([(1, "é" * 120), (2, "é" * 120), (3, "new words, " + "é" * 120)]).select("doc_id", "text", "lang", "source", "n_chars")
    out = {r.doc_id: r for r in without_repeats(docs).collect()}
    assert set(out) == {1, 3} and out[3].text == "new words, " and out[3].n_chars == 11 and out[1].lang == "en"


def test_columns_named_like_inner_ones(spark):
    names = ["d", "sub", "kept", "n_bytes", "spans", "_0", "c0", "open", "n_removed"]
    docs = spark.createDataFrame([(i, "a b " * 60 if i else "tail " * 30, *[f"{c}{i}" for c in names]) for i in range(3)], ["doc_id", "text", *names])
    got = without_repeats(docs).collect()
    assert docs.columns == list(got[0].asDict()) and {r.doc_id: [r[c] for c in names] for r in got} == {i: [f"{c}{i}" for c in names] for i in (0, 1)}
    kept = remove_repeats(docs, keep=("d", "n_bytes")).filter("doc_id = 2").first()
    assert (kept.d, kept.in_n_bytes, kept.n_bytes, kept.n_removed) == ("d2", "n_bytes2", 240, 240)


def test_documents_longer_than_a_buffer(make_docs, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcd ") for _ in range(900))
    pairs = [(d, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 2500))) + passage[rng.randint(0, 400):] + "z" * rng.randint(0, 300)) for d in range(12)]
    texts = [t.encode() for _, t in pairs]
    made = repeats.runs(texts, 100)
    for d, t in enumerate(texts):
        mine = made["doc"] == d
        windows = sorted(w for a, n in zip(made["at"][mine], made["n"][mine]) for w in range(a, a + n))
        assert windows == list(range(max(0, len(t) - 99)))
    assert rows(remove_repeats(make_docs(pairs))) == brute(pairs, 100)


def test_longest_previous_factor_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        contexts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        least = rng.randint(1, 9)
        if not any(contexts):
            continue
        flat = [c[i:] for c in contexts for i in range(len(c))]
        want = []
        for p, a in enumerate(flat):
            best = 0
            for b in flat[:p]:
                k = 0
                while k < min(len(a), len(b)) and a[k] == b[k]:
                    k += 1
                best = max(best, k)
            want.append(best >= least)
        assert (previous_matches(contexts, least) >= least).tolist() == want


def test_union_of_touching_spans():
    a, b = suffix.union_spans(np.array([0, 3, 5, 9]), np.array([3, 4, 8, 10]))
    assert a.tolist() == [0, 5, 9] and b.tolist() == [4, 8, 10]
