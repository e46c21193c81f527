import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelwright.llm.packing import PackingConfig, combinations, encode, fit_repeats, pack, plan_sequences
from panelwright.llm.tokens import TokenRollup, count_tokens, deleted, encoder, inserted, long_counts, revised, rollup_documents
from panelwright.session import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_chunks_give_the_ids_of_whole_texts():
    texts = ["Hello, World. It's 3.5% of é́t É.", "a\n\nb\tc\r\nd  e.", "", "...", "x.. y., z!", "ΑΣ. Σ", "İstanbul. ẞ", "ẖ. H̱. ", "don't. we'll,"]
    ids, ends = encode(pa.array([*texts, None]), PATH)
    cut = np.split(ids, ends[:-1])
    assert [c.tolist() for c in cut] == [plain_ids(t) for t in texts] + [[]]


def check(pairs, got, window):
    ids = Counter()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, text in pairs:
        ids[d] += len(plain_ids(text or "")) + 1
    assert {d: sum(r.length for r in rs) for d, rs in docs.items()} == dict(ids)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return docs, sequences


def test_pieces_are_the_ids_of_the_documents(make_docs):
    pairs = [(i, f"some words {i} " * (i % 40)) for i in range(60)] + [(99, None), (100, ""), (101, "long text " * 3000)]
    docs, sequences = check(pairs, pack(make_docs(pairs), PackingConfig()).collect(), 2048)
    for d, text in pairs:
        all_ids = np.array([*plain_ids(text or ""), 1], "<u4")
        for r in docs[d]:
            assert r.ids_crc32 == zlib.crc32(all_ids[r.start: r.start + r.length].tobytes()) and r.doc_tokens == len(all_ids)
    assert len(sequences) <= -(-sum(r.length for rs in docs.values() for r in rs) // 2048) + 1


def test_awkward_rows(make_docs, awkward):
    check(awkward, pack(make_docs(awkward), PackingConfig(window=64)).collect(), 64)
    assert pack(make_docs([])).count() == 0


def test_special_tokens_and_dotted_capitals_have_the_ids_of_whole_texts():
    special = ["<|ENDOFTEXT|>", "<|endoftext|>", "a <|StartOfText|>. b", "x<|startoftext|>Y, z", "<|end", "<| ENDOFTEXT |>", "<|endoftext|> <|ENDOFTEXT|>"]
    texts = [*special, "İ. İ, Iİ. x", "Iş. IŞ, ı. Ğ, ſ. ŉ. ʼN, ß. ẞ. ", "Plain. Text, Here. ", "Ω. Я, 中. é. É, ", "a\u0301. b"]
    ids, ends = encode(pa.array(texts), PATH)
    assert [c.tolist() for c in np.split(ids, ends[:-1])] == [plain_ids(t) for t in texts]


def test_chunks_that_come_again_after_the_memory_is_full(monkeypatch):
    from panelwright.llm import packing

    monkeypatch.setattr(packing, "_ENCODED", 3)
    for round in range(4):
        texts = [f"hot word{round} a{i % (round + 2)}. B{i}" for i in range(9)]
        ids, ends = encode(pa.array(texts), PATH, 5)
        assert [c.tolist() for c in np.split(ids, ends[:-1])] == [plain_ids(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=20))
def test_every_rank_has_one_place(histogram):
    counts = np.zeros(33, np.int64)
    for n, k in histogram.items():
        counts[n] = k
    filled, seen = Counter(), Counter()
    for n, low, high, first, each, offset in plan_sequences(counts):
        for rank in range(low, high):
            seen[n, rank] += 1
            filled[first + (rank - low) // each] += n
    assert seen == Counter((n, r) for n, k in histogram.items() for r in range(k))
    assert all(v <= 32 for v in filled.values()) and set(filled) == set(range(len(filled)))


def test_least_squares_finds_exact_combinations():
    counts = np.zeros(11, np.int64)
    counts[[7, 3, 5, 2]] = [40, 40, 30, 30]
    combos = combinations(counts, 4)
    assert (7, 3) in combos and (5, 3, 2) in combos and all(sum(c) == 10 for c in combos)
    x = fit_repeats(counts, combos, 500)
    assert (x >= 0).all()
    left = counts.astype(float).copy()
    for c, k in zip(combos, x):
        for n in c:
            left[n] -= k
    assert np.abs(left).max() < 12


def test_rollup_counts_and_is_idempotent(spark, make_docs):
    pairs = [(1, "a  b"), (2, "a  b"), (3, None), (4, None), (None, ""), (5, "c d"), (5, "c d"), (6, "x " * 50_000)]
    paths = {"v1": public_tokenizers.path("byte_bpe_50k.tiktoken")}
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_bytes) for r in rollup_documents(
        make_docs(pairs), fresh_path(spark, "rollup"), paths).collect()}
    enc = encoder(paths["v1"])
    want = defaultdict(lambda: [0, 0, 0])
    for i, (d, t) in enumerate(pairs):
        if (d, t) in ((2, "a  b"), (4, None)):
            continue
        t = (t or "").replace("  ", " ")
        for k, v in enumerate((1, len(enc.encode_ordinary(t)), len(t.encode()))):
            want[f"s{i % 2}", "en", "v1"][k] += v
    assert got == {k: tuple(v) for k, v in want.items()}


def test_batches_cancel_and_repeat(spark, make_docs):
    paths = {"v1": public_tokenizers.path("byte_bpe_50k.tiktoken")}
    counts = long_counts(count_tokens(make_docs([(1, "one two"), (2, "three")]), ["text"], paths, ("source", "lang")), "text")
    rollup = TokenRollup(spark, fresh_path(spark, "rollup"))
    assert rollup.commit("in", inserted(counts)) and not rollup.commit("in", inserted(counts))
    assert rollup.totals(["in"]).agg({"n_docs": "sum"}).first()[0] == 2
    rollup.commit("revise", revised(counts, counts))
    assert sorted(map(tuple, rollup.totals(["in", "revise"]).collect())) == sorted(map(tuple, rollup.totals(["in"]).collect()))
    rollup.commit("out", deleted(counts))
    assert rollup.totals(["in", "out", "missing"]).count() == 0 and rollup.totals([]).count() == 0


def test_rollup_of_nothing(spark, make_docs):
    assert rollup_documents(make_docs([]), fresh_path(spark, "rollup")).count() == 0
