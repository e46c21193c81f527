import zlib
from collections import Counter, defaultdict

import pytest

from panelwright.llm.chat import rotate
from panelwright.llm.shards import shard_by_bytes


def check(pairs, got, shards):
    assert len(got) == len(pairs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in pairs)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    for rs in by_shard.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    return {k: sum(r["size"] for r in rs) for k, rs in by_shard.items()}


def test_bytes_are_near_equal_with_a_hot_text(make_docs):
    pairs = [(i, f"text {i} " * (i % 17)) for i in range(900)] + [(1000 + i, "the hot text " * 5) for i in range(600)]
    load = check(pairs, shard_by_bytes(make_docs(pairs, 7), 24).collect(), 24)
    mean = sum(load.values()) / 24
    assert len(load) == 24 and max(load.values()) - min(load.values()) < 0.02 * mean + 2 * 160


def test_rows_that_repeat_id_and_text_are_dealt_one_by_one(make_docs):
    load = check([(7, "one row")] * 480, shard_by_bytes(make_docs([(7, "one row")] * 480, 5), 24).collect(), 24)
    assert set(load.values()) == {20 * 15}
    pairs = [(7, "one row " * 4)] * 400 + [(None, None)] * 300 + [(i, f"text {i} " * (i % 9)) for i in range(800)]
    load = check(pairs, shard_by_bytes(make_docs(pairs, 6), 24, runs=4).collect(), 24)
    mean = sum(load.values()) / 24
    assert len(load) == 24 and max(load.values()) - min(load.values()) < 0.02 * mean + 2 * 90


def test_equal_texts_lie_next_to_each_other(make_docs):
    pairs = [(i, f"t{i % 50}") for i in range(500)]
    got = shard_by_bytes(make_docs(pairs), 4).collect()
    order = [r.text_crc32 for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sum(a != b for a, b in zip(order, order[1:])) == 49


@pytest.mark.parametrize("runs", [1, 8])
def test_awkward_rows(make_docs, awkward, runs):
    check(awkward, shard_by_bytes(make_docs(awkward), 24, runs=runs).collect(), 24)
    assert shard_by_bytes(make_docs([]), 24, runs=runs).count() == 0


TURNS = "conv_id long, turn long, role string, text string, name string, part int, turns string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS)


def test_each_speaker_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello é"), (1, 3, "ann", "")]
    got = {r.perspective: r for r in rotate(turns(spark, rows)).collect()}
    assert set(got) == {"ann", "bob"}
    assert got["ann"].text == "<|system|>\nBe kind.\n<|end|>\n<|assistant|>\nHi\n<|end|>\n<|user name=bob|>\nHello é\n<|end|>\n<|assistant|>\n\n<|end|>\n"
    for r in got.values():
        said = [r.text[a: a + n] for a, n in zip(r.loss_starts, r.loss_lengths)]
        assert said == [t for _, _, who, t in rows if who == r.perspective] and r.n_own_turns == len(said) and r.n_turns == 4


def test_parts_of_a_long_dialogue_make_it_whole(spark):
    rows = [(1, i, "ab"[i % 2], f"t{i}") for i in range(25)]
    whole = {r.perspective: r.text for r in rotate(turns(spark, rows)).collect()}
    parts = defaultdict(list)
    for r in rotate(turns(spark, rows), part=4).collect():
        parts[r.perspective].append((r.part, r.text))
    assert {k: "".join(t for _, t in sorted(v)) for k, v in parts.items()} == whole and all(len(v) == 7 for v in parts.values())


def test_awkward_turns(spark):
    rows = [(None, None, None, None), (None, 1, "a", "x"), (2, 5, "system", "only"), (3, 1, "a", "same"), (3, 1, "a", "same"), (4, 0, "a", "z" * 200_000)]
    got = {(r.conv_id, r.perspective, r.part): r for r in rotate(turns(spark, rows)).collect()}
    assert set(got) == {(None, "unknown", -1), (None, "a", -1), (None, "unknown", 0), (None, "a", 0), (3, "a", 0), (4, "a", 0)}
    assert got[3, "a", 0].n_own_turns == 2 and got[None, "a", -1].loss_starts == [] and got[None, "unknown", -1].loss_lengths == [0]
    assert rotate(turns(spark, [])).count() == 0
