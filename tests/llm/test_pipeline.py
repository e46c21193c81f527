import os
import random
import re

import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import connect, spark_rows, sql_rows
from panelwright.llm import catalog, registry

FOLDER = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def corpus(spark, make_docs, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    pairs = [(d, text(rng.randint(30, 200))) for d in range(40)]
    item, passage = text(30), text(60)
    pairs += [(100, pairs[0][1]), (101, pairs[1][1] + " end"), (102, f"{text(40)} {item} {text(9)}"), (103, "spam spam spam spam " * 20)]
    pairs += [(104, f"{text(50)} {passage}"), (105, f"{text(50)} {passage}"), (106, None), (107, "short"), (108, None)]
    make_docs(pairs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), dict(pairs), passage


def test_each_stage_takes_effect(spark, corpus):
    folder, pairs, passage = corpus
    docs, ids = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == COLUMNS
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "repeated_passages":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert passage in texts[104] and passage[:100] not in texts[105] and texts[105][:20] == pairs[105][:20]
    assert ids["quality"] == set(pairs) - {103, 106, 107, 108}
    assert ids["near_duplicates"] == ids["quality"] - {100, 101}
    assert ids["repeated_passages"] == ids["near_duplicates"]
    assert ids["decontamination"] == ids["repeated_passages"] - {102}


def test_run_packs_what_is_left(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {*range(40), 104, 105}
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_send_small_batches(spark, make_docs):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    docs = make_docs([(d, "text") for d in range(2500)], partitions=1)
    sent = [r.n for r in corpus_pipeline.documents(spark, docs).mapInArrow(sizes, "n long").collect()]
    assert sum(sent) == 2500 and max(sent) <= 1000


def test_free_memory_goes_back(spark, monkeypatch):
    trimmed = []
    monkeypatch.setattr(registry, "_trim", trimmed.append)
    batch = pa.RecordBatch.from_arrays([pa.array(["some text"] * 9)], names=["text"])
    assert sum(part.num_rows for part in registry.slices(batch, 20)) == 9 and trimmed == [0]


def test_stages_of_an_empty_table(spark, make_docs, corpus):
    docs = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus[0]).count() == 0


def test_one_query_per_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries() and set(catalog.SQL) <= set(catalog.QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(entry.queries()[name](spark, FOLDER)) == sql_rows(connect(FOLDER), catalog.SQL[name])
