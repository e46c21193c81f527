import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def make(pairs, partitions=3):
        rows = [(d, t, "en", f"s{i % 2}", len(t or ""), 7, "x", 0.5, True) for i, (d, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, f"{COLUMNS}, n int, kept string, score double, shard boolean").repartition(partitions)

    return make


@pytest.fixture
def awkward():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i}" for i in range(30_000))
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (None, "lost and found " * 5), (6, long), (7, long), (7, long),
            (8, "Tie " * 40), (9, "tie " * 40), (10, "é" * 300), (11, "x" * 99), (12, "x" * 100), (-3, "x" * 101)]
