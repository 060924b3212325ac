import pytest


@pytest.fixture()
def stored_docs(spark, tmp_path_factory):
    """A factory: rows -> a DataFrame read from Parquet files, as the operators expect."""

    def make(rows, schema="doc_id long, text string", files=2):
        path = str(tmp_path_factory.mktemp("docs") / "t.parquet")
        spark.createDataFrame(rows, schema).coalesce(files).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture()
def odd_docs(stored_docs):
    """Nulls, empty and long texts, repeated rows, and columns that clash with internal names."""
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta", "a", 1, 2), (1, "alpha beta gamma delta epsilon zeta eta theta", "a", 1, 2),
            (2, None, None, None, None), (None, "alpha beta gamma delta epsilon zeta eta theta", "b", 3, 4), (3, "", "c", 5, 6),
            (4, " \n\t ", "d", 7, 8), (5, "word " * 30000, "e", 9, 10), (6, "einzeln", "f", 11, 12), (None, None, None, None, None),
            (7, "ünïcode ✓ " * 40, "g", 0, 0)]
    return stored_docs(rows, "doc_id long, text string, id string, uid int, n int")
