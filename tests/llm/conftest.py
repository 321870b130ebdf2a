import pytest


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text) with columns whose names the operators use themselves."""

    def make(rows, columns="doc_id long, text string"):
        extra = ", row string, fp long, _text string, words string"
        return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], columns + extra)

    return make


@pytest.fixture
def corpus(spark):
    """The smallest given documents, and texts that are null, empty, repeated or long."""
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(None, None), (9001, None), (9002, ""), (9003, " \t\n"), (9004, "one"), (9004, "one"), (9005, "lang " * 50_000)]
    return given.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
