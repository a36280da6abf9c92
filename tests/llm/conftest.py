import pytest

from mailprism.llm.common import ready


@pytest.fixture(scope="session")
def corpus(spark):
    """The session with the package shipped and batches bounded."""
    ready(spark)
    return spark


@pytest.fixture(scope="session")
def documents(corpus):
    """Few documents with NULLs, empty texts, repeated rows, ties and columns with clashing names."""
    from fixtures import document_rows

    frame = corpus.createDataFrame(document_rows(), "doc_id long, text string, source string, n_chars long")
    for name in ("rid", "row", "fp", "size", "g", "vector", "digest", "piece", "draw"):
        frame = frame.selectExpr("*", f"1 as {name}")
    return frame.repartition(3)
