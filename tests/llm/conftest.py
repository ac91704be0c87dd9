import pytest

from fitlake.llm.base import stored  # noqa: F401  (the package must import)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


#: Texts at the edges: null, empty, blank, one word, repeated rows, ties, other scripts, marks.
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d"), (6, "A b C d"), (7, "x " * 40000),
         (8, "same words in this text here"), (8, "same words in this text here"), (None, "same words in this text here"),
         (9, "línea ñandú ß 中文   end"), (10, "<|endoftext|> <|ENDOFTEXT|> \x00 \x01"), (None, None)]


@pytest.fixture(scope="session")
def edges(spark):
    """The edge cases, with extra columns whose names operators might use."""
    return spark.createDataFrame(
        [(i, t, "en", None if i == 4 else "src", 0 if t is None else len(t), "k", 1, "h", None) for i, t in EDGES],
        "doc_id long, text string, lang string, source string, n_chars long, key string, n long, hash string, node string")


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)
