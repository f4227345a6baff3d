import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id string, row string, spans string"
EDGE = [
    (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, " \t\n ", "en", None, 4), (None, "a row without an id", "en", "s", 19),
    (9004, "twice told tale of a dog", "en", "s", 24), (9004, "twice told tale of a dog", "en", "s", 24), (9005, "One", None, "s", 3),
    (9006, "😀 password=abcdef1 \x01 <|endoftext|> 4111 1111 1111 1111 x@y.io", "xx", "s", 60),
    (9007, "long " * 40_000 + "tail", "en", "s", 200_004), (9008, "9" * 30_000, "en", "s", 30_000),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The small table's documents with rows that hold nulls, blanks, repeats and a very long text, under clashing extra columns."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in base.select("doc_id", "text", "lang", "source", "n_chars").collect()] + EDGE
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def folder(spark, docs, tmp_path):
    """The same documents as a table folder, with the other small tables beside it."""
    for name in ("benchmark", "labels", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)
