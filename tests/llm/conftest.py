import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, n long, node long, taken long, host string, `row` long, cell int, spans string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and very long texts, repeated rows, one hot source, extra columns with clashing names."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven", "en", "a", 33),
        (1, "one two three four five six seven", "en", "a", 33),
        (2, None, None, None, None),
        (None, "one two three four five six seven", "en", "a", 33),
        (3, "", "en", "a", 0),
        (4, "   \n\t ", "en", "b", 6),
        (5, long, "en", "a", len(long)),
        (6, "é" * 10 + " " + "漢字 " * 60, "de", None, 191),
        (7, "a b c " * 40, "en", "a", 240),
        (8, "two words", "en", "c", 9),
        (9, "line one\nline one\nline one\n" * 30, "en", "a", 810),
    ]
    return spark.createDataFrame([(*r, *[None] * 9) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where(F.lit(False))
