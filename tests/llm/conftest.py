import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties, and columns whose names the operators use themselves."""
    long_words = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [None, "", " \n\t ", "x" * 300_000, long_words, "one", "Just a few words here.", "a b c d e f g h i j", "a b c d e f g h i j", "É\nÇa va?\n\nÉ"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 2}" if i % 3 else None, len(t) if t else None) for i, t in enumerate(texts)]
    rows += [rows[6], (None, "a row without an id that has some words", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    clash = ["blob", "spans", "h1", "salt", "shard", "slot", "bucket", "key", "size", "epoch", "n", "quality", "selected", "signature", "keep", "holder", "__bucket2", "_id", "word", "score"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
