from __future__ import annotations

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text) as a documents table, with further columns whose names operators use inside."""

    def make(rows):
        df = spark.createDataFrame(list(rows), "doc_id long, text string")
        extra = {n: F.lit(7).cast("long") for n in ("key", "fp", "n", "h", "row", "rank", "label", "root", "n_words", "spans", "item_id", "bucket", "hashes", "__good")}
        return df.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), **extra})

    return make


@pytest.fixture(scope="session")
def small_docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def small_texts(small_docs):
    return {r["doc_id"]: r["text"] for r in small_docs.collect()}
