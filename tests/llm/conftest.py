import random

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of the given texts, with ids from 0."""

    def make(texts, **columns):
        rows = [(i, text, *(values[i] for values in columns.values())) for i, text in enumerate(texts)]
        names = "".join(f", {name} string" for name in columns)
        return spark.createDataFrame(rows, f"doc_id long, text string{names}")

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture()
def rng():
    return random.Random(7)
