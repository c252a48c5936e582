import pytest

from corpus_rows import ODD, documents


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    """Real rows: id and text of the smallest driver table."""
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "text").collect()]
