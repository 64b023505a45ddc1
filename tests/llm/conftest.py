import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows to a DataFrame under a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
