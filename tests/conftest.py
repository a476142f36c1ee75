import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from placework.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of named values."""
    from pyspark.sql import functions as F

    def value(expression, **columns):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]) if columns else spark.range(1)
        return row.select(expression.alias("v")).collect()[0]["v"]

    return value
