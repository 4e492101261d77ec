from __future__ import annotations

import tempfile

import pytest

from outlay.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=4, memory="4g", **{"spark.sql.shuffle.partitions": "4"})
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    yield session
    session.stop()


@pytest.fixture
def column_of(spark):
    """Apply a column function to a list of texts."""

    def apply(values, fn):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
        return [r[1] for r in df.select("i", fn(F.col("x"))).orderBy("i").collect()]

    return apply
