"""What jobs leave behind on local disks."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from outlay.session import CLEANUP, cut, stored, tidy


def shuffle_files(spark) -> set[str]:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = blocks.getAllFiles()
    found = {names.apply(i).getName() for i in range(names.size())}
    return {n for n in found if n.startswith("shuffle_")}


@pytest.mark.parametrize("kept", [cut, stored])
def test_materialized_rows_leave_no_shuffle_files(spark, kept):
    before = shuffle_files(spark)
    rows = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s"))
    found = kept(rows)
    end = time.time() + 20
    # They go in the background.
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert sum(r["s"] for r in found.collect()) == 499500


def test_the_setting_of_the_session_comes_back(spark):
    before = spark.conf.get(CLEANUP)
    with pytest.raises(ZeroDivisionError), tidy(spark):
        assert spark.conf.get(CLEANUP) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(CLEANUP) == before
