"""Mentions that come counted, and those that come one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.operators import incremental, resolve
from outlay.plans import q_resolve

SMOKE = "/root/testdata/sf0.001"


def test_payees_are_counted_before_names_are_joined(spark):
    rows = q_resolve.mentions(spark, SMOKE)
    lines = spark.read.parquet(f"{SMOKE}/lineitem.parquet")
    assert rows.agg(F.sum("n")).first()[0] == lines.count()
    assert rows.count() == rows.select("p_partkey").distinct().count()


def test_counted_mentions_weigh_as_many(spark):
    rows = q_resolve.mentions(spark, SMOKE)
    single = rows.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("_", "n")
    order = lambda df: sorted(map(str, df.collect()))
    assert order(resolve.value_counts(rows)) == order(resolve.value_counts(single))
    part = F.col("p_partkey") % 3 == 0
    counted = incremental.signed_counts(rows, rows.where(part))
    assert order(counted) == order(incremental.signed_counts(single, single.where(part)))
