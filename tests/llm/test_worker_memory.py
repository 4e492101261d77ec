"""What a worker holds between slices."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from outlay.llm import base, mixing, packing
from outlay.llm.queries import TOKENIZER


class Caught:
    """Stands for a DataFrame; runs the function on one batch."""

    def mapInArrow(self, run, schema):  # noqa: N802
        return list(run(iter([pa.RecordBatch.from_pydict({"x": list(range(100))})])))


def test_arrow_gives_memory_back_after_every_slice(monkeypatch):
    released = []
    pool = type("Pool", (), {"release_unused": lambda self: released.append(1)})()
    monkeypatch.setattr(base.pa, "default_memory_pool", lambda: pool)
    out = base.in_batches(Caught(), lambda rows: {"x": rows.column("x")}, "x long", 400)
    assert [x for b in out for x in b.column("x").to_pylist()] == list(range(100))
    assert len(released) == len(out) > 1


def test_workers_keep_the_tokenizer_only_while_they_tokenize():
    base.in_batches(Caught(), lambda rows: {"x": rows.column("x")}, "x long")
    kept = packing.encoder(TOKENIZER)
    base.in_batches(Caught(), lambda rows: {"x": rows.column("x")}, "x long", keeps="encoder")
    assert packing.encoder(TOKENIZER) is kept
    base.in_batches(Caught(), lambda rows: {"x": rows.column("x")}, "x long")
    assert packing.encoder.cache_info().currsize == 0


def test_places_are_read_without_python_workers(spark):
    rows = spark.range(20, numPartitions=3).withColumn("twice", F.col("id") * 2)
    placed = mixing.numbered(rows, F.desc("id"))
    assert [r["place"] for r in placed.orderBy("id").collect()] == list(range(19, -1, -1))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD") == 1  # the sorted rows, which are a checkpoint
    assert mixing.numbered(rows.where("id < 0"), "id").count() == 0
