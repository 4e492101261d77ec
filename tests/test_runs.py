"""Partial sums of streams, merged in levels."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from outlay.streaming import jobs
from outlay.streaming.runs import BATCH, MERGED, Runs

SCHEMA = "k string, total decimal(28,2), count long"


def _sums(spark, batch):
    """Three keys: one in every batch, one in every fourth, one of the batch alone."""
    rows = [("all", batch, 1), (f"only-{batch}", 1, 1), (None, 2, 1)]
    rows += [("fourth", 10, 2)] if batch % 4 == 0 else []
    return spark.createDataFrame(rows, "k string, total int, count long").select(
        "k", F.col("total").cast("decimal(28,2)"), "count"
    )


def _totals(runs):
    rows = jobs.running_totals(runs.read(), ["k"]).collect()
    return {r["k"]: (int(r["total"]), r["count"]) for r in rows}


def _expected(n):
    out = {f"only-{b}": (1, 1) for b in range(n)} | {"all": (sum(range(n)), n), None: (2 * n, n)}
    fourth = len(range(0, n, 4))
    return out | {"fourth": (10 * fourth, 2 * fourth)}


def test_few_runs_hold_every_batch(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "sums"), fanout=3)
    for batch in range(28):
        runs.add(_sums(spark, batch), batch, ["k"])
        held = [b for r in runs.current() for b in range(r.first, r.last + 1)]
        assert held == list(range(batch + 1))
        assert len(runs.current()) <= 2 * (1 + math.log(batch + 1, 3))
    assert len(runs.stored()) <= 3 * 3 * 4  # what was merged goes a generation later
    assert _totals(runs) == _expected(28)
    newest = {r["k"]: r[BATCH] for r in runs.read().groupBy("k").agg(F.max(BATCH).alias(BATCH)).collect()}
    assert newest["all"] == 27 and newest["fourth"] == 24 and newest["only-5"] == 5


def test_dead_writers_and_repeated_batches_change_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "sums")
    runs = Runs(spark, path, fanout=3)
    for batch in range(8):
        runs.add(_sums(spark, batch), batch, ["k"])

    def dies(*_):
        raise RuntimeError("writer gone")

    with monkeypatch.context() as m:  # after the batch is written, before it is merged
        m.setattr(Runs, "_merge", dies)
        with pytest.raises(RuntimeError):
            runs.add(_sums(spark, 8), 8, ["k"])
    _sums(spark, 0).write.parquet(f"{path}/{MERGED}/_staged-dead")
    assert _totals(runs) == _expected(9)
    runs.add(_sums(spark, 8), 8, ["k"])  # the stream repeats it
    assert [r.level for r in runs.current()] == [2] and _totals(runs) == _expected(9)
    runs.add(_sums(spark, 8), 8, ["k"])  # and once more, merged already
    assert _totals(runs) == _expected(9)
    runs.add(_sums(spark, 0), 0, ["k"])  # a stream begun anew
    assert _totals(runs) == _expected(1)


def test_a_writer_that_dies_between_levels_loses_nothing(spark, tmp_path, monkeypatch):
    runs = Runs(spark, str(tmp_path / "sums"), fanout=2)
    merge = Runs._merge

    def dies(self, level, *rest):
        if level == 2:
            raise RuntimeError("writer gone")
        merge(self, level, *rest)

    for batch in range(8):
        if batch == 3:
            with monkeypatch.context() as m:
                m.setattr(Runs, "_merge", dies)
                with pytest.raises(RuntimeError):
                    runs.add(_sums(spark, batch), batch, ["k"])
            assert {r.level for r in runs.current()} == {1}
        # Batch 3 isn't repeated: its upper level stays undone, and no run of it may go.
        else:
            runs.add(_sums(spark, batch), batch, ["k"])
        assert _totals(runs) == _expected(batch + 1)


def test_empty_batches(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "sums"), fanout=2)
    for batch in range(4):
        runs.add(spark.createDataFrame([], SCHEMA), batch, ["k"])
    assert runs.read().count() == 0 and len(runs.current()) == 1


def test_a_stream_of_many_files(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for i in range(10):
        (folder / f"{i}.csv").write_text(f"2024-01-0{i % 3 + 1} 10:00:00,a,{i}\n")
    rows = spark.readStream.schema("ts timestamp, kind string, value int").option("maxFilesPerTrigger", 1)
    stream = rows.csv(str(folder))
    jobs.stream_totals(stream, "ts", "1 day", ["kind"], F.col("value"), out, f"{out}-state").awaitTermination()
    runs = Runs(spark, out)
    assert [(r.level, r.first) for r in runs.current()] == [(1, 0), (0, 8), (0, 9)]
    got = jobs.running_totals(runs.read(), ["window_start", "kind"]).orderBy("window_start").collect()
    assert [(r["total"], r["count"]) for r in got] == [(0 + 3 + 6 + 9, 4), (1 + 4 + 7, 3), (2 + 5 + 8, 3)]


def test_stream_has_as_many_micro_batches_as_slices(spark, tmp_path):
    """Each takes many files, so that several tasks share it, and every row comes once."""
    from outlay.plans import q_store

    sizes = []

    def sink(df, _):
        sizes.append((df.count(), df.rdd.getNumPartitions()))

    (tmp_path / "sf").mkdir()
    rows = spark.range(20_000).selectExpr("id", "date_add(date'2000-01-01', cast(id % 365 as int)) AS day")
    rows.coalesce(1).write.parquet(f"{tmp_path}/sf/rows.parquet")
    arriving = q_store.stream(spark, f"{tmp_path}/sf", "rows", "day")
    running = arriving.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state")
    running.trigger(availableNow=True).start().awaitTermination()
    assert sum(n for n, _ in sizes) == 20_000 and len(sizes) <= q_store.SLICES
    assert all(parts > 1 for _, parts in sizes)
