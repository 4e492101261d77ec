"""Versions of stored tables: writers that die, writers that meet, and old files."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from outlay.operators.store import Conflict, Store

SCHEMA = "id string, jurisdiction_id string, amount decimal(18,2)"


@pytest.fixture
def store(spark, tmp_path):
    found = Store(spark, str(tmp_path / "store"))
    found.save_transactions(batch(spark, [("1", "J", 1), ("2", "K", 2), ("3", "K", 3)]))
    return found


def batch(spark, rows):
    return spark.createDataFrame([(i, j, Decimal(a)) for i, j, a in rows], SCHEMA)


def rows_of(df):
    return sorted((r.id, r.jurisdiction_id, int(r.amount)) for r in df.collect())


def test_a_writer_that_dies_before_the_switch_changes_nothing(spark, store, monkeypatch):
    before = rows_of(store.read("transactions"))

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(store, "_commit", die)
        with pytest.raises(KeyboardInterrupt):
            store.save_transactions(batch(spark, [("1", "J", 50), ("4", "L", 4)]))
    assert rows_of(store.read("transactions")) == before and store.versions("transactions") == [1]
    # What it left is in the way of nobody, and goes with time.
    counts = store.save_transactions(batch(spark, [("1", "J", 60)]))
    assert (counts.inserted, counts.updated) == (0, 1)
    assert rows_of(store.read("transactions")) == [("1", "J", 60), ("2", "K", 2), ("3", "K", 3)]
    assert store.vacuum("transactions") == 0
    assert store.vacuum("transactions", keep=1, dead_after=-1) == 3  # two dead folders, one old one
    assert rows_of(store.read("transactions")) == [("1", "J", 60), ("2", "K", 2), ("3", "K", 3)]


def test_a_job_that_fails_while_writing_changes_nothing(spark, store):
    bad = batch(spark, [("1", "J", 9)]).withColumn("vendor_id", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        store.replace_jurisdiction(bad, "transactions", ["J"])
    assert rows_of(store.read("transactions")) == [("1", "J", 1), ("2", "K", 2), ("3", "K", 3)]


def test_readers_keep_the_version_they_read(spark, store):
    earlier = store.read("transactions")
    store.save_transactions(batch(spark, [("2", "J", 7)]))
    assert rows_of(earlier) == [("1", "J", 1), ("2", "K", 2), ("3", "K", 3)]
    assert rows_of(store.read("transactions")) == [("1", "J", 1), ("2", "J", 7), ("3", "K", 3)]
    assert rows_of(store.read("transactions", store.version("transactions", 1))) == rows_of(earlier)


def _meanwhile(store, monkeypatch, other):
    """Let another writer finish between the write of one and its switch."""
    commit = store._commit

    def late(*args):
        monkeypatch.setattr(store, "_commit", commit)
        other()
        commit(*args)

    monkeypatch.setattr(store, "_commit", late)


def test_writers_of_one_partition_conflict(spark, store, monkeypatch):
    other = Store(spark, store.root)
    _meanwhile(store, monkeypatch, lambda: other.save_transactions(batch(spark, [("1", "J", 70)]), moves=False))
    with pytest.raises(Conflict, match="version 1 to 2"):
        store.save_transactions(batch(spark, [("1", "J", 80)]), moves=False)
    assert rows_of(store.read("transactions"))[0] == ("1", "J", 70)
    assert store.save_transactions(batch(spark, [("1", "J", 80)]), moves=False).updated == 1


def test_writers_of_different_partitions_both_succeed(spark, store, monkeypatch):
    other = Store(spark, store.root)
    _meanwhile(store, monkeypatch, lambda: other.save_transactions(batch(spark, [("2", "K", 70)]), moves=False))
    store.save_transactions(batch(spark, [("1", "J", 80)]), moves=False)
    assert rows_of(store.read("transactions")) == [("1", "J", 80), ("2", "K", 70), ("3", "K", 3)]


def test_a_version_is_added_once(spark, store, monkeypatch):
    base = store.version("transactions")
    other = Store(spark, store.root)
    write, filled, _ = store._put(batch(spark, [("9", "M", 9)]), "transactions", ["jurisdiction_id"])
    again, refilled, _ = other._put(batch(spark, [("8", "N", 8)]), "transactions", ["jurisdiction_id"])
    stale = other.version  # the second writer looks before the first adds its version
    seen = iter([base])
    monkeypatch.setattr(other, "version", lambda t, n=None: next(seen, None) or stale(t, n))
    store._commit("transactions", base, write, filled, [], [])
    other._commit("transactions", base, again, refilled, [], [])
    assert store.versions("transactions") == [1, 2, 3]
    assert rows_of(store.read("transactions"))[3:] == [("8", "N", 8), ("9", "M", 9)]


def test_appended_rows_stay_together(spark, store):
    for n in (5, 6):
        store.append(batch(spark, [(str(n), None, n), (f"{n}b", "J", n)]), "transactions", ["jurisdiction_id"])
    got = {(r.id, r.jurisdiction_id) for r in store.read("transactions").collect()}
    assert got == {("1", "J"), ("2", "K"), ("3", "K"), ("5", None), ("5b", "J"), ("6", None), ("6b", "J")}
    inside = store.read("transactions").where("jurisdiction_id = 'K'")
    assert "PartitionFilters: [isnotnull(jurisdiction_id" in inside._jdf.queryExecution().executedPlan().toString()


def test_stored_rows_are_read_by_column(spark):
    from outlay.session import stored

    rows = spark.range(3).selectExpr("id", "map('a', id) AS m", "cast(null AS decimal(18,2)) AS d")
    kept = stored(rows)
    assert kept.schema.simpleString() == rows.schema.simpleString()
    assert sorted(map(str, kept.collect())) == sorted(map(str, rows.collect()))
    assert "ReadSchema: struct<id:bigint>" in kept.select("id")._jdf.queryExecution().toString()
