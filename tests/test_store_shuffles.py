"""What upserts shuffle, and that one shuffle gives what a join gave."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from outlay.operators import store as st

SCHEMA = "id string, jurisdiction_id string, amount decimal(18,2)"


@pytest.fixture
def store(spark, tmp_path):
    return st.Store(spark, str(tmp_path / "store"))


def batch(spark, rows):
    return spark.createDataFrame([(i, j, Decimal(a)) for i, j, a in rows], SCHEMA)


def rows_of(df):
    return sorted((r.id or "", r.jurisdiction_id, int(r.amount)) for r in df.collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_upsert_shuffles_batch_and_stored_rows_once(spark, store, monkeypatch):
    plans, put = [], store._put

    def noted(df, table, partition, *more):
        plans.append((plan_of(df), *more))
        return put(df, table, partition, *more)

    monkeypatch.setattr(store, "_put", noted)
    store.save_transactions(batch(spark, [("1", "J", 1), ("2", "K", 2)]))
    store.save_transactions(batch(spark, [("1", "J", 3), ("3", "K", 4)]))
    for plan, gather in plans:
        assert plan.count("Exchange") == 1 and "Join" not in plan and not gather
    assert rows_of(store.read("transactions")) == [("1", "J", 3), ("2", "K", 2), ("3", "K", 4)]


def test_many_partitions_are_gathered(spark, store, monkeypatch):
    monkeypatch.setattr(st, "MOST_FILES", 1)
    store.save_transactions(batch(spark, [("1", "J", 1), ("2", "K", 2)]))
    store.save_transactions(batch(spark, [("1", "K", 3)]))  # moves
    assert rows_of(store.read("transactions")) == [("1", "K", 3), ("2", "K", 2)]


def test_null_keys_and_stored_repeats_stay(spark, store):
    stored = [(None, "J", 1), (None, "J", 2), ("1", "J", 3), ("1", "J", 4), ("2", "J", 5), ("2", "J", 6)]
    store.append(batch(spark, stored), "transactions", ["jurisdiction_id"])
    new = batch(spark, [(None, "J", 7), (None, "J", 8), ("1", "J", 9), ("1", "J", 10), ("4", "J", 11)])
    counts = store.save_transactions(new, F.col("amount"))
    assert (counts.inserted, counts.updated) == (2, 1)
    kept = [("", "J", 1), ("", "J", 2), ("", "J", 8), ("1", "J", 10), ("2", "J", 5), ("2", "J", 6), ("4", "J", 11)]
    assert rows_of(store.read("transactions")) == kept


def test_keys_that_hardly_repeat_are_not_dropped_before_the_shuffle(spark, store, monkeypatch):
    called = []
    last_wins = st.last_wins
    monkeypatch.setattr(st, "last_wins", lambda *a: called.append(1) or last_wins(*a))
    columns = "jurisdiction_id string, vendor_name_normalized string, amount decimal(18,2), term_start date"
    few = spark.createDataFrame([("J", f"v{i}", Decimal(i), None) for i in range(20)], columns)
    store.save_contracts(few)
    assert not called and store.read("contracts").count() == 20
    store.save_contracts(few.crossJoin(spark.range(5)).drop("id"))
    assert called and store.read("contracts").count() == 20


def test_last_wins_sorts_by_a_number_first(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, n long")
    last = st.last_wins(rows.withColumn("key", F.struct("k")), ["key"], F.col("n"))
    assert "Sort [_place" in plan_of(last) and sorted(r.n for r in last.collect()) == [2, 4]
    assert last.columns == ["k", "n", "key"]
