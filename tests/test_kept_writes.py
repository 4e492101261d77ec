"""What upserts and loads leave as it is."""

from __future__ import annotations

from decimal import Decimal

import pytest

from outlay.config import DatasetConfig
from outlay.operators import store as st
from outlay.operators.normalize import normalize


@pytest.fixture
def store(spark, tmp_path):
    return st.Store(spark, str(tmp_path / "store"))


def batch(spark, *rows):
    rows = [(i, j, Decimal(a)) for i, j, a in rows]
    return spark.createDataFrame(rows, "id string, jurisdiction_id string, amount decimal(18,2)")


def rows_of(store):
    return sorted((r.id, r.jurisdiction_id, int(r.amount)) for r in store.read("transactions").collect())


def test_only_writes_that_hold_a_key_of_the_batch_are_written_anew(spark, store):
    store.save_transactions(batch(spark, ("1", "J", 1), ("2", "J", 2)))
    first = store.version("transactions").folders["jurisdiction_id=J"]
    counts = store.save_transactions(batch(spark, ("3", "J", 3)))
    assert (counts.inserted, counts.updated) == (1, 0)
    second = store.version("transactions").folders["jurisdiction_id=J"]
    assert second[: len(first)] == first and len(second) == 2
    counts = store.save_transactions(batch(spark, ("3", "J", 4), ("4", "J", 5)), moves=False)
    assert (counts.inserted, counts.updated) == (1, 1)
    third = store.version("transactions").folders["jurisdiction_id=J"]
    assert third[0] == first[0] and second[1] not in third
    assert rows_of(store) == [("1", "J", 1), ("2", "J", 2), ("3", "J", 4), ("4", "J", 5)]
    store.save_transactions(batch(spark, ("1", "K", 6)))  # moves
    assert rows_of(store) == [("1", "K", 6), ("2", "J", 2), ("3", "J", 4), ("4", "J", 5)]


def test_a_jurisdiction_that_is_named_is_replaced_without_staging(spark, store, monkeypatch):
    store.save_transactions(batch(spark, ("1", "J", 1), ("2", "K", 2)))
    monkeypatch.setattr(store, "_staged", None)
    store.replace_jurisdiction(batch(spark, ("3", "J", 3)), "transactions", ["J"])
    assert rows_of(store) == [("2", "K", 2), ("3", "J", 3)]


def test_identical_source_rows_are_numbered_before_they_are_mapped(spark):
    config = DatasetConfig(jurisdiction_id="J", dataset_id="d", mapping={"amount": "paid", "vendor_name": "who"})
    rows = spark.createDataFrame([("1", "a")] * 3 + [("1", None)] * 2 + [("2", "a")], "paid string, who string")
    plain = {r.id for r in normalize(rows, config).records.collect()}
    apart = normalize(rows, config, apart=True).records
    got = sorted(r.id for r in apart.collect())
    assert len(set(got)) == 6 and {i.partition("#")[0] for i in got} == plain
    assert sorted(i.partition("#")[2] for i in got) == ["", "", "", "2", "2", "3"]
    plan = apart._jdf.queryExecution().optimizedPlan().toString().split("\n")
    window = min(i for i, line in enumerate(plan) if "Window" in line)
    assert all("sha2" not in line for line in plan[window:])
