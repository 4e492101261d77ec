"""Substring search through posting lists, against a plain scan of all payments."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from outlay.operators import explore, name_index
from outlay.operators.store import MOST_WRITES, Store

NAMES = ["Acme Supply", "ACME SUPPLY Co", "ab", "a", "", None, "Ünïon Söhne", "İstanbul", "100% Pure_Water", "aaaa aaa"]


def _rows(spark, numbers):
    pick = random.Random(7)
    words = ["acme", "Supply", "north", "NORTHERN", "ab", "Söhne", "co."]
    names = NAMES + [" ".join(pick.choice(words) for _ in range(pick.randint(1, 4))) for _ in range(60)]
    rows = [(f"{i}", f"j{i % 5}" if i % 11 else None, names[i % len(names)], i) for i in numbers]
    return spark.createDataFrame(rows, "id string, jurisdiction_id string, vendor_name_raw string, a int").select(
        "id", "jurisdiction_id", "vendor_name_raw", F.col("a").cast("decimal(18,2)").alias("amount")
    )


def _stored(store):
    return store.read("transactions").withColumnRenamed("vendor_name_raw", "vendor_name")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("names")))
    for numbers in (range(0, 90), range(60, 200), range(0, 30)):
        store.save_transactions(_rows(spark, numbers))
    return store


@pytest.mark.parametrize("text", ["acme", "ab", "AB", "  supply c ", "hne", "ünïon", "i̇s", "%", "100%", "e_w", "aaa", "zzz", "a", None])
def test_same_payments_as_a_scan(spark, store, text):
    s = explore.Search(q=text)
    everything = _stored(store)
    want = sorted(r["id"] for r in explore.search(everything, s).collect())
    assert sorted(r["id"] for r in explore.search(store.searched(s), s).collect()) == want
    assert everything.count() == 200


def test_many_names_are_joined(spark, store, monkeypatch):
    monkeypatch.setattr(name_index, "PUSHED_NAMES", 3)
    s = explore.Search(q="no")
    want = sorted(r["id"] for r in explore.search(_stored(store), s).collect())
    assert len(want) > 20 and sorted(r["id"] for r in store.searched(s).collect()) == want


def test_only_lists_and_payments_found_are_read(store):
    lists = store.names_like("acme")._jdf.queryExecution().executedPlan().toString()
    assert lists.count("FileScan") == 1 and "In(piece, [acm,cme])" in lists
    assert "bucket" in lists.split("PartitionFilters: [")[1].split("]")[0]
    rows = store.searched(explore.Search(q="pure_w"))._jdf.queryExecution().executedPlan().toString()
    assert "100% Pure_Water" in rows.split("PushedFilters: [")[1]
    assert "jurisdiction_id" in rows.split("PartitionFilters: [")[1].split("]")[0]


def test_known_names_add_nothing_and_buckets_stay_few(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = spark.createDataFrame([("j", "same name")], "jurisdiction_id string, vendor_name string")
    store.index_names(first)
    version = store.version("name_postings").number
    store.index_names(first)
    assert store.version("name_postings").number == version
    for i in range(MOST_WRITES + 2):
        more = [("j", f"same name {i}"), ("j", None)]
        store.index_names(spark.createDataFrame(more, first.schema))
    writes = [len(w) for w in store.version("name_postings").folders.values()]
    assert max(writes) <= MOST_WRITES
    assert store.names_like("same name").count() == MOST_WRITES + 3
    assert store.names_like("name 3").count() == 1


def test_nothing_is_indexed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.index_names(spark.createDataFrame([], "jurisdiction_id string, vendor_name string"))
    assert store.names_like("acme").count() == 0
    assert store.searched(explore.Search(q="acme")).count() == 0
