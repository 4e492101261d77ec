"""The ingest job end to end, upserts, and streaming over landed files."""

from __future__ import annotations

import dataclasses
import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from outlay.config import DatasetConfig
from outlay.operators.store import Store
from outlay.plans.ingest import bulk_load, run_due, run_ingest
from outlay.schema import SPEND_DATASETS, WATCHES
from outlay.session import checkpoint_dir
from outlay.sources import files
from outlay.streaming import jobs

CONFIG = DatasetConfig(
    jurisdiction_id="demo-city",
    mapping={
        "source_record_id": "id",
        "vendor_name": "vendor",
        "department": "dept",
        "amount": "amount",
        "transaction_date": "date",
        "procurement_method": "proc",
    },
)
CSV = """id,vendor,dept,amount,date,proc
11,Harbor Tools Inc,Roads,1000,2025-01-09,Sole Source
12,HARBOR TOOLS INC.,Roads,2000,2025-02-11,Sole Source
13,Harbor Tools Inc,Roads,3000,2025-03-20,Sole Source
14,Juniper Books LLC,Library,500,2025-01-27,Competitive Bid
"""
NOW = dt.datetime(2026, 6, 3)


@pytest.fixture
def landed(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "a.csv").write_text(CSV)
    return files.read_csv(spark, str(folder))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_ingest_twice_then_a_broken_source(spark, landed, store):
    names = WATCHES.fieldNames()
    watch = {"watch_id": "w1", "kind": "threshold", "min_amount": Decimal(2500), "ordinal": 0}
    watches = spark.createDataFrame([tuple(watch.get(n) for n in names)], WATCHES)

    run = run_ingest(spark, CONFIG, landed, store, NOW, watches)
    assert (run.status, run.rows_seen, run.rows_new, run.anomalous) == ("success", 4, 4, False)
    assert store.read("transactions").count() == 4
    assert store.read("vendors").count() == 2
    assert store.read("transactions").where("vendor_id IS NULL").count() == 0
    (event,) = store.read("spend_events").collect()
    assert (event.type, event.amount) == ("threshold-exceeded", 3000)
    total = store.read("spend_aggregates").where("dimension = 'vendor'").agg(F.sum("total")).first()[0]
    assert total == 6500

    again = run_ingest(spark, CONFIG, landed, store, NOW + dt.timedelta(days=1), watches)
    assert (again.rows_new, again.rows_updated) == (0, 4)
    assert store.read("transactions").count() == 4 and store.read("spend_events").count() == 1

    renamed = landed.withColumnRenamed("amount", "amt")
    broken = run_ingest(spark, CONFIG, renamed, store, NOW + dt.timedelta(days=2))
    assert (broken.status, broken.error_code, broken.anomalous) == ("failed", "portal_shape_changed", True)
    assert any("shape" in r for r in broken.reasons)
    assert store.read("sync_runs").count() == 3 and store.read("transactions").count() == 4


def test_partial_run_counts_rejects(spark, landed, store):
    spoiled = landed.withColumn("amount", F.when(F.col("id") == "14", "n/a").otherwise(F.col("amount")))
    run = run_ingest(spark, CONFIG, spoiled, store, NOW)
    assert (run.status, run.rows_seen, run.mapping_errors, run.rows_new) == ("partial", 4, 1, 3)
    assert run.reasons == ["High mapping-failure rate: 25%"]


def test_budgets_are_kept_by_business_key(spark, store):
    config = DatasetConfig(
        "demo-city",
        {"amount_budgeted": "b", "department": "d", "fiscal_year": "y"},
        record_type="budget",
    )
    df = spark.createDataFrame([("100", "Parks Dept", "2025"), ("50", None, "2025")], "b string, d string, y string")
    assert run_ingest(spark, config, df, store, NOW).rows_new == 2
    again = run_ingest(spark, config, df.withColumn("b", F.lit("120")), store, NOW)
    assert (again.rows_new, again.rows_updated) == (0, 2)
    assert {r.amount_budgeted for r in store.read("budgets").collect()} == {Decimal(120)}


def test_upsert_moves_rows_between_partitions(spark, store):
    schema = "id string, jurisdiction_id string, amount decimal(18,2)"
    one = spark.createDataFrame([("a", "J", Decimal(1)), ("b", "J", Decimal(2)), ("c", "K", Decimal(3))], schema)
    store.save_transactions(one)
    two = spark.createDataFrame([("a", "L", Decimal(9)), ("a", "L", Decimal(8))], schema)
    counts = store.save_transactions(two, F.col("amount"))
    assert (counts.inserted, counts.updated) == (0, 1)
    got = {(r.id, r.jurisdiction_id, r.amount) for r in store.read("transactions").collect()}
    assert got == {("a", "L", 9), ("b", "J", 2), ("c", "K", 3)}


def test_stream_ingest_is_idempotent_over_files(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "id string, vendor string, dept string, amount string, date string, proc string"
    source = lambda: spark.readStream.schema(schema).option("header", True).csv(str(folder))
    state = str(tmp_path / "state")
    (folder / "a.csv").write_text(CSV)
    jobs.stream_ingest(source(), CONFIG, store, state).awaitTermination()
    (folder / "b.csv").write_text(CSV + "15,Oakline Inc,Library,70,2025-04-01,\n16,Oakline Inc,Library,none,2025-04-01,\n")
    jobs.stream_ingest(source(), CONFIG, store, state).awaitTermination()
    assert store.read("transactions").count() == 5
    assert [r.reason for r in store.read("rejects").collect()] == ["no parseable amount in amount"]


def test_an_emptied_partition_is_cleared(spark, store):
    schema = "id string, jurisdiction_id string, amount decimal(18,2)"
    store.save_transactions(spark.createDataFrame([("1", "J 1", Decimal(1)), ("2", "J/2", Decimal(2))], schema))
    counts = store.save_transactions(spark.createDataFrame([("1", "J/2", Decimal(5))], schema))
    assert (counts.inserted, counts.updated) == (0, 1)
    got = {(r.id, r.jurisdiction_id, r.amount) for r in store.read("transactions").collect()}
    assert got == {("1", "J/2", 5), ("2", "J/2", 2)}
    empty = spark.createDataFrame([], schema)
    store.replace_jurisdiction(empty, "transactions", ["J/2"])
    assert store.read("transactions").count() == 0


def test_null_partition_and_repeats(spark, store):
    schema = "id string, jurisdiction_id string, amount decimal(18,2)"
    one = spark.createDataFrame([("1", None, Decimal(1)), ("1", None, Decimal(1)), ("2", "K", Decimal(2))], schema)
    assert store.save_transactions(one).inserted == 2
    moved = spark.createDataFrame([("1", "K", Decimal(3))], schema)
    assert store.save_transactions(moved).updated == 1
    assert {(r.id, r.jurisdiction_id) for r in store.read("transactions").collect()} == {("1", "K"), ("2", "K")}


def test_last_row_of_a_business_key_wins(spark, store):
    schema = "jurisdiction_id string, fiscal_year int, department string, category string, amount_budgeted decimal(18,2), n int"
    rows = [("J", 2025, "a|b", "c", Decimal(i), i) for i in range(8)] + [("J", 2025, "a", "b|c", Decimal(99), 0)]
    batch = spark.createDataFrame(rows, schema).repartition(4)
    assert store.save_budgets(batch, F.col("n")).inserted == 2
    got = {(r.department, r.amount_budgeted) for r in store.read("budgets").collect()}
    assert got == {("a|b", 7), ("a", 99)}


def test_upserts_prune_and_leave_no_scratch(spark, store, tmp_path):
    schema = "id string, jurisdiction_id string, amount decimal(18,2)"
    rows = [(f"{j}:{i}", j, Decimal(i)) for j in "ABCD" for i in range(5)]
    store.save_transactions(spark.createDataFrame(rows, schema))
    inside = store.read("transactions").where(store._within("jurisdiction_id", ["A", None]))
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "PartitionFilters: [" in plan
    before = {p.name for p in (tmp_path / "store" / "transactions" / "jurisdiction_id=B").iterdir()}
    store.save_transactions(spark.createDataFrame([("A:0", "A", Decimal(50))], schema), moves=False)
    assert {p.name for p in (tmp_path / "store" / "transactions" / "jurisdiction_id=B").iterdir()} == before
    scratch = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/outlay")
    fs = scratch.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    left = [s.getPath().getName() for s in fs.listStatus(scratch)] if fs.exists(scratch) else []
    assert not [name for name in left if name.startswith("stage")]


def test_late_events_are_kept_and_restarts_add_none(spark, store, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    schema = "id string, jurisdiction_id string, period string, amount decimal(18,2)"

    def run(checkpoint):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).csv(str(folder))
        match = lambda df: df.withColumn("dedupe_key", F.concat_ws(":", "jurisdiction_id", "id"))
        jobs.stream_watch_events(source, match, store, checkpoint).awaitTermination()

    for n, period in enumerate(["2024-06", "2023-01", "2024-06", "2022-01"]):
        (folder / f"{n}.csv").write_text("".join(f"{period}-{i},J,{period},{i}\n" for i in range(50)))
    run(state)
    assert store.read("spend_events").count() == 150  # the third file repeats the first
    run(state)
    run(str(tmp_path / "fresh"))  # everything once more, as after a lost checkpoint
    assert store.read("spend_events").count() == 150


def test_stream_totals_count_late_rows(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    schema = "ts timestamp, kind string, value int"

    def run():
        rows = spark.readStream.schema(schema).csv(str(folder))
        jobs.stream_totals(rows, "ts", "1 day", ["kind"], F.col("value"), out, state).awaitTermination()

    (folder / "1.csv").write_text("2024-01-01 10:00:00,a,1\n2024-01-09 10:00:00,a,5\n")
    run()
    (folder / "2.csv").write_text("2024-01-01 23:00:00,a,2\n")
    run()
    written = spark.read.parquet(out)
    totals = jobs.running_totals(written, ["window_start", "kind"]).orderBy("window_start").collect()
    assert [(r.window_start.day, r.total, r["count"]) for r in totals] == [(1, 3, 2), (9, 5, 1)]


def test_spikes_follow_the_totals_of_all_batches(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path)
    folder.mkdir()
    schema = "scope string, period string, amount decimal(18,2)"

    def run():
        rows = spark.readStream.schema(schema).csv(str(folder))
        jobs.stream_spikes(rows, "scope", f"{path}/totals", f"{path}/out", f"{path}/state").awaitTermination()
        read = spark.read.parquet
        return jobs.latest_spikes(read(f"{path}/out"), read(f"{path}/totals"), "scope").collect()

    months = [f"2024-{m:02d}" for m in range(1, 13)]
    (folder / "1.csv").write_text("".join(f"a,{m},{1000 + 10 * i + 90000 * (i == 11)}\n" for i, m in enumerate(months)))
    assert [r.period for r in run()] == ["2024-12"]
    (folder / "2.csv").write_text("".join(f"a,{m},90000\n" for m in months[:11]))
    assert run() == []  # late rows level the history, and the spike is one no more


def test_due_datasets_are_ingested_and_noted(spark, landed, store):
    rows = [
        ("demo-city", "d1", "daily", True, "new", None),
        ("other-city", "d2", "daily", True, "active", NOW - dt.timedelta(hours=1)),
        ("other-city", "d3", "daily", False, "new", None),
    ]
    store.append(spark.createDataFrame(rows, SPEND_DATASETS), "spend_datasets", ["jurisdiction_id"])
    config = dataclasses.replace(CONFIG, dataset_id="d1")
    sources = {("demo-city", "d1"): (config, lambda: landed)}
    runs = run_due(spark, store, sources, NOW)
    assert {k: r.rows_new for k, r in runs.items()} == {("demo-city", "d1"): 4}
    noted = {r.dataset_id: (r.status, r.last_synced_at) for r in store.read("spend_datasets").collect()}
    assert noted["d1"] == ("active", NOW) and noted["d2"][0] == "active" and noted["d3"] == ("new", None)
    assert run_due(spark, store, sources, NOW + dt.timedelta(hours=2)) == {}


def test_bulk_load_replaces_and_keeps_identical_lines(spark, landed, store):
    stale = spark.createDataFrame([("x", CONFIG.jurisdiction_id)], "id string, jurisdiction_id string")
    store.save_transactions(stale)
    run = bulk_load(spark, CONFIG, [landed, landed.limit(2)], store, dt.datetime(2025, 3, 25))
    assert (run.status, run.rows_seen, run.rows_new) == ("success", 6, 5)  # March is not complete
    rows = store.read("transactions").collect()
    assert len({r.id for r in rows}) == 5 and sum(r.amount for r in rows) == 2 * 3000 + 500
    assert all(r.vendor_id for r in rows)
