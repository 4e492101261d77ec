"""How often jobs read their rows, and what they compute for all of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from outlay.config import DatasetConfig
from outlay.operators import common
from outlay.operators import events as ev
from outlay.operators.normalize import analytics_rows, normalize
from outlay.plans.txn import payments

CONFIG = DatasetConfig(
    jurisdiction_id="place", dataset_id="rows", mapping={"vendor_name": "payee", "amount": "paid", "transaction_date": "day"}
)


def _rows(spark, path):
    rows = [("Ann Inc", "5", "2024-01-02"), ("", "6", "2024-02-03"), ("Bo", "7", None), (None, "8", "x")]
    spark.createDataFrame(rows, "payee string, paid string, day string").write.parquet(path)
    return normalize(spark.read.parquet(path), CONFIG).records


def test_analytics_rows_read_payments_once(spark, tmp_path):
    records = _rows(spark, f"{tmp_path}/in")
    assignment = spark.createDataFrame([("ANN INC", "v1"), ("", "none")], "vendor_name_normalized string, vendor_id string")
    vendors = spark.createDataFrame([("v1", "Ann")], "vendor_id string, canonical_name string")
    found = analytics_rows(records, assignment, vendors)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
    got = {r["vendor_name"]: r["vendor_id"] for r in found.where("amount in (5, 7)").collect()}
    assert got == {"Ann": "v1", "Bo": "unresolved:BO"}
    unnamed = found.where("amount in (6, 8)").select("id", "vendor_id", "vendor_name").collect()
    assert len(unnamed) == 2
    assert all(r["vendor_id"] == f"unresolved:{r['id']}" and r["vendor_name"] == "" for r in unnamed)


def test_digests_are_not_made_for_rows_whose_id_is_not_used(spark, tmp_path):
    plan = _rows(spark, f"{tmp_path}/in").select(F.when(F.col("vendor_name_raw") == "", F.col("id")).alias("x"))
    lines = plan._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = lines[[i for i, line in enumerate(lines) if "Generate" in line][0] :]
    assert "sha2" in lines[0] and not any("sha2" in line for line in below)


def _shuffled(df) -> int:
    df.collect()  # so that the plan is final
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hash")


def test_unique_events_are_matched_without_a_shuffle_of_deliveries(spark):
    events = spark.createDataFrame(
        [("k1", "threshold-exceeded", "V", "J", "C", False, 1), ("k2", "threshold-exceeded", "V", "J", "C", True, 2),
         ("k3", "spending-spike", None, "J", "C", False, 3)],
        "dedupe_key string, type string, watch_id string, jurisdiction_id string, category string, processed boolean, n int",
    )
    subs = spark.createDataFrame(
        [("V", "u", "threshold", True), ("V", "u", "threshold", True), ("S", "w", "category-spike", True)],
        "saved_view_id string, user_id string, type string, is_active boolean",
    )
    views = spark.createDataFrame([("V", "{}"), ("S", "{}")], "saved_view_id string, filters string")
    found = ev.alert_matches(events, subs, views, unique=True, also=("n",))
    wanted = [("u", "V", "k1", 1), ("w", "S", "k3", 3)]
    assert sorted(tuple(r) for r in found.collect()) == wanted
    plain = ev.alert_matches(events, subs, views)
    assert sorted(tuple(r) for r in plain.collect()) == [w[:3] for w in wanted]
    direct = found.where("saved_view_id = 'V'")
    assert _shuffled(direct) < _shuffled(plain.where("saved_view_id = 'V'"))


@pytest.mark.parametrize("rows", [1_000_000, 3, 0])
def test_large_sets_of_rules_are_joined_apart(spark, monkeypatch, rows):
    monkeypatch.setattr(common, "RULE_ROWS", rows)
    monkeypatch.setattr(common, "fits_broadcast", lambda df, n=rows: df.count() <= rows)
    facts = spark.createDataFrame([(i, f"v{i % 3}" if i % 4 else None, f"c{i % 2}") for i in range(40)], "i int, v string, c string")
    rules = [("a", None, "c0"), ("b", None, None), ("d", "v1", "c1")] + [(f"r{i}", f"v{i % 5}", None) for i in range(10)]
    rules = spark.createDataFrame(rules, "r string, w_v string, w_c string")
    got = sorted((x.i, x.r) for x in common.join_wildcards(facts, rules, {"v": "w_v", "c": "w_c"}).collect())
    fits = lambda a, b: a is None or a == b
    wanted = sorted((f.i, r.r) for f in facts.collect() for r in rules.collect() if fits(r.w_v, f.v) and fits(r.w_c, f.c))
    assert got == wanted
    plan = common.join_wildcards(facts, rules, {"v": "w_v", "c": "w_c"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(array_compact") + plan.count("Generate explode(filter") <= 1


def test_joins_of_payments_carry_numbers_not_texts(spark):
    rows = payments(spark, "/root/testdata/sf0.001", "id", "period", "vendor_id", "category", "jurisdiction_id")
    plan = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [i for i, line in enumerate(plan) if "Join" in line]
    made = [i for i, line in enumerate(plan) if "concat_ws(:" in line or "date_format" in line]
    assert joins and made and max(made) < min(joins)
