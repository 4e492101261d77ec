"""Aggregates, windows, search, events, alerts and health on tiny rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from outlay.operators import common, concentration, events, explore, health, spend, trends
from outlay.schema import SYNC_RUNS, WATCHES

SCHEMA = (
    "id string, jurisdiction_id string, vendor_id string, vendor_name string, department string,"
    " category string, amount decimal(18,2), date date, period string, fiscal_year int,"
    " procurement_method string"
)


def rows(spark, *items):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    names = [n.strip() for n in names]
    data = []
    for i, item in enumerate(items):
        base = {"id": str(i + 1), "jurisdiction_id": "J", "vendor_name": item.get("vendor_id"), **item}
        if base.get("amount") is not None:
            base["amount"] = Decimal(str(base["amount"]))
        data.append(tuple(base.get(n) for n in names))
    return spark.createDataFrame(data, SCHEMA)


def test_concentration(spark):
    df = rows(
        spark,
        {"vendor_id": "A", "amount": 800},
        {"vendor_id": "B", "amount": 200},
        {"vendor_id": "C", "amount": 50},
        {"vendor_id": "C", "amount": -60},
    )
    (c,) = concentration.concentration(df).collect()
    assert (c.total, c.vendor_count, c.top_vendor_id) == (1000, 2, "A")
    assert c.top_share == pytest.approx(0.8) and c.hhi == pytest.approx(0.68)
    assert [r.vendor_id for r in concentration.top_vendors(df, n=1).collect()] == ["A"]


def test_spikes(spark):
    months = [f"2025-{m:02d}" for m in range(1, 8)]
    jump = [{"vendor_id": "A", "amount": 600_000 if m == "2025-07" else 100_000, "period": m} for m in months]
    (s,) = trends.overall_spikes(rows(spark, *jump)).collect()
    assert (s.period, s.severity, s.z, s.ratio) == ("2025-07", "high", 999, 6)
    flat = [{**r, "amount": 100_000} for r in jump]
    assert trends.overall_spikes(rows(spark, *flat)).count() == 0
    # Gaps are not filled: the baseline is the six observed months before.
    gap = [{**r, "period": r["period"] if r["period"] != "2025-07" else "2026-12"} for r in jump]
    assert trends.overall_spikes(rows(spark, *gap)).count() == 1
    assert trends.scoped_spikes(rows(spark, *[{**r, "category": ""} for r in jump]), "category").count() == 0


def test_year_over_year_and_periods(spark):
    df = rows(
        spark,
        {"vendor_id": "A", "amount": 1000, "fiscal_year": 2022, "period": "2025-02"},
        {"vendor_id": "A", "amount": 1500, "fiscal_year": 2025, "period": "2025-02"},
        {"vendor_id": "A", "amount": 50, "period": "2025-01"},
    )
    yoy = trends.year_over_year(df).collect()
    assert [r.delta_pct for r in yoy] == [None, 0.5]
    assert [(r.period, r.total) for r in spend.by_period(df).collect()] == [("2025-01", 50), ("2025-02", 2500)]


def test_largest_payments_and_sole_source(spark):
    sole = {"procurement_method": "sole-source"}
    df = rows(
        spark,
        {"vendor_id": "A", "amount": 100, **sole},
        {"vendor_id": "A", "amount": 200, **sole},
        {"vendor_id": "A", "amount": 300, **sole},
        {"vendor_id": "A", "amount": 400, "procurement_method": "competitive-bid"},
        {"vendor_id": "B", "amount": 100, **sole},
        {"vendor_id": "B", "amount": 100, **sole},
    )
    assert [r.id for r in spend.largest_payments(df, 2).collect()] == ["4", "3"]
    (p,) = spend.repeat_sole_source(df).collect()
    assert (p.vendor_id, p.sole_source_count, p.sole_source_total, p.total_amount) == ("A", 3, 600, 1000)
    assert p.share == pytest.approx(0.6)


def test_rollup_drops_null_keys_and_keeps_sums(spark):
    df = rows(
        spark,
        {"vendor_id": "A", "amount": 1, "period": "2025-01", "department": None, "category": "X"},
        {"vendor_id": None, "amount": 2, "period": None, "department": "D", "category": "X"},
    )
    got = {(r.dimension, r.dimension_key, r.period): (r.total, r["count"]) for r in spend.rollup(df).collect()}
    assert got == {
        ("overall", None, "2025-01"): (1, 1),
        ("department", "D", None): (2, 1),
        ("vendor", "A", None): (1, 1),
        ("category", "X", None): (3, 2),
    }


def test_search_pages_do_not_overlap(spark):
    days = [None, dt.date(2025, 1, 1), dt.date(2025, 1, 1), dt.date(2024, 1, 1), None]
    df = rows(spark, *[{"vendor_id": "A", "amount": i, "date": d} for i, d in enumerate(days)])
    pages = [explore.search_page(df, explore.Search(page=p, page_size=2)).collect() for p in (1, 2, 3)]
    ids = [r.id for page in pages for r in page]
    assert ids == ["5", "1", "3", "2", "4"]
    first = pages[0][-1]
    after = explore.search_after(df, explore.Search(page_size=2), F.lit(first.date).cast("date"), first.id)
    assert [r.id for r in after.collect()] == ["3", "2"]
    up = explore.Search(direction="asc", page_size=2)
    assert [r.id for r in explore.search_page(df, up).collect()] == ["4", "3"]
    upper = explore.search_after(df, up, F.lit(dt.date(2025, 1, 1)), "3")
    assert [r.id for r in upper.collect()] == ["2", "5"]


def test_unusable_search_input_is_ignored(spark):
    df = rows(spark, {"vendor_id": "100% Co", "amount": 1}, {"vendor_id": "Other", "amount": 2})
    s = explore.Search(q=" x ", min_amount=float("nan"), start_date="soon", page=-3, page_size=0)
    assert explore.search(df, s).count() == 2 and (s.size, s.offset) == (1, 0)
    assert explore.search(df, explore.Search(q="0% c")).count() == 1


def _watches(spark, *items):
    names = WATCHES.fieldNames()
    data = []
    for i, item in enumerate(items):
        base = {"ordinal": i, **item}
        if "min_amount" in base:
            base["min_amount"] = Decimal(base["min_amount"])
        data.append(tuple(base.get(n) for n in names))
    return spark.createDataFrame(data, WATCHES)


def test_payment_events_with_broadcast_and_with_salts(spark, monkeypatch):
    df = rows(
        spark,
        {"vendor_id": "V", "amount": 10, "category": "X"},
        {"vendor_id": "V", "amount": -5, "category": None},
        {"vendor_id": "W", "amount": 3000, "category": "Y", "department": "D"},
    )
    watches = _watches(
        spark,
        {"watch_id": "any", "kind": "threshold"},
        {"watch_id": "y", "kind": "threshold", "category": "Y", "min_amount": 2500},
        {"watch_id": "d", "kind": "threshold", "category": "X", "department": "D"},
        {"watch_id": "v", "kind": "vendor-paid", "vendor_id": "V", "jurisdiction_id": ""},
        {"watch_id": "v20", "kind": "vendor-paid", "vendor_id": "V", "min_amount": 20},
        {"watch_id": "other", "kind": "vendor-paid", "vendor_id": "V", "jurisdiction_id": "K"},
    )
    expected = {
        "threshold-exceeded:J:any:1",
        "threshold-exceeded:J:any:3",
        "threshold-exceeded:J:y:3",
        "vendor-payment:J:v:1",
        "vendor-payment:J:v:2",
    }
    for limit in (common.BROADCAST_ROWS, 1):
        monkeypatch.setattr(common, "fits_broadcast", lambda d, n=limit: d.limit(n + 1).count() <= n)
        got = [r.dedupe_key for r in events.payment_events(df, watches).collect()]
        assert sorted(got) == sorted(expected)


def test_names_containing_against_brute_force(spark):
    texts = ["Acme Co", "ACME Supply", "City of X", "x", "Supply acme", ""]
    queries = ["acme", "c", "CO", "supply ac", "zzz", ""]
    names = spark.createDataFrame([(t,) for t in texts], "vendor_name string")
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    got = {tuple(r) for r in events.names_containing(names, asked).collect()}
    assert got == {(t, q) for t in texts for q in queries if q and q.lower() in t.lower()}


def test_spike_events_take_the_first_matching_watch(spark):
    spikes = spark.createDataFrame(
        [("J", "Roads", "2025-07", 600.0, 100.0, 0.0, 999.0, 6.0, "high"), ("J", "overall", "2025-07", 1.0, 1.0, 0.0, 3.0, 2.0, "low")],
        "jurisdiction_id string, scope string, period string, value double, baseline_mean double,"
        " baseline_std double, z double, ratio double, severity string",
    )
    watches = _watches(
        spark,
        {"watch_id": "k", "kind": "category-spike", "jurisdiction_id": "K"},
        {"watch_id": "both", "kind": "category-spike", "category": "Roads", "department": "Parks"},
        {"watch_id": "roads", "kind": "category-spike", "department": "Roads"},
        {"watch_id": "all", "kind": "category-spike"},
    )
    got = {r.dedupe_key: r for r in events.spike_events(spikes, watches).collect()}
    roads = got["spending-spike:J:Roads:2025-07"]
    overall = got["spending-spike:J:overall:2025-07"]
    assert (roads.watch_id, roads.category, roads.occurred_at) == ("roads", "Roads", dt.date(2025, 7, 1))
    assert (overall.watch_id, overall.category) == ("all", None)


def _run(**values):
    base = {"jurisdiction_id": "J", "dataset_id": None, "rows_seen": 0, "mapping_errors": 0, "status": "success"}
    return {**base, **values}


def test_anomaly_reasons(spark):
    items = [
        _run(jurisdiction_id="zero"),
        _run(jurisdiction_id="fatal", status="failed", error_code="portal_shape_changed"),
        _run(jurisdiction_id="rejects", rows_seen=10, mapping_errors=2, status="partial"),
        _run(jurisdiction_id="fine", rows_seen=10, mapping_errors=1, status="partial"),
        _run(jurisdiction_id="new"),
    ]
    names = SYNC_RUNS.fieldNames()
    runs = spark.createDataFrame([tuple(i.get(n) for n in names) for i in items], SYNC_RUNS)
    past = [
        _run(jurisdiction_id="zero", rows_seen=n, finished_at=dt.datetime(2024, 1, n)) for n in range(1, 8)
    ] + [_run(jurisdiction_id="zero", rows_seen=99, status="failed", finished_at=dt.datetime(2024, 2, 1))]
    history = spark.createDataFrame([tuple(i.get(n) for n in names) for i in past], SYNC_RUNS)
    prior = health.prior_average(health.recent_rows_seen(history))
    got = {r.jurisdiction_id: r for r in health.anomaly_reasons(runs, prior).collect()}
    assert got["zero"].reasons == ["Zero rows this run, but prior runs averaged ~5"]
    assert got["fatal"].reasons == [health.SHAPE_REASON, "Run failed: unknown error"]
    assert got["rejects"].reasons == ["High mapping-failure rate: 20%"]
    assert not got["fine"].anomalous and not got["new"].anomalous
