"""Registered queries: shape of the registry, SQL agreement on a sample, and plan checks."""

from __future__ import annotations

import importlib.abc
import importlib.util
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from outlay.plans import q_normalize, registered
from outlay.plans.txn import payments, table

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SAMPLE = [
    "rollup_grouping_sets",
    "concentration_top_vendors",
    "spikes_fund",
    "search_page_by_vendor",
    "vendor_keys",
    "resolve_vendors",
    "watch_events_views",
    "health_latest",
    "store_upsert_moves",
    "mentions",
    "search_index_names",
    "search_index_page",
    "search_index_count",
]
#: Queries that run jobs of their own before they give a plan; the operators inside them have
#: other queries, or are run in the other tests.
EAGER = ("store_", "stream_", "alert", "read_", "resolve_", "search_index_", "recent_matches", "dashboard_summary")
PLANNED = [name for name in registered.queries() if not name.startswith(EAGER)]
PLANNED += ["resolve_pairs", "resolve_pair_scores", "alert_matches"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


def test_every_query_has_sql():
    assert registered.queries().keys() == registered.oracle_sql().keys()
    assert registered.queries().keys() <= entry.queries().keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = duck.execute(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert len(got) == len(expected)
    for a, b in zip(got, sorted(expected, key=repr)):
        assert a == pytest.approx(b) if all(isinstance(v, float) for v in a) else True
        for x, y in zip(a, b):
            assert x == (pytest.approx(y, abs=1e-6) if isinstance(y, float) else y)


@pytest.mark.parametrize("name", PLANNED)
def test_no_loops_over_pairs_and_no_row_udfs(spark, name):
    plan = _plan(entry.queries()[name](spark, SMALL))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert forbidden not in plan
    assert "ArrowEvalPython" not in plan or "jaro_winkler" in plan  # the one Python function


def test_only_needed_tables_and_columns_are_read(spark):
    plan = _plan(payments(spark, SMALL, "vendor_id", "period"))
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_shipdate:timestamp" in plan


def test_top_of_group_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in _plan(entry.queries()["dedupe_last_wins"](spark, SMALL))


def test_rows_have_their_dimensions(spark):
    """The payments view leaves joins out that no column needs, which is right only where every
    line has its order, part and supplier, and so on."""
    count = table(spark, SMALL, "lineitem").count()
    everything = payments(spark, SMALL, "id", "vendor_name", "category", "department", "jurisdiction_id")
    assert everything.count() == count


def test_text_operators_may_be_absent(monkeypatch):
    """The entry module gives the other queries where the text operators are not installed."""

    class Absent(importlib.abc.MetaPathFinder):
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "outlay.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    gone = ("corpus_pipeline", "outlay.llm")
    for name in [m for m in sys.modules if m in gone or m.startswith("outlay.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr("outlay.llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    spec = importlib.util.spec_from_file_location("entry_alone", entry.__file__)
    alone = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(alone)
    assert alone.queries().keys() == registered.queries().keys() == alone.oracle_sql().keys()


def test_rejects_are_told_after_the_amount_is_parsed_once(spark):
    lines = q_normalize.normalized(spark, SMALL).records.select("category", "amount")
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    # Below the scan's shuffle the test would stand with the text of the amount once per use.
    assert plan.count("try_cast") == 1 and plan.count("format_number") <= 3
