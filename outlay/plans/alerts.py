"""The alert job: deliveries for the events that have come in since its last run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.operators import events as ev
from outlay.operators.store import Store
from outlay.schema import ALERT_RUNS


def run_alerts(
    store: Store, subscriptions: DataFrame, views: DataFrame, now: dt.datetime
) -> int:
    """Match unprocessed event batches, store each delivery once, mark the batches; returns
    how many deliveries were new.

    Only the partitions of these batches are read. A run that dies before it marks them is
    repeated by the next one, which finds its deliveries stored.
    """
    batches = store.batches_without_alerts()
    if not batches:
        return 0
    pending = store.read("spend_events").where(F.col("event_batch").isin(batches))
    # Keys are stored once.
    found = ev.alert_matches(pending, subscriptions, views, unique=True, also=("event_batch",))
    deliveries = found.select(
        "user_id",
        "saved_view_id",
        "dedupe_key",
        F.lit(now).alias("created_at"),
        F.lit("pending").alias("status"),
        "event_batch",
    )
    key = ["user_id", "saved_view_id", "dedupe_key"]
    new = store.insert_absent(deliveries, "alerts", key, ["event_batch"], ("event_batch",))
    done = [(b, now, new) for b in batches]
    store.append(store.spark.createDataFrame(done, ALERT_RUNS), "alert_runs")
    return new
