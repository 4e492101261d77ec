"""Ingestion health over runs derived from the event stream.

Five datasets (the last without an id) have one run per day: its events are the rows seen,
its error events the rejected rows. Some runs fail and some see nothing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.operators import health
from outlay.plans.catalog import CTES, query, sql
from outlay.plans.txn import table
from outlay.sources import selection

NOW = "2024-02-05 00:00:00"

CTES["run"] = """
  SELECT 'J' || k AS jurisdiction_id, CASE WHEN k <> 4 THEN 'D' || k END AS dataset_id,
         finished_at, CASE WHEN (day + k) % 6 = 0 THEN 0 ELSE seen END AS rows_seen,
         CASE WHEN (day + k) % 6 = 0 THEN 0 ELSE errors END AS mapping_errors,
         CASE WHEN (day + 2 * k) % 8 = 0 THEN 'HTTP 404' END AS error,
         CASE WHEN (day + 2 * k) % 8 = 0 THEN 'portal_shape_changed' END AS error_code,
         CASE WHEN (day + 2 * k) % 8 = 0 THEN 'failed'
              WHEN (day + k) % 6 <> 0 AND errors > 0 THEN 'partial' ELSE 'success' END AS status,
         day
  FROM (SELECT user_id % 5 AS k, CAST(ts AS DATE) - DATE '1970-01-01' AS day, max(ts) AS finished_at, count(*) AS seen,
               count(*) FILTER (event_type = 'error') AS errors
        FROM events GROUP BY ALL)"""
CTES["recent"] = """
  SELECT *, row_number() OVER (PARTITION BY jurisdiction_id, dataset_id
                               ORDER BY finished_at DESC) AS rank
  FROM run WHERE status <> 'failed'"""
CTES["prior"] = """
  SELECT r.jurisdiction_id, r.day, avg(p.rows_seen) AS prior_avg
  FROM run r, LATERAL (SELECT rows_seen FROM run b
                       WHERE b.jurisdiction_id = r.jurisdiction_id AND b.status <> 'failed'
                         AND b.finished_at < r.finished_at
                       ORDER BY b.finished_at DESC LIMIT 5) p
  GROUP BY ALL"""
CTES["reason"] = """
  SELECT run.*, concat_ws('|',
    CASE WHEN error_code = 'portal_shape_changed'
         THEN 'Portal shape changed — a mapped column or the dataset id likely moved' END,
    CASE WHEN status = 'failed' THEN 'Run failed: ' || error END,
    CASE WHEN rows_seen = 0 AND prior_avg >= 1
         THEN 'Zero rows this run, but prior runs averaged ~' || CAST(floor(prior_avg + 0.5) AS BIGINT) END,
    CASE WHEN mapping_errors > 0 AND mapping_errors >= 0.2e0 * rows_seen
         THEN 'High mapping-failure rate: '
              || CAST(floor(mapping_errors * 100e0 / rows_seen + 0.5) AS BIGINT) || '%' END) AS reasons
  FROM run LEFT JOIN prior USING (jurisdiction_id, day)"""


def runs(spark, sf):
    events = table(spark, sf, "events")
    k, day = F.col("k"), F.col("day")
    daily = events.groupBy((F.col("user_id") % 5).alias("k"), F.unix_date(F.to_date("ts")).cast("long").alias("day")).agg(
        F.max("ts").cast("timestamp").alias("finished_at"),
        F.count(F.lit(1)).alias("seen"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    )
    empty, fatal = (day + k) % 6 == 0, (day + 2 * k) % 8 == 0
    found = daily.select(
        F.concat(F.lit("J"), k).alias("jurisdiction_id"),
        F.when(k != 4, F.concat(F.lit("D"), k)).alias("dataset_id"),
        "finished_at",
        F.when(empty, 0).otherwise(F.col("seen")).alias("rows_seen"),
        F.when(empty, 0).otherwise(F.col("errors")).alias("mapping_errors"),
        F.when(fatal, "HTTP 404").alias("error"),
        F.when(fatal, "portal_shape_changed").alias("error_code"),
        "day",
    )
    return found.withColumn(
        "status", health.status(F.col("mapping_errors"), F.col("error_code").isNotNull())
    )


@query(
    "run_status",
    sql(
        """SELECT jurisdiction_id, dataset_id, day, status, rows_seen, mapping_errors,
       CASE WHEN mapping_errors > rows_seen * 0.5 THEN 'partial' ELSE 'success' END AS bulk_status
FROM run""",
        "run",
    ),
)
def run_status(spark, sf):
    found = runs(spark, sf)
    bulk = health.bulk_status(F.col("rows_seen"), F.col("mapping_errors"))
    columns = ["jurisdiction_id", "dataset_id", "day", "status", "rows_seen", "mapping_errors"]
    return found.select(*columns, bulk.alias("bulk_status"))


@query(
    "recent_rows_seen",
    sql(
        "SELECT jurisdiction_id, dataset_id, rank, rows_seen FROM recent WHERE rank <= 5",
        "run",
        "recent",
    ),
)
def recent_rows_seen(spark, sf):
    past = runs(spark, sf)
    columns = ["jurisdiction_id", "dataset_id", "rank", "rows_seen"]
    return health.recent_rows_seen(past).select(*columns)


def _judged(spark, sf):
    """All runs, each judged against the five good ones before it."""
    return health.judged_runs(health.with_prior_average(runs(spark, sf)))


@query(
    "run_anomalies",
    sql(
        """SELECT jurisdiction_id, dataset_id, day, status, reasons, reasons <> '' AS anomalous
FROM reason""",
        "run",
        "recent",
        "prior",
        "reason",
    ),
)
def run_anomalies(spark, sf):
    columns = ["jurisdiction_id", "dataset_id", "day", "status", "reasons", "anomalous"]
    return _judged(spark, sf).select(*columns)


@query(
    "health_latest",
    sql(
        """SELECT jurisdiction_id, dataset_id, status AS last_status,
       strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS last_run_at, reasons <> '' AS anomalous, reasons,
       rows_seen, mapping_errors
FROM (SELECT *, row_number() OVER (PARTITION BY jurisdiction_id ORDER BY finished_at DESC) AS n
      FROM reason) WHERE n = 1""",
        "run",
        "recent",
        "prior",
        "reason",
    ),
)
def health_latest(spark, sf):
    return health.health_summary(_judged(spark, sf))


@query(
    "registry_refresh",
    sql(
        """SELECT DISTINCT r.jurisdiction_id, r.dataset_id,
       strftime(n.finished_at, '%Y-%m-%d %H:%M:%S') AS last_synced_at,
       CASE WHEN n.status IS NULL THEN 'new' WHEN n.status = 'failed' THEN 'broken' ELSE 'active' END
         AS status
FROM run r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY jurisdiction_id
                        ORDER BY finished_at DESC) AS n FROM run) n
  ON n.n = 1 AND n.jurisdiction_id = r.jurisdiction_id AND n.dataset_id = r.dataset_id""",
        "run",
    ),
)
def registry_refresh(spark, sf):
    every = runs(spark, sf)
    registry = every.select("jurisdiction_id", "dataset_id").distinct()
    registry = registry.withColumn("last_synced_at", F.lit(None).cast("timestamp"))
    registry = registry.withColumn("status", F.lit("new"))
    return health.refresh_registry(registry, every)


@query(
    "due_datasets",
    f"""SELECT user_id AS dataset_id, cadence
FROM (SELECT user_id, CASE WHEN user_id % 11 <> 0 THEN max(ts) END AS last_synced_at,
             CASE user_id % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly'
                              ELSE 'yearly' END AS cadence,
             user_id % 13 <> 0 AS is_active
      FROM events GROUP BY user_id)
WHERE is_active AND (last_synced_at IS NULL
  OR TIMESTAMP '{NOW}' - last_synced_at >= CASE cadence WHEN 'daily' THEN INTERVAL 20 HOURS
       WHEN 'weekly' THEN INTERVAL 6 DAYS WHEN 'monthly' THEN INTERVAL 27 DAYS
       ELSE INTERVAL 0 DAYS END)""",
)
def due_datasets(spark, sf):
    user = F.col("user_id")
    cadence = F.when(user % 4 == 0, "daily").when(user % 4 == 1, "weekly")
    registry = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last")).select(
        user.alias("dataset_id"),
        F.when(user % 11 != 0, F.col("last")).alias("last_synced_at"),
        cadence.when(user % 4 == 2, "monthly").otherwise("yearly").alias("cadence"),
        (user % 13 != 0).alias("is_active"),
    )
    return selection.due_datasets(registry, F.lit(NOW).cast("timestamp")).select(
        "dataset_id", "cadence"
    )
