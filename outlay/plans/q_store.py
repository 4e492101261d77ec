"""Upserts and streaming jobs over the driver tables.

The stream queries read the table files as streams and run until nothing is left, so their
result is that of a batch over the same table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from outlay.operators import events as ev
from outlay.operators import store
from outlay.plans import ingest
from outlay.plans.catalog import money, query, sql
from outlay.plans.q_events import watches
from outlay.plans.q_normalize import CONFIG, SCAN_TASKS, _LINE, extract
from outlay.plans.q_spend import _spikes
from outlay.plans.txn import payments, table
from outlay.session import scratch_path
from outlay.streaming import jobs
from outlay.streaming.runs import Runs

# Days that split the payments into stored rows and a later batch.
STORED_BEFORE, BATCH_FROM = "1999-01-01", "1998-06-01"


def _split(spark, sf, *columns):
    rows = payments(spark, sf, "id", "date", *columns)
    day = F.col("date")
    stored = rows.where(day < F.lit(STORED_BEFORE).cast("date"))
    return stored, rows.where(day >= F.lit(BATCH_FROM).cast("date"))


@query(
    "upsert_counts",
    sql(
        f"""SELECT count(*) FILTER (date >= DATE '{STORED_BEFORE}') AS inserted,
       count(*) FILTER (date < DATE '{STORED_BEFORE}') AS updated
FROM txn WHERE date >= DATE '{BATCH_FROM}'""",
        "txn",
    ),
)
def upsert_counts(spark, sf):
    stored, batch = _split(spark, sf)
    return store.upsert_counts(batch, stored, ["id"])


@query(
    "dedupe_last_wins",
    sql(
        f"""SELECT source_record_id, {money('amount', 'amount')}, strftime(date, '%Y-%m-%d') AS date
FROM (SELECT *, row_number() OVER (PARTITION BY source_record_id ORDER BY date DESC, id DESC) AS n
      FROM txn) WHERE n = 1""",
        "txn",
    ),
)
def dedupe_last_wins(spark, sf):
    rows = payments(spark, sf, "id", "source_record_id", "amount", "date")
    last = store.last_wins(rows, ["source_record_id"], F.struct("date", "id"))
    return last.select("source_record_id", "amount", "date")


_MERGED = sql(
    f"""SELECT jurisdiction_id, count(*) AS count,
       {money(f"sum(amount * CASE WHEN date >= DATE '{BATCH_FROM}' THEN 2 ELSE 1 END)", 'total')}
FROM txn GROUP BY jurisdiction_id""",
    "txn",
)


def _totals(df):
    return df.groupBy("jurisdiction_id").agg(
        F.count(F.lit(1)).alias("count"), F.sum("amount").alias("total")
    )


@query("upsert_merged", _MERGED)
def upsert_merged(spark, sf):
    stored, batch = _split(spark, sf, "jurisdiction_id", "amount")
    doubled = batch.withColumn("amount", (F.col("amount") * 2).cast("decimal(18,2)"))
    return _totals(store.merged(doubled, stored, ["id"]))


@query("store_upsert", _MERGED)
def store_upsert(spark, sf):
    stored, batch = _split(spark, sf, "jurisdiction_id", "amount")
    doubled = batch.withColumn("amount", (F.col("amount") * 2).cast("decimal(18,2)"))
    tables = store.Store(spark, scratch_path(spark, "upsert"))
    tables.save_transactions(stored)
    tables.save_transactions(doubled)
    return _totals(tables.read("transactions"))


@query(
    "store_replace_jurisdiction",
    sql(
        f"""SELECT jurisdiction_id, count(*) AS count, {money('sum(amount)', 'total')} FROM txn
WHERE date >= DATE '{BATCH_FROM}'
   OR jurisdiction_id NOT IN (SELECT jurisdiction_id FROM txn WHERE date >= DATE '{BATCH_FROM}'
                              AND amount > 90000)
GROUP BY jurisdiction_id""",
        "txn",
    ),
)
def store_replace_jurisdiction(spark, sf):
    rows = payments(spark, sf, "id", "date", "jurisdiction_id", "amount")
    late = rows.where(F.col("date") >= F.lit(BATCH_FROM).cast("date"))
    chosen = late.where("amount > 90000").select("jurisdiction_id").distinct()
    tables = store.Store(spark, scratch_path(spark, "replace"))
    tables.save_transactions(rows)
    tables.replace_jurisdiction(late.join(chosen, "jurisdiction_id", "left_semi"), "transactions")
    return _totals(tables.read("transactions"))


@query(
    "store_upsert_moves",
    sql(
        f"""SELECT CASE WHEN jurisdiction_id = 'CHINA' THEN 'FRANCE' ELSE jurisdiction_id END
         AS jurisdiction_id, count(*) AS count, {money('sum(amount)', 'total')} FROM txn GROUP BY 1""",
        "txn",
    ),
)
def store_upsert_moves(spark, sf):
    """All rows of a jurisdiction move to another one, which leaves its partition empty."""
    rows = payments(spark, sf, "id", "jurisdiction_id", "amount")
    tables = store.Store(spark, scratch_path(spark, "moves"))
    tables.save_transactions(rows)
    moved = rows.where("jurisdiction_id = 'CHINA'")
    tables.save_transactions(moved.withColumn("jurisdiction_id", F.lit("FRANCE")))
    return _totals(tables.read("transactions"))


def _last_by_key(key, amount):
    columns = ", ".join(key)
    return sql(
        f"""SELECT {columns}, {money('amount', amount)}
FROM (SELECT *, row_number() OVER (PARTITION BY {columns} ORDER BY date DESC, id DESC) AS n
      FROM (SELECT *, vendor_id AS vendor_name_normalized, make_date(year(date), 1, 1) AS term_start
            FROM txn)) WHERE n = 1""",
        "txn",
    )


_BUDGET = ("jurisdiction_id", "fiscal_year", "department", "category")


@query("store_budgets", _last_by_key(_BUDGET, "amount_budgeted"))
def store_budgets(spark, sf):
    """Many rows per business key, in two batches: the last of each key stays."""
    rows = payments(spark, sf, "id", "date", "amount", *_BUDGET)
    rows = rows.withColumnRenamed("amount", "amount_budgeted")
    tables = store.Store(spark, scratch_path(spark, "budgets"))
    early = F.col("date") < F.lit(STORED_BEFORE).cast("date")
    for part in (rows.where(early), rows.where(~early)):
        tables.save_budgets(part, F.struct("date", "id"))
    return tables.read("budgets").select(*_BUDGET, "amount_budgeted")


_CONTRACT = ("jurisdiction_id", "vendor_name_normalized", "amount", "term_start")


@query(
    "store_contracts",
    sql(
        f"""SELECT jurisdiction_id, count(*) AS count, {money('sum(amount)', 'total')}
FROM (SELECT DISTINCT jurisdiction_id, vendor_id, amount, year(date) FROM txn) GROUP BY jurisdiction_id""",
        "txn",
    ),
)
def store_contracts(spark, sf):
    rows = payments(spark, sf, "jurisdiction_id", "vendor_id", "amount", "date")
    rows = rows.withColumnRenamed("vendor_id", "vendor_name_normalized")
    rows = rows.withColumn("term_start", F.trunc("date", "year"))
    tables = store.Store(spark, scratch_path(spark, "contracts"))
    tables.save_contracts(rows)
    tables.save_contracts(rows.where(F.col("amount") > 0))
    return _totals(tables.read("contracts"))


@query(
    "store_events_absent",
    sql(
        """SELECT jurisdiction_id, period, count(*) AS count FROM txn WHERE amount > 50000
GROUP BY ALL""",
        "txn",
    ),
)
def store_events_absent(spark, sf):
    """The same events twice, and more of them the second time."""
    rows = payments(spark, sf, "id", "jurisdiction_id", "period", "amount")
    events = rows.withColumnRenamed("id", "dedupe_key")
    tables = store.Store(spark, scratch_path(spark, "absent"))
    tables.save_events(events.where("amount > 80000"))
    tables.save_events(events.where("amount > 50000"))
    return tables.read("spend_events").groupBy("jurisdiction_id", "period").agg(
        F.count(F.lit(1)).alias("count")
    )


@query(
    "store_vendors",
    """SELECT s.vendor_id, s.canonical_name, v.variant, v.mentions
FROM (SELECT 'S' || s_suppkey AS vendor_id, s_suppkey,
             CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS canonical_name
      FROM supplier) s
JOIN (SELECT 'S' || s_suppkey AS vendor_id, s_name AS variant, 1 AS mentions FROM supplier
      WHERE s_suppkey % 3 <> 0
      UNION ALL SELECT 'S' || s_suppkey, upper(s_name), 2 FROM supplier WHERE s_suppkey % 3 = 0) v
  USING (vendor_id)""",
)
def store_vendors(spark, sf):
    """All vendors, then new attributes and spellings for every third."""
    supplier = table(spark, sf, "supplier")
    named = lambda df, name, n: (
        df.select(F.concat(F.lit("S"), "s_suppkey").alias("vendor_id"), name.alias("canonical_name")),
        df.select(
            F.concat(F.lit("S"), "s_suppkey").alias("vendor_id"),
            name.alias("variant"),
            F.lit(n).cast("long").alias("mentions"),
        ),
    )
    tables = store.Store(spark, scratch_path(spark, "vendors"))
    tables.save_vendors(*named(supplier, F.col("s_name"), 1))
    tables.save_vendors(*named(supplier.where("s_suppkey % 3 = 0"), F.upper("s_name"), 2))
    vendors = tables.read("vendors").select("vendor_id", "canonical_name")
    return vendors.join(tables.read("vendor_variants").drop("bucket"), "vendor_id")


@query(
    "store_runs",
    """SELECT event_type AS dataset_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day,
       count(*) AS rows_seen FROM events GROUP BY ALL""",
)
def store_runs(spark, sf):
    """A run record per event type and day, appended type by type."""
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    runs = events.groupBy(F.col("event_type").alias("dataset_id"), "day").agg(
        F.count(F.lit(1)).alias("rows_seen")
    )
    runs = runs.withColumn("started_at", F.col("day").cast("timestamp"))
    tables = store.Store(spark, scratch_path(spark, "runs"))
    is_click = F.col("dataset_id") == "click"
    for part in (runs.where(is_click), runs.where(~is_click)):
        tables.save_run(part)
    day = F.date_format("started_at", "yyyy-MM-dd").alias("day")
    return tables.read("sync_runs").select("dataset_id", day, "rows_seen")


SLICES = 4


def stream(spark, sf, name, day):
    """A driver table as a stream of files that hold days out of order. A micro-batch takes the
    files of about one slice: many, so that its tasks share the work, and as many micro-batches
    whatever the size, since each joins the whole dimensions."""
    rows = table(spark, sf, name)
    path = scratch_path(spark, f"landed-{name}")
    tasks = max(SCAN_TASKS, -(-rows.rdd.getNumPartitions() // SLICES))
    slice_of = F.pmod(F.dayofyear(day), F.lit(SLICES)).alias("_slice")
    place = F.pmod(F.xxhash64(*rows.columns), F.lit(tasks))
    sliced = rows.select("*", slice_of).repartition(SLICES * tasks, "_slice", place)
    sliced.write.partitionBy("_slice").parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    reader = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True)
    return reader.option("maxFilesPerTrigger", max(1, -(-files // SLICES))).parquet(path)


def _finish(running):
    running.awaitTermination()
    return running


@query(
    "stream_totals",
    f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, event_type,
       {money('sum(CAST(value AS DECIMAL(18,2)))', 'total')}, count(*) AS count
FROM events GROUP BY ALL""",
)
def stream_totals(spark, sf):
    events = stream(spark, sf, "events", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "totals")
    value = F.col("value").cast("decimal(18,2)")
    arguments = ("ts", "1 day", ["event_type"], value)
    _finish(jobs.stream_totals(events, *arguments, f"{path}/out", f"{path}/state"))
    written = Runs(spark, f"{path}/out").read()
    return jobs.running_totals(written, ["window_start", "window_end", "event_type"])


@query(
    "stream_watch_events",
    sql(
        """SELECT type || ':' || jurisdiction_id || ':' || watch_id || ':' || id AS dedupe_key, watch_id,
       CAST(amount AS DOUBLE) AS amount
FROM (SELECT *, CASE kind WHEN 'vendor-paid' THEN 'vendor-payment' ELSE 'threshold-exceeded' END
             AS type
      FROM txn JOIN watch ON (w_jurisdiction IS NULL OR w_jurisdiction = jurisdiction_id)
       AND ((kind = 'vendor-paid' AND w_vendor = vendor_id AND (w_min IS NULL OR amount >= w_min))
         OR (kind = 'threshold' AND (w_category IS NULL OR w_category = category)
             AND (w_department IS NULL OR w_department = department)
             AND amount >= coalesce(w_min, 0))))""",
        "txn",
        "watch",
    ),
)
def stream_watch_events(spark, sf):
    columns = ["id", "jurisdiction_id", "vendor_id", "vendor_name", "department", "category"]
    lines = stream(spark, sf, "lineitem", "l_shipdate")
    rows = payments(spark, sf, *columns, "period", "amount", "time", lines=lines)
    rows = rows.withColumn("date", F.to_date("time")).drop("time")
    tables = store.Store(spark, scratch_path(spark, "events"))
    state, rules = scratch_path(spark, "events-state"), watches(spark, sf)
    _finish(jobs.stream_watch_events(rows, lambda df: ev.payment_events(df, rules), tables, state))
    return tables.read("spend_events").select("dedupe_key", "watch_id", "amount")


@query(
    "stream_ingest",
    sql(
        f"""SELECT vendor_name_normalized, category, count(*) AS count, {money('sum(amount)', 'total')}
FROM line WHERE amount IS NOT NULL GROUP BY ALL
UNION ALL SELECT '(rejected)', NULL, count(*), NULL FROM line WHERE amount IS NULL""",
        *_LINE,
    ),
)
def stream_ingest(spark, sf):
    lines = stream(spark, sf, "lineitem", "l_shipdate")
    tables = store.Store(spark, scratch_path(spark, "ingest"))
    state = scratch_path(spark, "ingest-state")
    _finish(jobs.stream_ingest(extract(spark, sf, lines), CONFIG, tables, state))
    stored = tables.read("transactions").groupBy("vendor_name_normalized", "category")
    stored = stored.agg(F.count(F.lit(1)).alias("count"), F.sum("amount").alias("total"))
    rejected = tables.read("rejects").agg(F.count(F.lit(1)).alias("count"))
    return stored.unionByName(
        rejected.select(
            F.lit("(rejected)").alias("vendor_name_normalized"),
            F.lit(None).cast("string").alias("category"),
            "count",
            F.lit(None).cast("decimal(28,2)").alias("total"),
        )
    )


@query("stream_spikes", _spikes("fund").replace("SELECT scope, period", "SELECT scope AS fund, period", 1))
def stream_spikes(spark, sf):
    lines = stream(spark, sf, "lineitem", "l_shipdate")
    arriving = payments(spark, sf, "fund", "period", "amount", lines=lines)
    path = scratch_path(spark, "spikes")
    totals, out = f"{path}/totals", f"{path}/out"
    _finish(jobs.stream_spikes(arriving, "fund", totals, out, f"{path}/state"))
    found = jobs.latest_spikes(spark.read.parquet(out), Runs(spark, totals).read(), "fund")
    for c, digits in (("baseline_mean", 4), ("baseline_std", 4), ("z", 6), ("ratio", 6)):
        found = found.withColumn(c, F.round(c, digits))
    return found


@query(
    "bulk_load",
    sql(
        f"""SELECT category, strftime(date, '%Y-%m') AS period,
       CAST(sum(CASE WHEN category = 'Fund O' THEN 2 ELSE 1 END) AS BIGINT) AS count,
       {money("sum(CASE WHEN category = 'Fund O' THEN 2 ELSE 1 END * amount)", 'total')},
       0 AS without_vendor
FROM line WHERE amount IS NOT NULL AND date < DATE '1998-06-01' GROUP BY ALL""",
        *_LINE,
    ),
)
def bulk_load(spark, sf):
    """Two extracts of one jurisdiction, the second repeating lines of the first, loaded over
    older rows; the last month is not complete."""
    lines = table(spark, sf, "lineitem")
    whole = extract(spark, sf, lines)
    repeated = extract(spark, sf, lines.where("l_linestatus = 'O'"))
    tables = store.Store(spark, scratch_path(spark, "bulk"))
    stale = spark.range(10).select(
        F.col("id").cast("string"), F.lit(CONFIG.jurisdiction_id).alias("jurisdiction_id")
    )
    tables.save_transactions(stale)
    ingest.bulk_load(spark, CONFIG, [whole, repeated], tables, dt.datetime(1998, 6, 20))
    rows = tables.read("transactions").withColumn("period", F.date_format("date", "yyyy-MM"))
    return rows.groupBy("category", "period").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("amount").alias("total"),
        F.count_if(F.col("vendor_id").isNull() & (F.col("vendor_name_normalized") != "")).cast("int").alias("without_vendor"),
    )
