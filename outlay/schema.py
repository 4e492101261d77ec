"""Types of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
RAW = T.MapType(T.StringType(), T.StringType())


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

TRANSACTIONS = _struct(
    id=_S,
    jurisdiction_id=_S,
    dataset_id=_S,
    vendor_id=_S,
    source_record_id=_S,
    vendor_name_raw=_S,
    vendor_name_normalized=_S,
    vendor_city=_S,
    vendor_state=_S,
    vendor_zip=_S,
    department_raw=_S,
    department=_S,
    category=_S,
    fund=_S,
    account=_S,
    amount=MONEY,
    currency=_S,
    date=T.DateType(),
    fiscal_year=_I,
    payment_method=_S,
    po_number=_S,
    procurement_method=_S,
    procurement_method_raw=_S,
    description=_S,
    source_url=_S,
    retrieved_at=T.TimestampType(),
    raw=RAW,
)

BUDGETS = _struct(
    jurisdiction_id=_S,
    fiscal_year=_I,
    department=_S,
    category=_S,
    amount_budgeted=MONEY,
    currency=_S,
    source_url=_S,
    retrieved_at=T.TimestampType(),
    raw=RAW,
)

CONTRACTS = _struct(
    jurisdiction_id=_S,
    vendor_name_raw=_S,
    vendor_name_normalized=_S,
    amount=MONEY,
    currency=_S,
    term_start=T.DateType(),
    term_end=T.DateType(),
    contract_type=_S,
    procurement_method=_S,
    procurement_method_raw=_S,
    description=_S,
    source_url=_S,
    retrieved_at=T.TimestampType(),
    raw=RAW,
)

VENDORS = _struct(
    vendor_id=_S,
    canonical_name=_S,
    normalized_name=_S,
    city=_S,
    state=_S,
    zip=_S,
    confidence=_D,
    mention_count=_L,
    variant_count=_L,
    member_count=_L,
    bucket=T.IntegerType(),
)

VENDOR_VARIANTS = _struct(vendor_id=_S, variant=_S, mentions=_L, bucket=T.IntegerType())

SPEND_AGGREGATES = _struct(
    jurisdiction_id=_S,
    dimension=_S,
    dimension_key=_S,
    period=_S,
    total=T.DecimalType(28, 2),
    count=_L,
)

SPEND_EVENTS = _struct(
    type=_S,
    jurisdiction_id=_S,
    vendor_id=_S,
    vendor_name=_S,
    department=_S,
    category=_S,
    period=_S,
    amount=MONEY,
    value=T.DecimalType(28, 2),
    occurred_at=T.DateType(),
    detail=RAW,
    dedupe_key=_S,
    watch_id=_S,
    event_batch=_L,
)

ALERTS = _struct(
    user_id=_S, saved_view_id=_S, dedupe_key=_S, created_at=T.TimestampType(), status=_S, event_batch=_L
)

ALERT_RUNS = _struct(event_batch=_L, finished_at=T.TimestampType(), alerts=_L)

SYNC_RUNS = _struct(
    jurisdiction_id=_S,
    dataset_id=_S,
    platform=_S,
    started_at=T.TimestampType(),
    finished_at=T.TimestampType(),
    rows_seen=_L,
    rows_new=_L,
    rows_updated=_L,
    mapping_errors=_L,
    status=_S,
    anomalous=T.BooleanType(),
    reasons=T.ArrayType(_S),
    error=_S,
    error_code=_S,
)

SPEND_DATASETS = _struct(
    jurisdiction_id=_S,
    dataset_id=_S,
    cadence=_S,
    is_active=T.BooleanType(),
    status=_S,
    last_synced_at=T.TimestampType(),
)

REJECTS = _struct(jurisdiction_id=_S, reason=_S, raw=RAW, dataset_id=_S, batch_id=_L)

WATCHES = _struct(
    watch_id=_S,
    kind=_S,
    jurisdiction_id=_S,
    vendor_id=_S,
    category=_S,
    department=_S,
    min_amount=MONEY,
    ordinal=_L,
)

RESOLUTION_COUNTS = _struct(norm=_S, field=_S, value=_S, n=_L, bucket=T.IntegerType())

RESOLUTION_CLUSTERS = _struct(
    norm=_S,
    mentions=_L,
    city=_S,
    state=_S,
    zip=_S,
    component=_S,
    vendor_id=_S,
    bucket=T.IntegerType(),
)

RESOLUTION_PAIRS = _struct(
    a=_S,
    b=_S,
    token_sort_ratio=T.DoubleType(),
    boost=T.DoubleType(),
    jaro_winkler=T.DoubleType(),
    name_similarity=T.DoubleType(),
    score=T.DoubleType(),
    bucket=T.IntegerType(),
)

RESOLUTION_FOUNDERS = _struct(vendor_id=_S, founder=_S, run=_L, bucket=T.IntegerType())

VENDOR_LINEAGE = _struct(run=_L, old_id=_S, new_id=_S, change=_S)

INDEXED_NAMES = _struct(jurisdiction_id=_S, vendor_name=_S, bucket=_I)

NAME_POSTINGS = _struct(piece=_S, jurisdiction_id=_S, vendor_name=_S, bucket=_I)

TABLES = {
    "transactions": TRANSACTIONS,
    "budgets": BUDGETS,
    "contracts": CONTRACTS,
    "vendors": VENDORS,
    "vendor_variants": VENDOR_VARIANTS,
    "spend_aggregates": SPEND_AGGREGATES,
    "spend_events": SPEND_EVENTS,
    "sync_runs": SYNC_RUNS,
    "spend_datasets": SPEND_DATASETS,
    "rejects": REJECTS,
    "alerts": ALERTS,
    "alert_runs": ALERT_RUNS,
    "resolution_counts": RESOLUTION_COUNTS,
    "resolution_clusters": RESOLUTION_CLUSTERS,
    "resolution_pairs": RESOLUTION_PAIRS,
    "resolution_founders": RESOLUTION_FOUNDERS,
    "vendor_lineage": VENDOR_LINEAGE,
    "indexed_names": INDEXED_NAMES,
    "name_postings": NAME_POSTINGS,
}
