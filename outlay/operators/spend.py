"""Spend totals and rollups. Sums combine on the map side, so hot keys cost nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.operators.common import descending


def total() -> Column:
    return F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(18,2)")).alias("total")


def count() -> Column:
    return F.count(F.lit(1)).alias("count")


# Names of the stored rollup dimensions and the column each one groups.
DIMENSIONS = {
    "overall": "period",
    "department": "department",
    "vendor": "vendor_id",
    "category": "category",
}


def group_sum(txns: DataFrame, *keys: str) -> DataFrame:
    """Total and count per key; rows with a null key are left out."""
    kept = txns.dropna(subset=list(keys))
    return kept.groupBy(*keys).agg(total(), count())


def by_period(txns: DataFrame) -> DataFrame:
    """Net spend per month, oldest first."""
    return group_sum(txns, "period").orderBy("period")


def _by_dimension(txns: DataFrame, key: str) -> DataFrame:
    return group_sum(txns, key).orderBy(F.desc("total"), F.asc(key))


def by_vendor(txns: DataFrame) -> DataFrame:
    return _by_dimension(txns, "vendor_id")


def by_department(txns: DataFrame) -> DataFrame:
    return _by_dimension(txns, "department")


def by_category(txns: DataFrame) -> DataFrame:
    return _by_dimension(txns, "category")


def by_fiscal_year(txns: DataFrame) -> DataFrame:
    return group_sum(txns, "fiscal_year").orderBy("fiscal_year")


def rollup(txns: DataFrame) -> DataFrame:
    """Totals per jurisdiction and month, department, vendor and category in one pass.

    One scan feeds four grouping sets; each task ships only its partial sums.
    """
    columns = list(DIMENSIONS.values())
    sets = [[F.col("jurisdiction_id"), F.col(c)] for c in columns]
    grouped = (
        txns.select("jurisdiction_id", *columns, "amount")
        .groupingSets(sets, "jurisdiction_id", *columns)
        .agg(F.grouping_id().alias("gid"), total(), count())
    )
    # grouping_id has one bit per column, set where the column is rolled up; the first
    # column is always present.
    full = (1 << len(columns)) - 1
    dimension, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, column) in enumerate(DIMENSIONS.items()):
        here = F.col("gid") == (full & ~(1 << (len(columns) - 1 - i)))
        dimension = F.when(here, F.lit(name)).otherwise(dimension)
        key = F.when(here, F.col(column)).otherwise(key)
    return (
        grouped.withColumn("dimension", dimension)
        .withColumn("_key", key)
        .where(F.col("_key").isNotNull())
        .select(
            "jurisdiction_id",
            "dimension",
            F.when(F.col("dimension") != "overall", F.col("_key")).alias("dimension_key"),
            "period",
            "total",
            "count",
        )
    )


def dimension_of(aggregates: DataFrame, name: str) -> DataFrame:
    """One dimension of the stored rollup."""
    return aggregates.where(F.col("dimension") == name)


def overall_totals(aggregates: DataFrame) -> DataFrame:
    """Total and count per jurisdiction, read from the monthly rollup."""
    return (
        dimension_of(aggregates, "overall")
        .groupBy("jurisdiction_id")
        .agg(F.sum("total").alias("total"), F.sum("count").alias("count"))
    )


def vendor_totals(txns: DataFrame) -> DataFrame:
    """Total paid and payments per vendor over all jurisdictions."""
    return group_sum(txns, "vendor_id")


def largest_payments(txns: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest payments."""
    return txns.orderBy(descending("amount"), F.asc("id")).limit(n)


def platform_totals(
    aggregates: DataFrame, jurisdictions: DataFrame, vendors: DataFrame
) -> DataFrame:
    """One row: active jurisdictions, spend, payments, vendors, months, latest month."""
    months = dimension_of(aggregates, "overall").agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_spend"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("payments"),
        F.count_distinct("period").alias("months"),
        F.max("period").alias("latest_period"),
    )
    active = jurisdictions.where("is_active").agg(count().alias("jurisdictions"))
    known = vendors.agg(count().alias("vendors"))
    return _side_by_side(months, active, known)


def volume_metrics(txns: DataFrame, jurisdictions: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row: jurisdictions, vendors, transactions and total over the raw tables."""
    payments = txns.agg(count().alias("transactions"), total().alias("total_spend"))
    all_jurisdictions = jurisdictions.agg(count().alias("jurisdictions"))
    return _side_by_side(payments, all_jurisdictions, vendors.agg(count().alias("vendors")))


def _side_by_side(*frames: DataFrame) -> DataFrame:
    """Put one-row results next to each other: a union with gaps, closed by one aggregate."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def composition(totals: DataFrame, scope: list[str], value: str = "total") -> DataFrame:
    """Share of each segment in its scope; a zero total counts as one."""
    sums = totals.groupBy(*scope).agg(F.sum(value).alias("_sum"))
    whole = F.when(F.col("_sum") == 0, F.lit(1.0)).otherwise(F.col("_sum").cast("double"))
    return (
        totals.join(sums, scope)
        .withColumn("share", F.col(value).cast("double") / whole)
        .drop("_sum")
    )


def repeat_sole_source(txns: DataFrame, min_count: int = 3) -> DataFrame:
    """Vendors with at least ``min_count`` sole-source payments, and their share."""
    sole = F.col("procurement_method") == "sole-source"
    part, whole = F.col("sole_source_total"), F.col("total_amount")
    share = F.try_divide(part.cast("double"), whole.cast("double"))
    return (
        txns.groupBy("vendor_id", "vendor_name")
        .agg(
            F.count_if(sole).alias("n"),
            F.sum(F.when(sole, F.col("amount"))).alias("part"),
            F.sum("amount").alias("whole"),
        )
        .groupBy("vendor_id")
        .agg(
            F.min("vendor_name").alias("vendor_name"),
            F.sum("n").alias("sole_source_count"),
            F.coalesce(F.sum("part"), F.lit(0)).alias("sole_source_total"),
            F.sum("whole").alias("total_amount"),
        )
        .where(F.col("sole_source_count") >= min_count)
        .withColumn("share", F.coalesce(share, F.lit(0.0)))
        .orderBy(F.desc("sole_source_total"), F.asc("vendor_id"))
    )


def facet(txns: DataFrame, column: str, n: int = 150) -> DataFrame:
    """The ``n`` values of a column with the most spend."""
    return group_sum(txns, column).orderBy(F.desc("total"), F.asc(column)).limit(n)
