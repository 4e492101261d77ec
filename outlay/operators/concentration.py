"""Vendor concentration: shares, top vendors and the Herfindahl-Hirschman index.

Only vendors with a positive net total count. The scope total and the index come from
one aggregate over vendor totals (the sum of squared shares is the sum of squares over
the squared sum), so a scope with every vendor in it never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.operators.common import ranked


def vendor_net_totals(txns: DataFrame, scope: list[str]) -> DataFrame:
    """Positive net total per scope and vendor. Of several names the smallest is shown.

    Payments are summed with the name in the key first: sums alone keep the map side in a
    hash aggregate, and the name is picked among the few rows left.
    """
    kept = txns
    for column in scope:
        kept = kept.where(F.col(column).isNotNull() & (F.col(column) != ""))
    return (
        kept.groupBy(*scope, "vendor_id", "vendor_name")
        .agg(F.sum("amount").alias("total"))
        .groupBy(*scope, "vendor_id")
        .agg(F.sum("total").alias("total"), F.min("vendor_name").alias("vendor_name"))
        .where(F.col("total") > 0)
    )


def concentration(txns: DataFrame, scope: str | None = None) -> DataFrame:
    """One row per scope value (or one row for everything): total, vendors, top, HHI."""
    scoped = txns.withColumn("scope", F.col(scope) if scope else F.lit("overall"))
    totals = vendor_net_totals(scoped, ["scope"])
    value = F.col("total").cast("double")
    top = F.min_by(
        F.struct("vendor_id", "vendor_name", "total"), F.struct(-F.col("total"), "vendor_id")
    )
    return (
        totals.groupBy("scope")
        .agg(
            F.sum("total").alias("total"),
            F.count(F.lit(1)).alias("vendor_count"),
            F.sum(value * value).alias("_squares"),
            top.alias("_top"),
        )
        .select(
            "scope",
            "total",
            "vendor_count",
            F.col("_top.vendor_id").alias("top_vendor_id"),
            F.col("_top.vendor_name").alias("top_vendor_name"),
            F.col("_top.total").alias("top_total"),
            (F.col("_top.total").cast("double") / F.col("total").cast("double")).alias("top_share"),
            (F.col("_squares") / F.pow(F.col("total").cast("double"), 2)).alias("hhi"),
        )
        .orderBy(F.desc("top_share"), F.asc("scope"))
    )


def top_vendors(txns: DataFrame, scope: str | None = None, n: int = 5) -> DataFrame:
    """The ``n`` largest vendors of every scope with their share."""
    scoped = txns.withColumn("scope", F.col(scope) if scope else F.lit("overall"))
    totals = vendor_net_totals(scoped, ["scope"])
    sums = totals.groupBy("scope").agg(F.sum("total").alias("_sum"))
    best = ranked(totals, ["scope"], [F.desc("total"), F.asc("vendor_id")], n)
    return best.join(sums, "scope").select(
        "scope",
        "rank",
        "vendor_id",
        "vendor_name",
        "total",
        (F.col("total").cast("double") / F.col("_sum").cast("double")).alias("share"),
    )


def primary_share(txns: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Per vendor: the jurisdiction that pays it most and its share of all spend there.
    The share is null where that jurisdiction's total is not positive."""
    paid = txns.dropna(subset=["vendor_id"]).groupBy("vendor_id", "jurisdiction_id").agg(
        F.sum("amount").alias("paid")
    )
    best = ranked(paid, ["vendor_id"], [F.desc("paid"), F.asc("jurisdiction_id")], 1)
    totals = (
        aggregates.where(F.col("dimension") == "overall")
        .groupBy("jurisdiction_id")
        .agg(F.sum("total").alias("jurisdiction_total"))
    )
    share = F.col("paid").cast("double") / F.col("jurisdiction_total").cast("double")
    return best.join(totals, "jurisdiction_id", "left").select(
        "vendor_id",
        "jurisdiction_id",
        "paid",
        F.when(F.col("jurisdiction_total") > 0, share).alias("share"),
    )
