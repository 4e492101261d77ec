"""Window operators over monthly and yearly series: spikes and change over time.

The windows run on series that were aggregated first. A scope holds one row per month it
was observed in, so a window partition is bounded by the calendar, not by payments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.operators.spend import group_sum


@dataclass(frozen=True)
class SpikeRule:
    """Baseline length and the bars a month must clear to be a spike."""

    baseline_months: int = 6
    min_baseline: float = 1000
    z_threshold: float = 2.5
    ratio_threshold: float = 1.5
    high_ratio: float = 3
    high_z: float = 5
    medium_ratio: float = 2
    medium_z: float = 3.5
    flat_z: float = 999


def spikes(series: DataFrame, by: list[str], rule: SpikeRule = SpikeRule()) -> DataFrame:
    """Months far above the mean of the preceding observed months.

    ``series`` has ``period`` and ``total`` next to the ``by`` columns. Gaps are not
    filled: the baseline is the previous rows, whatever months they are.
    """
    ordered = Window.partitionBy(*by).orderBy("period")
    trailing = ordered.rowsBetween(-rule.baseline_months, -1)
    value, mean, std = F.col("value"), F.col("baseline_mean"), F.col("baseline_std")
    z = F.when(std > 0, (value - mean) / std).when(value > mean, rule.flat_z).otherwise(0.0)
    severity = (
        F.when((F.col("ratio") >= rule.high_ratio) | (F.col("z") >= rule.high_z), "high")
        .when((F.col("ratio") >= rule.medium_ratio) | (F.col("z") >= rule.medium_z), "medium")
        .otherwise("low")
    )
    return (
        series.withColumn("value", F.col("total").cast("double"))
        .withColumn("_n", F.row_number().over(ordered))
        .withColumn("baseline_mean", F.avg("value").over(trailing))
        .withColumn("baseline_std", F.stddev_pop("value").over(trailing))
        .where(F.col("_n") > rule.baseline_months)
        .where(mean >= rule.min_baseline)
        .withColumn("z", z)
        .withColumn("ratio", F.try_divide(value, mean))
        .where(value > mean)
        .where(F.col("ratio") >= rule.ratio_threshold)
        .where((std == 0) | (F.col("z") >= rule.z_threshold))
        .select(*by, "period", "value", "baseline_mean", "baseline_std", "z", "ratio")
        .withColumn("severity", severity)
    )


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)


def overall_spikes(txns: DataFrame, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """Spikes in overall monthly spend."""
    series = group_sum(txns, "period").withColumn("scope", F.lit("overall"))
    return spikes(series, ["scope"], rule).orderBy("period")


def scoped_spikes(txns: DataFrame, scope: str, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """Spikes per value of a column, worst first; blank values have no series."""
    scoped = txns.withColumn("scope", F.nullif(F.col(scope), F.lit("")))
    found = spikes(group_sum(scoped, "scope", "period"), ["scope"], rule)
    return found.orderBy(
        severity_rank(F.col("severity")).desc(), F.desc("ratio"), F.asc("scope"), F.asc("period")
    )


def _change(now: Column, before: Column) -> Column:
    return F.try_divide((now - before).cast("double"), F.abs(before).cast("double"))


def year_over_year(txns: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Fiscal-year totals and the change to the previous year that has any rows."""
    by = by or []
    years = group_sum(txns, *by, "fiscal_year")
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("fiscal_year")
    return (
        years.withColumn("prior", F.lag("total").over(w))
        .withColumn("delta_pct", _change(F.col("total"), F.col("prior")))
        .orderBy(*by, "fiscal_year")
    )


def month_over_month(aggregates: DataFrame) -> DataFrame:
    """Per jurisdiction: the last observed month, the one before, and the change."""
    months = aggregates.where(F.col("dimension") == "overall")
    w = Window.partitionBy("jurisdiction_id").orderBy("period")
    with_prior = months.withColumn("prior", F.lag("total").over(w))
    return (
        with_prior.groupBy("jurisdiction_id")
        .agg(F.max_by(F.struct("period", "total", "prior"), "period").alias("m"))
        .select(
            "jurisdiction_id",
            F.col("m.period").alias("period"),
            F.col("m.total").alias("total"),
            F.col("m.prior").alias("prior"),
            _change(F.col("m.total"), F.col("m.prior")).alias("delta_pct"),
        )
    )
