"""Totals, rollups, shares and facets over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.operators import concentration as con
from outlay.operators import spend, trends
from outlay.plans.catalog import CTES, money, query, sql
from outlay.plans.txn import jurisdictions, payments, vendors
from outlay.sources import selection

_TOTALS = f"{money('sum(amount)', 'total')}, count(*) AS count"

# The day taken as today, and the start of the incremental window.
TODAY = "2001-03-15"
SINCE = "1999-07-01"


def _grouped(column: str) -> str:
    body = f"SELECT {column}, {_TOTALS} FROM txn WHERE {column} IS NOT NULL GROUP BY {column}"
    return sql(body, "txn")


@query("spend_by_period", _grouped("period"))
def spend_by_period(spark, sf):
    return spend.by_period(payments(spark, sf, "period", "amount"))


@query("spend_by_vendor", _grouped("vendor_id"))
def spend_by_vendor(spark, sf):
    return spend.by_vendor(payments(spark, sf, "vendor_id", "amount"))


@query("spend_by_department", _grouped("department"))
def spend_by_department(spark, sf):
    return spend.by_department(payments(spark, sf, "department", "amount"))


@query("spend_by_category", _grouped("category"))
def spend_by_category(spark, sf):
    return spend.by_category(payments(spark, sf, "category", "amount"))


@query("spend_by_fiscal_year", _grouped("fiscal_year"))
def spend_by_fiscal_year(spark, sf):
    return spend.by_fiscal_year(payments(spark, sf, "fiscal_year", "amount"))


@query("vendor_total_paid", _grouped("vendor_id"))
def vendor_total_paid(spark, sf):
    return spend.vendor_totals(payments(spark, sf, "vendor_id", "amount"))


@query(
    "spend_by_jurisdiction_month",
    sql(
        f"SELECT jurisdiction_id, period, {_TOTALS} FROM txn GROUP BY jurisdiction_id, period",
        "txn",
    ),
)
def spend_by_jurisdiction_month(spark, sf):
    rows = payments(spark, sf, "jurisdiction_id", "period", "amount")
    return spend.group_sum(rows, "jurisdiction_id", "period")


CTES["agg"] = """
  SELECT jurisdiction_id,
         CASE WHEN grouping(period) = 0 THEN 'overall'
              WHEN grouping(department) = 0 THEN 'department'
              WHEN grouping(vendor_id) = 0 THEN 'vendor' ELSE 'category' END AS dimension,
         coalesce(department, vendor_id, category) AS dimension_key,
         period, sum(amount) AS total, count(*) AS count
  FROM txn
  GROUP BY GROUPING SETS ((jurisdiction_id, period), (jurisdiction_id, department),
                          (jurisdiction_id, vendor_id), (jurisdiction_id, category))"""


def rollup(spark, sf):
    columns = ["jurisdiction_id", "period", "department", "vendor_id", "category", "amount"]
    return spend.rollup(payments(spark, sf, *columns))


@query(
    "rollup_grouping_sets",
    sql(
        f"SELECT jurisdiction_id, dimension, dimension_key, period, {money('total', 'total')},"
        " count FROM agg",
        "txn",
        "agg",
    ),
)
def rollup_grouping_sets(spark, sf):
    return rollup(spark, sf)


def monthly(spark, sf):
    """The monthly part of the rollup, for queries that read nothing else of it."""
    rows = payments(spark, sf, "jurisdiction_id", "period", "amount")
    return spend.group_sum(rows, "jurisdiction_id", "period").select(
        "jurisdiction_id",
        F.lit("overall").alias("dimension"),
        F.lit(None).cast("string").alias("dimension_key"),
        "period",
        "total",
        "count",
    )


@query(
    "jurisdiction_totals",
    sql(f"SELECT jurisdiction_id, {_TOTALS} FROM txn GROUP BY jurisdiction_id", "txn"),
)
def jurisdiction_totals(spark, sf):
    return spend.overall_totals(monthly(spark, sf))


@query(
    "platform_totals",
    sql(
        f"""SELECT (SELECT count(*) FROM nation) AS jurisdictions,
       {money('sum(amount)', 'total_spend')}, count(*) AS payments,
       (SELECT count(*) FROM supplier) AS vendors,
       count(DISTINCT period) AS months, max(period) AS latest_period FROM txn""",
        "txn",
    ),
)
def platform_totals(spark, sf):
    return spend.platform_totals(monthly(spark, sf), jurisdictions(spark, sf), vendors(spark, sf))


@query(
    "volume_metrics",
    sql(
        f"""SELECT (SELECT count(*) FROM nation) AS jurisdictions,
       (SELECT count(*) FROM supplier) AS vendors, count(*) AS transactions,
       {money('sum(amount)', 'total_spend')} FROM txn""",
        "txn",
    ),
)
def volume_metrics(spark, sf):
    rows = payments(spark, sf, "amount")
    return spend.volume_metrics(rows, jurisdictions(spark, sf), vendors(spark, sf))


def _facet(column: str) -> str:
    return sql(
        f"""SELECT {column}, {_TOTALS} FROM txn WHERE {column} IS NOT NULL
GROUP BY {column} ORDER BY sum(amount) DESC, {column} LIMIT 150""",
        "txn",
    )


@query("facets_department", _facet("department"))
def facets_department(spark, sf):
    return spend.facet(payments(spark, sf, "department", "amount"), "department")


@query("facets_category", _facet("category"))
def facets_category(spark, sf):
    return spend.facet(payments(spark, sf, "category", "amount"), "category")


@query(
    "composition_share",
    sql(
        f"""SELECT jurisdiction_id, department, {money('total', 'total')}, count,
       round(CAST(total AS DOUBLE) / CASE WHEN whole = 0 THEN 1 ELSE CAST(whole AS DOUBLE) END, 6)
         AS share
FROM (SELECT *, sum(total) OVER (PARTITION BY jurisdiction_id) AS whole
      FROM (SELECT jurisdiction_id, department, sum(amount) AS total, count(*) AS count
            FROM txn GROUP BY jurisdiction_id, department))""",
        "txn",
    ),
)
def composition_share(spark, sf):
    rows = payments(spark, sf, "jurisdiction_id", "department", "amount")
    totals = spend.group_sum(rows, "jurisdiction_id", "department")
    return spend.composition(totals, ["jurisdiction_id"]).withColumn("share", F.round("share", 6))


def _sole(min_count: int) -> str:
    return sql(
        f"""SELECT vendor_id, min(vendor_name) AS vendor_name,
       count(*) FILTER (procurement_method = 'sole-source') AS sole_source_count,
       {money("coalesce(sum(amount) FILTER (procurement_method = 'sole-source'), 0)",
              'sole_source_total')},
       {money('sum(amount)', 'total_amount')},
       round(coalesce(CAST(sum(amount) FILTER (procurement_method = 'sole-source') AS DOUBLE)
             / nullif(CAST(sum(amount) AS DOUBLE), 0), 0), 6) AS share
FROM txn GROUP BY vendor_id HAVING sole_source_count >= {min_count}""",
        "txn",
    )


def _sole_source(spark, sf, min_count):
    columns = ["vendor_id", "vendor_name", "procurement_method", "amount"]
    found = spend.repeat_sole_source(payments(spark, sf, *columns), min_count)
    return found.withColumn("share", F.round("share", 6))


@query("repeat_sole_source", _sole(3))
def repeat_sole_source(spark, sf):
    return _sole_source(spark, sf, 3)


@query("repeat_sole_source_frequent", _sole(125))
def repeat_sole_source_frequent(spark, sf):
    return _sole_source(spark, sf, 125)


def _concentration(scope: str) -> str:
    return sql(
        f"""SELECT scope, {money('total', 'total')}, vendor_count, top_vendor_id, top_vendor_name,
       {money('top_total', 'top_total')},
       round(CAST(top_total AS DOUBLE) / CAST(total AS DOUBLE), 6) AS top_share,
       round(hhi, 6) AS hhi
FROM (SELECT scope, sum(total) AS total, count(*) AS vendor_count,
             first(vendor_id ORDER BY total DESC, vendor_id) AS top_vendor_id,
             first(vendor_name ORDER BY total DESC, vendor_id) AS top_vendor_name,
             max(total) AS top_total, sum(share * share) AS hhi
      FROM (SELECT *, CAST(total AS DOUBLE)
                      / CAST(sum(total) OVER (PARTITION BY scope) AS DOUBLE) AS share
            FROM (SELECT {scope} AS scope, vendor_id, min(vendor_name) AS vendor_name,
                         sum(amount) AS total
                  FROM txn GROUP BY ALL HAVING sum(amount) > 0))
      GROUP BY scope)""",
        "txn",
    )


def _concentrated(spark, sf, scope):
    columns = ["vendor_id", "vendor_name", "amount"] + ([scope] if scope else [])
    found = con.concentration(payments(spark, sf, *columns), scope)
    return found.withColumn("top_share", F.round("top_share", 6)).withColumn(
        "hhi", F.round("hhi", 6)
    )


@query("concentration_overall", _concentration("'overall'"))
def concentration_overall(spark, sf):
    return _concentrated(spark, sf, None)


@query("concentration_by_department", _concentration("department"))
def concentration_by_department(spark, sf):
    return _concentrated(spark, sf, "department")


@query("concentration_by_jurisdiction", _concentration("jurisdiction_id"))
def concentration_by_jurisdiction(spark, sf):
    return _concentrated(spark, sf, "jurisdiction_id")


@query(
    "concentration_top_vendors",
    sql(
        f"""SELECT scope, rank, vendor_id, vendor_name, {money('total', 'total')},
       round(CAST(total AS DOUBLE) / CAST(whole AS DOUBLE), 6) AS share
FROM (SELECT *, sum(total) OVER (PARTITION BY scope) AS whole,
             row_number() OVER (PARTITION BY scope ORDER BY total DESC, vendor_id) AS rank
      FROM (SELECT department AS scope, vendor_id, min(vendor_name) AS vendor_name,
                   sum(amount) AS total
            FROM txn GROUP BY ALL HAVING sum(amount) > 0))
WHERE rank <= 5""",
        "txn",
    ),
)
def concentration_top_vendors(spark, sf):
    columns = ["vendor_id", "vendor_name", "department", "amount"]
    found = con.top_vendors(payments(spark, sf, *columns), "department")
    return found.withColumn("share", F.round("share", 6))


@query(
    "vendor_primary_share",
    sql(
        f"""SELECT vendor_id, jurisdiction_id, {money('paid', 'paid')},
       round(CASE WHEN whole > 0 THEN CAST(paid AS DOUBLE) / CAST(whole AS DOUBLE) END, 6) AS share
FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY paid DESC, jurisdiction_id) AS n
      FROM (SELECT vendor_id, jurisdiction_id, sum(amount) AS paid FROM txn GROUP BY ALL))
JOIN (SELECT jurisdiction_id, sum(amount) AS whole FROM txn GROUP BY ALL) USING (jurisdiction_id)
WHERE n = 1""",
        "txn",
    ),
)
def vendor_primary_share(spark, sf):
    rows = payments(spark, sf, "vendor_id", "jurisdiction_id", "amount")
    return con.primary_share(rows, monthly(spark, sf)).withColumn("share", F.round("share", 6))


def _spikes(scope: str, mean: float = 1000, z: float = 2.5, ratio: float = 1.5) -> str:
    return sql(
        f"""SELECT scope, period, {money('value', 'value')}, round(mu, 4) AS baseline_mean,
       round(sd, 4) AS baseline_std, round(z, 6) AS z, round(ratio, 6) AS ratio,
       CASE WHEN ratio >= 3 OR z >= 5 THEN 'high' WHEN ratio >= 2 OR z >= 3.5 THEN 'medium'
            ELSE 'low' END AS severity
FROM (SELECT *, value / mu AS ratio,
             CASE WHEN sd > 0 THEN (value - mu) / sd WHEN value > mu THEN 999 ELSE 0 END AS z
      FROM (SELECT scope, period, value,
                   row_number() OVER (PARTITION BY scope ORDER BY period) AS n,
                   avg(value) OVER w AS mu, stddev_pop(value) OVER w AS sd
            FROM (SELECT {scope} AS scope, period, CAST(sum(amount) AS DOUBLE) AS value
                  FROM txn GROUP BY ALL)
            WINDOW w AS (PARTITION BY scope ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
      WHERE n > 6 AND mu >= {mean})
WHERE value > mu AND ratio >= {ratio} AND (sd = 0 OR z >= {z})""",
        "txn",
    )


def _rounded(df):
    for c, digits in (("baseline_mean", 4), ("baseline_std", 4), ("z", 6), ("ratio", 6)):
        df = df.withColumn(c, F.round(c, digits))
    return df


#: Bars low enough for broad scopes, whose series move little in the test data.
SENSITIVE = trends.SpikeRule(z_threshold=1.0, ratio_threshold=1.02)


@query("spikes_overall", _spikes("'overall'"))
def spikes_overall(spark, sf):
    return _rounded(trends.overall_spikes(payments(spark, sf, "period", "amount")))


@query("spikes_overall_sensitive", _spikes("'overall'", z=1.0, ratio=1.02))
def spikes_overall_sensitive(spark, sf):
    return _rounded(trends.overall_spikes(payments(spark, sf, "period", "amount"), SENSITIVE))


def _scoped(spark, sf, scope, rule=trends.SpikeRule()):
    return _rounded(trends.scoped_spikes(payments(spark, sf, scope, "period", "amount"), scope, rule))


@query("spikes_category", _spikes("category"))
def spikes_category(spark, sf):
    return _scoped(spark, sf, "category")


@query("spikes_category_sensitive", _spikes("category", z=1.0, ratio=1.02))
def spikes_category_sensitive(spark, sf):
    return _scoped(spark, sf, "category", SENSITIVE)


@query("spikes_department", _spikes("department"))
def spikes_department(spark, sf):
    return _scoped(spark, sf, "department")


@query("spikes_department_sensitive", _spikes("department", z=1.0, ratio=1.02))
def spikes_department_sensitive(spark, sf):
    return _scoped(spark, sf, "department", SENSITIVE)


@query("spikes_fund", _spikes("fund"))
def spikes_fund(spark, sf):
    return _scoped(spark, sf, "fund")


@query("spikes_jurisdiction", _spikes("jurisdiction_id"))
def spikes_jurisdiction(spark, sf):
    return _scoped(spark, sf, "jurisdiction_id")


_YOY = """SELECT {by}fiscal_year, {total}, count, {prior},
       round((CAST(total AS DOUBLE) - CAST(prior AS DOUBLE)) / nullif(abs(CAST(prior AS DOUBLE)), 0), 6)
         AS delta_pct
FROM (SELECT *, lag(total) OVER ({part}ORDER BY fiscal_year) AS prior
      FROM (SELECT {by}fiscal_year, sum(amount) AS total, count(*) AS count
            FROM txn GROUP BY ALL))"""


def _yoy(by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    columns = {"total": money("total", "total"), "prior": money("prior", "prior")}
    return sql(_YOY.format(by=f"{by}, " if by else "", part=part, **columns), "txn")


@query("yoy_fiscal_year", _yoy())
def yoy_fiscal_year(spark, sf):
    found = trends.year_over_year(payments(spark, sf, "fiscal_year", "amount"))
    return found.withColumn("delta_pct", F.round("delta_pct", 6))


@query("yoy_by_jurisdiction", _yoy("jurisdiction_id"))
def yoy_by_jurisdiction(spark, sf):
    rows = payments(spark, sf, "jurisdiction_id", "fiscal_year", "amount")
    found = trends.year_over_year(rows, ["jurisdiction_id"])
    return found.withColumn("delta_pct", F.round("delta_pct", 6))


@query(
    "mom_headline",
    sql(
        f"""SELECT jurisdiction_id, period, {money('total', 'total')}, {money('prior', 'prior')},
       round((CAST(total AS DOUBLE) - CAST(prior AS DOUBLE)) / nullif(abs(CAST(prior AS DOUBLE)), 0), 6)
         AS delta_pct
FROM (SELECT *, lag(total) OVER w AS prior,
             row_number() OVER (PARTITION BY jurisdiction_id ORDER BY period DESC) AS n
      FROM (SELECT jurisdiction_id, period, sum(amount) AS total FROM txn GROUP BY ALL)
      WINDOW w AS (PARTITION BY jurisdiction_id ORDER BY period))
WHERE n = 1""",
        "txn",
    ),
)
def mom_headline(spark, sf):
    found = trends.month_over_month(monthly(spark, sf))
    return found.withColumn("delta_pct", F.round("delta_pct", 6))


@query(
    "complete_months",
    sql(
        f"""SELECT period, {_TOTALS} FROM txn
WHERE date < date_trunc('month', DATE '{TODAY}') GROUP BY period""",
        "txn",
    ),
)
def complete_months(spark, sf):
    rows = payments(spark, sf, "date", "period", "amount")
    return spend.by_period(selection.complete_months(rows, F.lit(TODAY).cast("date")))


@query(
    "incremental_filter",
    sql(
        f"""SELECT period, {_TOTALS} FROM txn
WHERE amount > 0 AND date >= DATE '{SINCE}' GROUP BY period""",
        "txn",
    ),
)
def incremental_filter(spark, sf):
    import datetime as dt

    rows = payments(spark, sf, "date", "period", "amount")
    recent = selection.incremental(rows, "amount > 0", "date", dt.date.fromisoformat(SINCE))
    return spend.by_period(recent)
