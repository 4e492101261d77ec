"""Overview, vendor profile, search and listing queries over the driver tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from outlay.operators import explore as ex
from outlay.operators import spend
from outlay.operators.store import Store
from outlay.plans.catalog import CTES, money, query, sql
from outlay.plans.q_spend import monthly
from outlay.plans.txn import jurisdictions, payments, vendors
from outlay.session import scratch_path

_TOTALS = f"{money('sum(amount)', 'total')}, count(*) AS count"
_ROW = (
    "id, jurisdiction_id, vendor_id, vendor_name, department, category, "
    f"{money('amount', 'amount')}, strftime(date, '%Y-%m-%d') AS date"
)
_ALL = ["id", "jurisdiction_id", "vendor_id", "vendor_name", "department", "category", "amount", "date"]


@query(
    "jurisdictions_with_totals",
    sql(
        f"""SELECT n_name AS jurisdiction_id, n_name AS name, r_name AS state, true AS is_active,
       CAST(coalesce(total, 0) AS DOUBLE) AS total
FROM nation JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT jurisdiction_id, sum(amount) AS total FROM txn GROUP BY ALL)
  ON jurisdiction_id = n_name""",
        "txn",
    ),
)
def jurisdictions_with_totals(spark, sf):
    return ex.jurisdictions_with_totals(jurisdictions(spark, sf), monthly(spark, sf))


def _dimension(spark, sf, dimension, column):
    rows = payments(spark, sf, "jurisdiction_id", column, "amount")
    return spend.group_sum(rows, "jurisdiction_id", column).select(
        "jurisdiction_id",
        F.lit(dimension).alias("dimension"),
        F.col(column).alias("dimension_key"),
        F.lit(None).cast("string").alias("period"),
        "total",
        "count",
    )


def _top(column: str, label: str, join: str, n: int = 8) -> str:
    return f"""SELECT jurisdiction_id, rank, {column} AS dimension_key, {label} AS label,
       {money('total', 'total')}, count
FROM (SELECT *, row_number() OVER (PARTITION BY jurisdiction_id ORDER BY total DESC, {column}) AS rank
      FROM (SELECT jurisdiction_id, {column}, sum(amount) AS total, count(*) AS count
            FROM txn GROUP BY ALL)) {join}
WHERE rank <= {n}"""


@query("top_departments", sql(_top("department", "department", "", 3), "txn"))
def top_departments(spark, sf):
    return ex.top_of_dimension(_dimension(spark, sf, "department", "department"), "department", 3)


@query(
    "top_payees",
    sql(
        _top("vendor_id", "s_name", "LEFT JOIN supplier ON 'S' || s_suppkey = vendor_id"), "txn"
    ),
)
def top_payees(spark, sf):
    totals = _dimension(spark, sf, "vendor", "vendor_id")
    return ex.top_of_dimension(totals, "vendor", 8, vendors(spark, sf))


# Payments with categories and funds as portals write them, some of them no purchases.
CTES["flow"] = """
  SELECT * REPLACE (
    CASE category WHEN 'PROMO' THEN 'General Debt Service'
                  WHEN 'MEDIUM' THEN 'Interest Expense - Bonds'
                  WHEN 'LARGE' THEN 'Principal (DS) ' ELSE category END AS category,
    CASE WHEN fund LIKE '%7' THEN 'Employee Retirement Fund'
         WHEN fund LIKE '%9' THEN 'PAYROLL CLEARING' ELSE fund END AS fund)
  FROM txn"""


def flows(df):
    """Payments with some categories and funds renamed to pass-through flows."""
    c, f = F.col("category"), F.col("fund")
    return df.withColumn(
        "category",
        F.when(c == "PROMO", "General Debt Service")
        .when(c == "MEDIUM", "Interest Expense - Bonds")
        .when(c == "LARGE", "Principal (DS) ")
        .otherwise(c),
    ).withColumn(
        "fund",
        F.when(f.endswith("7"), "Employee Retirement Fund")
        .when(f.endswith("9"), "PAYROLL CLEARING")
        .otherwise(f),
    )


_NON_OPERATIONAL = (
    f"(regexp_matches(coalesce(category, ''), '{ex.NON_OPERATIONAL_CATEGORY}', 'i') "
    f"OR regexp_matches(coalesce(fund, ''), '{ex.NON_OPERATIONAL_FUND}', 'i'))"
)


@query(
    "non_operational_flows",
    sql(
        f"SELECT category, fund, {_NON_OPERATIONAL} AS non_operational, {_TOTALS}"
        " FROM flow GROUP BY ALL",
        "txn",
        "flow",
    ),
)
def non_operational_flows(spark, sf):
    rows = flows(payments(spark, sf, "category", "fund", "amount"))
    totals = spend.group_sum(rows, "category", "fund")
    return totals.withColumn("non_operational", ex.non_operational(F.col("category"), F.col("fund")))


@query(
    "operational_vendors",
    sql(
        f"""SELECT jurisdiction_id, rank, vendor_id, s_name AS label, {money('total', 'total')}, count
FROM (SELECT *, row_number() OVER (PARTITION BY jurisdiction_id ORDER BY total DESC, vendor_id) AS rank
      FROM (SELECT jurisdiction_id, vendor_id, sum(amount) AS total, count(*) AS count
            FROM flow WHERE NOT {_NON_OPERATIONAL} GROUP BY ALL))
LEFT JOIN supplier ON 'S' || s_suppkey = vendor_id
WHERE rank <= 8""",
        "txn",
        "flow",
    ),
)
def operational_vendors(spark, sf):
    rows = payments(spark, sf, "jurisdiction_id", "vendor_id", "category", "fund", "amount")
    return ex.operational_vendors(flows(rows), vendors(spark, sf))


@query(
    "largest_payments",
    sql(f"SELECT {_ROW} FROM txn ORDER BY txn.amount DESC, id LIMIT 10", "txn"),
)
def largest_payments(spark, sf):
    return spend.largest_payments(payments(spark, sf, *_ALL))


@query(
    "largest_payments_by_jurisdiction",
    sql(
        f"""SELECT {_ROW}, rank
FROM (SELECT *, row_number() OVER (PARTITION BY jurisdiction_id ORDER BY amount DESC, id) AS rank
      FROM txn) WHERE rank <= 10""",
        "txn",
    ),
)
def largest_payments_by_jurisdiction(spark, sf):
    return ex.largest_per_jurisdiction(payments(spark, sf, *_ALL))


# Budgets: nine tenths of what each department spent; one department gets no actual spend.
CTES["budget"] = """
  SELECT jurisdiction_id, fiscal_year, department || CASE WHEN fiscal_year = 1996 THEN ' OLD' ELSE '' END
           AS department,
         CAST(sum(amount) * CAST(0.9 AS DECIMAL(2,1)) AS DECIMAL(18,2)) AS amount_budgeted
  FROM txn GROUP BY jurisdiction_id, fiscal_year, department"""


def budgets(spark, sf):
    rows = payments(spark, sf, "jurisdiction_id", "fiscal_year", "department", "amount")
    totals = spend.group_sum(rows, "jurisdiction_id", "fiscal_year", "department")
    suffix = F.when(F.col("fiscal_year") == 1996, " OLD").otherwise("")
    share = F.col("total") * F.lit("0.9").cast("decimal(2,1)")
    return totals.select(
        "jurisdiction_id",
        F.col("fiscal_year").cast("bigint").alias("fiscal_year"),
        F.concat("department", suffix).alias("department"),
        share.cast("decimal(18,2)").alias("amount_budgeted"),
    )


def _budget(where: str) -> str:
    return sql(
        f"""SELECT jurisdiction_id, department, fiscal_year,
       {money('amount_budgeted', 'amount_budgeted')}, CAST(coalesce(actual, 0) AS DOUBLE) AS actual
FROM budget LEFT JOIN (SELECT jurisdiction_id, department, sum(amount) AS actual
                       FROM txn {where} GROUP BY ALL) USING (jurisdiction_id, department)
{where}""",
        "txn",
        "budget",
    )


def _actual(spark, sf):
    return payments(spark, sf, "jurisdiction_id", "department", "fiscal_year", "amount")


@query("budget_vs_actual", _budget(""))
def budget_vs_actual(spark, sf):
    return ex.budget_vs_actual(budgets(spark, sf), _actual(spark, sf))


@query("budget_vs_actual_year", _budget("WHERE fiscal_year = 1999"))
def budget_vs_actual_year(spark, sf):
    return ex.budget_vs_actual(budgets(spark, sf), _actual(spark, sf), 1999)


@query(
    "budget_lines",
    sql(
        "SELECT jurisdiction_id, fiscal_year, department,"
        f" {money('amount_budgeted', 'amount_budgeted')} FROM budget",
        "txn",
        "budget",
    ),
)
def budget_lines(spark, sf):
    return ex.budget_lines(budgets(spark, sf))


@query(
    "vendor_profile_jurisdiction",
    sql(
        f"SELECT vendor_id, jurisdiction_id, {_TOTALS}, jurisdiction_id AS name"
        " FROM txn GROUP BY vendor_id, jurisdiction_id",
        "txn",
    ),
)
def vendor_profile_jurisdiction(spark, sf):
    rows = payments(spark, sf, "vendor_id", "jurisdiction_id", "amount")
    return ex.vendor_by_jurisdiction(rows, jurisdictions(spark, sf))


@query(
    "vendor_profile_month",
    sql(f"SELECT vendor_id, period, {_TOTALS} FROM txn GROUP BY vendor_id, period", "txn"),
)
def vendor_profile_month(spark, sf):
    return ex.vendor_by_month(payments(spark, sf, "vendor_id", "date", "amount"))


def _vendor_by(column: str, n: int) -> str:
    return sql(
        f"""SELECT vendor_id, {column}, {money('total', 'total')}, count, rank
FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY total DESC, {column}) AS rank
      FROM (SELECT vendor_id, {column}, sum(amount) AS total, count(*) AS count
            FROM txn GROUP BY ALL)) WHERE rank <= {n}""",
        "txn",
    )


@query("vendor_profile_department", _vendor_by("department", 3))
def vendor_profile_department(spark, sf):
    return ex.vendor_by(payments(spark, sf, "vendor_id", "department", "amount"), "department", 3)


@query("vendor_profile_category", _vendor_by("category", 8))
def vendor_profile_category(spark, sf):
    return ex.vendor_by(payments(spark, sf, "vendor_id", "category", "amount"), "category")


@query(
    "vendor_profile_recent",
    sql(
        f"""SELECT {_ROW}, rank, jurisdiction_id AS jurisdiction_name
FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY date DESC NULLS FIRST, id DESC) AS rank
      FROM txn) WHERE rank <= 25""",
        "txn",
    ),
)
def vendor_profile_recent(spark, sf):
    return ex.vendor_recent(payments(spark, sf, *_ALL), jurisdictions(spark, sf))


def _page(where: str, order: str, offset: int = 0, limit: int = 25) -> str:
    return sql(
        f"""SELECT {_ROW} FROM (SELECT * FROM txn {where}
ORDER BY {order}, id DESC LIMIT {limit} OFFSET {offset}) AS t""",
        "txn",
    )


#: A search with every kind of filter.
FILTERED = ex.Search(
    q=" plier#00000000 ",
    department="BUILDING",
    category="PROMO",
    min_amount=-20000,
    max_amount=60000.5,
    start_date="1996-01-01",
    end_date="2000-12-31",
    sort="amount",
    direction="asc",
    page_size=500,
)
_WHERE = """WHERE contains(lower(vendor_name), 'plier#00000000') AND department = 'BUILDING'
  AND category = 'PROMO' AND amount BETWEEN -20000 AND 60000.5
  AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"""


@query("search_page", _page("", "date DESC NULLS FIRST"))
def search_page(spark, sf):
    return ex.search_page(payments(spark, sf, *_ALL), ex.Search())


@query("search_page_by_amount", _page(_WHERE, "amount NULLS LAST", 0, 100))
def search_page_by_amount(spark, sf):
    return ex.search_page(payments(spark, sf, *_ALL), FILTERED)


@query("search_page_by_vendor", _page("", "vendor_name DESC NULLS FIRST", 80, 40))
def search_page_by_vendor(spark, sf):
    return ex.search_page(payments(spark, sf, *_ALL), ex.Search(sort="vendor", page=3, page_size=40))


@query(
    "search_page_after",
    _page(
        "WHERE date < DATE '1999-06-01' OR (date = DATE '1999-06-01' AND id < '5')",
        "date DESC NULLS FIRST",
    ),
)
def search_page_after(spark, sf):
    last = F.lit(dt.date(1999, 6, 1))
    return ex.search_after(payments(spark, sf, *_ALL), ex.Search(), last, "5")


@query("search_count", sql(f"SELECT count(*) AS total FROM txn {_WHERE}", "txn"))
def search_count(spark, sf):
    rows = payments(spark, sf, "vendor_name", "department", "category", "amount", "date")
    return ex.search_count(rows, FILTERED)


#: A text that many names contain, and one found in few.
WIDE, NARROW = "R#00000000", "lier#000000007"


def _index(spark, sf) -> Store:
    """A name index of the payments, fed in two steps that share names."""
    store = Store(spark, scratch_path(spark, "names"))
    rows = payments(spark, sf, "jurisdiction_id", "vendor_name", "date")
    for part in ("date < '1995-06-01'", "date >= '1995-01-01' or date is null"):
        store.index_names(rows.where(part))
    return store


@query(
    "search_index_names",
    sql(
        f"""SELECT DISTINCT jurisdiction_id, vendor_name FROM txn
WHERE contains(lower(vendor_name), lower('{WIDE}'))""",
        "txn",
    ),
)
def search_index_names(spark, sf):
    return _index(spark, sf).names_like(WIDE)


@query(
    "search_index_page",
    _page(f"WHERE contains(lower(vendor_name), '{NARROW}')", "date DESC NULLS FIRST"),
)
def search_index_page(spark, sf):
    s = ex.Search(q=NARROW)
    return ex.search_page(_index(spark, sf).searched(s, payments(spark, sf, *_ALL)), s)


@query("search_index_count", sql(f"SELECT count(*) AS total FROM txn {_WHERE}", "txn"))
def search_index_count(spark, sf):
    rows = payments(spark, sf, "jurisdiction_id", "vendor_name", "department", "category", "amount", "date")
    return ex.search_count(_index(spark, sf).searched(FILTERED, rows), FILTERED)


CTES["mentioned"] = """
  SELECT vendor_id, count(*) AS mention_count, min(amount) AS least FROM txn GROUP BY vendor_id"""


def _mentioned(spark, sf):
    rows = payments(spark, sf, "vendor_id").groupBy("vendor_id")
    return rows.agg(F.count(F.lit(1)).alias("mention_count"))


@query(
    "vendor_listing",
    sql("SELECT vendor_id FROM mentioned ORDER BY vendor_id LIMIT 50 OFFSET 20", "txn", "mentioned"),
)
def vendor_listing(spark, sf):
    return ex.vendor_listing(_mentioned(spark, sf), 20, 50)


@query("vendor_count", sql("SELECT count(*) AS count FROM mentioned", "txn", "mentioned"))
def vendor_count(spark, sf):
    return ex.vendor_count(_mentioned(spark, sf))


@query(
    "vendors_most_mentioned",
    sql(
        "SELECT vendor_id, mention_count FROM mentioned"
        " ORDER BY mention_count DESC, vendor_id LIMIT 10",
        "txn",
        "mentioned",
    ),
)
def vendors_most_mentioned(spark, sf):
    return ex.most_mentioned(_mentioned(spark, sf), 10)
