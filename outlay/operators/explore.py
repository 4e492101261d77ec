"""The read queries: overview, vendor profile, search, listings."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.coerce import period
from outlay.operators.common import ascending, descending, ranked
from outlay.operators.spend import count, dimension_of, group_sum, overall_totals, total

# Flows that are no purchases (debt, pensions, payroll clearing).
NON_OPERATIONAL_CATEGORY = (
    r"\(ds\)\s*$|warrants payable|pension|retirement (plan|system)|debt service"
    r"|principal retirement|interest expense"
)
NON_OPERATIONAL_FUND = r"debt|bond|payroll clearing|retirement"
# Search limits.
QUERY_LENGTH = 120
QUERY_MIN_LENGTH = 2
PAGE_SIZE = 25
MAX_PAGE_SIZE = 100
DATE_SHAPE = re.compile(r"^\d{4}-\d{2}-\d{2}$")
UNKNOWN_VENDOR = "Unknown vendor"

ROW = ("id", "jurisdiction_id", "vendor_id", "vendor_name", "department", "category", "amount")


def non_operational(category: Column, fund: Column) -> Column:
    """Debt service, pension, payroll and similar flows; untagged rows are operational."""
    tagged = F.coalesce(category, F.lit("")).rlike(f"(?i){NON_OPERATIONAL_CATEGORY}")
    return tagged | F.coalesce(fund, F.lit("")).rlike(f"(?i){NON_OPERATIONAL_FUND}")


def operational(txns: DataFrame) -> DataFrame:
    """Payments to a known vendor that are not pass-through flows."""
    kept = txns.where(F.col("vendor_id").isNotNull())
    return kept.where(~non_operational(F.col("category"), F.col("fund")))


def active(entities: DataFrame) -> DataFrame:
    return entities.where("is_active")


def jurisdictions_with_totals(jurisdictions: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Active jurisdictions by name with their total; none recorded is zero."""
    totals = overall_totals(aggregates).select("jurisdiction_id", "total")
    return (
        active(jurisdictions)
        .join(totals, "jurisdiction_id", "left")
        .withColumn("total", F.coalesce("total", F.lit(0)))
        .orderBy("name")
    )


def top_of_dimension(
    aggregates: DataFrame, dimension: str, n: int = 8, vendors: DataFrame | None = None
) -> DataFrame:
    """The ``n`` largest entries of a rollup dimension in every jurisdiction.

    With ``vendors`` the label is the vendor's name, else the key itself.
    """
    rows = dimension_of(aggregates, dimension)
    best = ranked(rows, ["jurisdiction_id"], [F.desc("total"), F.asc("dimension_key")], n)
    label: Column = F.col("dimension_key")
    if vendors is not None:
        names = vendors.select(F.col("vendor_id").alias("dimension_key"), "canonical_name")
        best = best.join(names, "dimension_key", "left")
        label = F.coalesce("canonical_name", "dimension_key")
    return best.select(
        "jurisdiction_id", "rank", "dimension_key", label.alias("label"), "total", "count"
    )


def operational_vendors(txns: DataFrame, vendors: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` best paid vendors of every jurisdiction, pass-through flows excluded."""
    totals = group_sum(operational(txns), "jurisdiction_id", "vendor_id")
    best = ranked(totals, ["jurisdiction_id"], [F.desc("total"), F.asc("vendor_id")], n)
    return best.join(vendors.select("vendor_id", "canonical_name"), "vendor_id", "left").select(
        "jurisdiction_id",
        "rank",
        "vendor_id",
        F.coalesce("canonical_name", "vendor_id").alias("label"),
        "total",
        "count",
    )


def largest_per_jurisdiction(txns: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest payments of every jurisdiction."""
    order = [descending("amount"), F.asc("id")]
    return ranked(txns.select(*ROW, "date"), ["jurisdiction_id"], order, n)


def budget_lines(budgets: DataFrame) -> DataFrame:
    """Budget lines with a department, largest first."""
    kept = budgets.where(F.col("department").isNotNull() & (F.col("department") != ""))
    return kept.orderBy(descending("amount_budgeted"), F.asc("department"))


def budget_vs_actual(
    budgets: DataFrame, txns: DataFrame, fiscal_year: int | None = None
) -> DataFrame:
    """Every budget line with the spend of its department; none recorded is zero."""
    lines = budgets.where(F.col("department").isNotNull() & (F.col("department") != ""))
    spent = txns
    if fiscal_year is not None:
        lines = lines.where(F.col("fiscal_year") == fiscal_year)
        spent = spent.where(F.col("fiscal_year") == fiscal_year)
    actual = group_sum(spent, "jurisdiction_id", "department").select(
        "jurisdiction_id", "department", F.col("total").alias("actual")
    )
    return lines.join(actual, ["jurisdiction_id", "department"], "left").withColumn(
        "actual", F.coalesce("actual", F.lit(0))
    )


def vendor_by_jurisdiction(txns: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """Per vendor and jurisdiction: total and count, with the jurisdiction's name."""
    totals = txns.where(F.col("vendor_id").isNotNull()).groupBy("vendor_id", "jurisdiction_id")
    names = jurisdictions.select("jurisdiction_id", "name")
    return (
        totals.agg(total(), count())
        .join(names, "jurisdiction_id", "left")
        .withColumn("name", F.coalesce("name", "jurisdiction_id"))
    )


def vendor_by_month(txns: DataFrame) -> DataFrame:
    """Per vendor and month: total and count of dated payments."""
    dated = txns.where(F.col("date").isNotNull()).withColumn("period", period(F.col("date")))
    return group_sum(dated, "vendor_id", "period")


def vendor_by(txns: DataFrame, column: str, n: int = 8) -> DataFrame:
    """Per vendor: its ``n`` largest departments or categories."""
    totals = group_sum(txns, "vendor_id", column)
    return ranked(totals, ["vendor_id"], [F.desc("total"), F.asc(column)], n)


def vendor_recent(txns: DataFrame, jurisdictions: DataFrame, n: int = 25) -> DataFrame:
    """Per vendor: its ``n`` latest payments; undated ones come first."""
    kept = txns.where(F.col("vendor_id").isNotNull()).select(*ROW, "date")
    best = ranked(kept, ["vendor_id"], [descending("date"), F.desc("id")], n)
    names = jurisdictions.select("jurisdiction_id", F.col("name").alias("jurisdiction_name"))
    return best.join(names, "jurisdiction_id", "left").withColumn(
        "jurisdiction_name", F.coalesce("jurisdiction_name", "jurisdiction_id")
    )


def of_vendor(txns: DataFrame, vendor_id: str) -> DataFrame:
    """One vendor's payments; every profile function above then gives its profile."""
    return txns.where(F.col("vendor_id") == vendor_id)


@dataclass(frozen=True)
class Search:
    """Search input. Unusable values are ignored, as a web form would send them."""

    q: str | None = None
    jurisdiction_id: str | None = None
    department: str | None = None
    category: str | None = None
    min_amount: float | None = None
    max_amount: float | None = None
    start_date: str | None = None
    end_date: str | None = None
    sort: str = "date"
    direction: str = "desc"
    page: int = 1
    page_size: int = PAGE_SIZE

    @property
    def size(self) -> int:
        return min(MAX_PAGE_SIZE, max(1, self.page_size))

    @property
    def offset(self) -> int:
        return (max(1, self.page) - 1) * self.size


def _finite(x: float | None) -> bool:
    return x is not None and x == x and abs(x) != float("inf")


def _date(text: str | None) -> Column | None:
    if not text or not DATE_SHAPE.match(text):
        return None
    return F.try_to_date(F.lit(text), "yyyy-MM-dd")


def searched_text(s: Search) -> str | None:
    """The text that vendor names must contain, if a search has one that is long enough."""
    q = (s.q or "").strip()[:QUERY_LENGTH]
    return q if len(q) >= QUERY_MIN_LENGTH else None


def search(txns: DataFrame, s: Search) -> DataFrame:
    """All payments a search matches. Equality and range filters reach the scan; for a text
    in the name ``Store.searched`` gives the payments to look among."""
    df = txns
    q = searched_text(s)
    if q is not None:
        df = df.where(F.contains(F.lower("vendor_name"), F.lower(F.lit(q))))
    for column in ("jurisdiction_id", "department", "category"):
        wanted = getattr(s, column)
        if wanted:
            df = df.where(F.col(column) == wanted)
    if _finite(s.min_amount):
        df = df.where(F.col("amount") >= F.lit(str(s.min_amount)).cast("decimal(18,2)"))
    if _finite(s.max_amount):
        df = df.where(F.col("amount") <= F.lit(str(s.max_amount)).cast("decimal(18,2)"))
    start, end = _date(s.start_date), _date(s.end_date)
    if start is not None:
        df = df.where(F.col("date") >= start)
    if end is not None:
        df = df.where(F.col("date") <= end)
    return df


def _sort_column(s: Search) -> str:
    return {"amount": "amount", "vendor": "vendor_name"}.get(s.sort, "date")


def search_page(txns: DataFrame, s: Search) -> DataFrame:
    """One page of a search, with the id as tie-break so that pages never overlap."""
    order = ascending if s.direction == "asc" else descending
    return (
        search(txns, s)
        .select(*ROW, "date")
        .orderBy(order(_sort_column(s)), F.desc("id"))
        .offset(s.offset)
        .limit(s.size)
        .withColumn(
            "vendor_name",
            F.coalesce(F.nullif(F.col("vendor_name"), F.lit("")), F.lit(UNKNOWN_VENDOR)),
        )
    )


def search_after(txns: DataFrame, s: Search, last_value: Column, last_id: str) -> DataFrame:
    """The page after a given row. Deep pages cost the same as the first one, because the
    rows before are filtered out instead of being sorted and skipped."""
    column = F.col(_sort_column(s))
    tie = column.eqNullSafe(last_value) & (F.col("id") < last_id)
    if s.direction == "asc":  # nulls come last
        beyond = (column > last_value) | (column.isNull() & last_value.isNotNull())
        order = ascending(column)
    else:  # nulls come first
        beyond = (column < last_value) | (last_value.isNull() & column.isNotNull())
        order = descending(column)
    rest = search(txns, s).where(beyond | tie)
    return rest.select(*ROW, "date").orderBy(order, F.desc("id")).limit(s.size)


def search_count(txns: DataFrame, s: Search) -> DataFrame:
    """Number of payments a search matches."""
    return search(txns, s).agg(F.count(F.lit(1)).alias("total"))


def vendor_listing(vendors: DataFrame, offset: int = 0, limit: int = 1000) -> DataFrame:
    """A slice of the ids of mentioned vendors, by id."""
    kept = vendors.where(F.col("mention_count") >= 1).select("vendor_id")
    return kept.orderBy("vendor_id").offset(offset).limit(limit)


def vendor_count(vendors: DataFrame) -> DataFrame:
    return vendors.where(F.col("mention_count") >= 1).agg(count())


def most_mentioned(vendors: DataFrame, n: int) -> DataFrame:
    order = [descending("mention_count"), F.asc("vendor_id")]
    return vendors.select("vendor_id", "mention_count").orderBy(*order).limit(n)


def review_vendors(vendors: DataFrame, n: int = 50) -> DataFrame:
    """Vendors merged with less than full confidence, weakest first."""
    kept = vendors.where(F.col("confidence") < 1)
    return kept.orderBy(F.asc("confidence"), F.asc("vendor_id")).limit(n)
