"""The driver tables seen as spending data.

A payment is a line item. Only the dimension joins that the asked columns need are part
of the plan: every join keeps all payments, so leaving one out changes no result, and a
query by vendor reads nothing but ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.functions import coerce

FISCAL_START = 7
MONEY = "decimal(18,2)"

ORDER_COLUMNS = {"procurement_method"}
CUSTOMER_COLUMNS = {"department"}
NATION_COLUMNS = {"jurisdiction_id"}
PART_COLUMNS = {"category", "fund"}
SUPPLIER_COLUMNS = {"vendor_name"}
#: By which joined payments are dealt to tasks; may be asked for beside the columns of a payment.
LINE_KEY = "l_orderkey"
#: What a line's own columns are made from; ``_amount`` is made at the scan.
RAW = {
    "id": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"),
    "source_record_id": ("l_orderkey",),
    "vendor_id": ("l_suppkey",),
    "amount": ("_amount",),
    "date": ("l_shipdate",),
    "time": ("l_shipdate",),
    "period": ("l_shipdate",),
    "fiscal_year": ("l_shipdate",),
}

# Order priorities read as procurement methods.
PROCUREMENT = {
    "2-HIGH": "sole-source",
    "3-MEDIUM": "competitive-bid",
    "5-LOW": "cooperative",
    "1-URGENT": "emergency",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _amount() -> Column:
    price = F.col("l_extendedprice").cast(MONEY)
    rest = F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    refund = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    paid = (price * rest).cast(MONEY)
    return F.when(refund, -paid).otherwise(paid).cast(MONEY)


def _procurement() -> Column:
    chosen = F.lit(None).cast("string")
    for priority, word in PROCUREMENT.items():
        chosen = F.when(F.col("o_orderpriority") == priority, word).otherwise(chosen)
    return chosen


def payments(
    spark: SparkSession, sf_dir: str, *columns: str, lines: DataFrame | None = None
) -> DataFrame:
    """Payments with the asked columns. ``lines`` may be a stream of line items. The joins carry
    numbers; the texts made from them are made behind the joins."""
    wanted = set(columns)
    day = F.to_date("l_shipdate")
    own = {
        "id": F.concat_ws(
            ":",
            *["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
            F.col("l_extendedprice").cast(MONEY).cast("string"),
            day.cast("string"),
        ),
        "source_record_id": F.col("l_orderkey").cast("string"),
        "vendor_id": F.concat(F.lit("S"), "l_suppkey"),
        "amount": F.col("_amount"),
        "date": day,
        "time": F.col("l_shipdate").cast("timestamp"),
        "period": coerce.period(day),
        "fiscal_year": coerce.fiscal_year(day, FISCAL_START),
    }
    df = table(spark, sf_dir, "lineitem") if lines is None else lines
    dims = wanted - set(own) - {LINE_KEY}
    keys = {
        "l_orderkey": ORDER_COLUMNS | CUSTOMER_COLUMNS | NATION_COLUMNS,
        "l_partkey": PART_COLUMNS,
        "l_suppkey": SUPPLIER_COLUMNS,
    }
    carried = [k for k, needs in keys.items() if dims & needs]
    raw = dict.fromkeys([c for name in own if name in wanted for c in RAW[name]] + carried)
    if LINE_KEY in wanted:
        raw[LINE_KEY] = None
    df = df.select(*[_amount().alias(c) if c == "_amount" else c for c in raw])
    if dims & PART_COLUMNS:
        part = table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("l_partkey"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("fund"),
        )
        df = df.join(part, "l_partkey")
    if dims & SUPPLIER_COLUMNS:
        supplier = table(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("vendor_name")
        )
        df = df.join(supplier, "l_suppkey")
    if "l_orderkey" in carried:
        df = df.join(_orders(spark, sf_dir, dims), "l_orderkey")
    return df.select(*[own[c].alias(c) if c in own else c for c in columns])


def _orders(spark: SparkSession, sf_dir: str, dims: set[str]) -> DataFrame:
    """Orders with the columns that depend on the order, joined before the line items.

    Customers are fewer than orders and orders fewer than lines, so the attributes are
    put together on the smaller tables and the lines are shuffled once.
    """
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        "o_custkey",
        _procurement().alias("procurement_method"),
    )
    if dims & (CUSTOMER_COLUMNS | NATION_COLUMNS):
        customer = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("o_custkey"),
            F.col("c_mktsegment").alias("department"),
            "c_nationkey",
        )
        if dims & NATION_COLUMNS:
            nation = table(spark, sf_dir, "nation").select(
                F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("jurisdiction_id")
            )
            customer = customer.join(nation, "c_nationkey")
        orders = orders.join(customer, "o_custkey")
    return orders.select("l_orderkey", *sorted(dims & set(orders.columns)))


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("vendor_id"),
        F.col("s_name").alias("canonical_name"),
        F.col("s_nationkey"),
    )


def jurisdictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as jurisdictions; all are active."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("jurisdiction_id"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("state"),
        F.lit(True).alias("is_active"),
    )
