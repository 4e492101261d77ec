"""Registry of the driver queries: a Spark function and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common table expressions by name. Each may use those before it.
CTES: dict[str, str] = {
    "txn": """
  SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR),
                   CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS id,
         CAST(l_orderkey AS VARCHAR) AS source_record_id,
         n_name AS jurisdiction_id,
         'S' || l_suppkey AS vendor_id,
         s_name AS vendor_name,
         c_mktsegment AS department,
         p_type AS category,
         p_brand AS fund,
         CAST(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN -1 ELSE 1 END
              * CAST(CAST(l_extendedprice AS DECIMAL(18,2))
                     * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2))
              AS DECIMAL(18,2)) AS amount,
         CAST(l_shipdate AS DATE) AS date,
         strftime(l_shipdate, '%Y-%m') AS period,
         CAST(year(l_shipdate) + CASE WHEN month(l_shipdate) >= 7 THEN 1 ELSE 0 END AS BIGINT)
           AS fiscal_year,
         CASE o_orderpriority WHEN '2-HIGH' THEN 'sole-source'
                              WHEN '3-MEDIUM' THEN 'competitive-bid'
                              WHEN '5-LOW' THEN 'cooperative'
                              WHEN '1-URGENT' THEN 'emergency' END AS procurement_method
  FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey
  JOIN part ON p_partkey = l_partkey
  JOIN supplier ON s_suppkey = l_suppkey""",
}


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    """A statement with the named common table expressions in front, in the given order. Each
    is computed once, however often the others use it."""
    if not ctes:
        return body
    parts = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]}\n)" for name in ctes)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{body}"


def money(expr: str, name: str) -> str:
    """A money column of the SQL side, in the type the Spark side is presented in."""
    return f"CAST({expr} AS DOUBLE) AS {name}"


def query(name: str, statement: str | None = None) -> Callable[[Query], Query]:
    """Register a query. Without a statement only its rows are checked by the driver."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: present(fn(spark, sf_dir))
        if statement is not None:
            SQL[name] = statement
        return fn

    return add


def present(df: DataFrame) -> DataFrame:
    """Types both engines print alike: money as double, days and times as text, integers
    as long, arrays as text joined by ``|``."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        columns.append(c.alias(f.name))
    return df.select(*columns)
