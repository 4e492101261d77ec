"""Readers and mentions over the driver tables: rows are landed as files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.operators import resolve
from outlay.plans.catalog import query
from outlay.plans.txn import table
from outlay.session import scratch_path
from outlay.sources import files

# Marks that quoting has to carry: commas, quotes and, for whole files, line breaks.
_NAME = """p_name || ', "' || p_brand || '"' || chr(10) || p_type"""


def _parts(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("key"),
        F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\n'), "p_type").alias("name"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("string")).alias("size"),
    )


_LANDED = f"""SELECT CAST(p_partkey AS VARCHAR) AS key, {_NAME} AS name,
       CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS size FROM part"""


def _land_csv(spark, rows):
    path = scratch_path(spark, "csv")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)
    return path


@query("read_csv_quoted", _LANDED)
def read_csv_quoted(spark, sf):
    return files.read_csv(spark, _land_csv(spark, _parts(spark, sf)))


@query("read_csv_split", _LANDED.replace("chr(10)", "' '"))
def read_csv_split(spark, sf):
    """Without quoted line breaks large files are split."""
    flat = _parts(spark, sf).withColumn("name", F.translate("name", "\n", " "))
    return files.read_csv(spark, _land_csv(spark, flat), line_breaks=False)


def _objects(spark, sf):
    """Rows as JSON objects, a hundred to a response."""
    rows = _parts(spark, sf).withColumn("page", F.floor(F.col("key").cast("long") / 100))
    return rows.groupBy("page").agg(
        F.to_json(F.collect_list(F.struct("key", "name", "size"))).alias("value")
    )


def _read_back(raw):
    return raw.select(
        *[F.coalesce(F.col("raw")[c], F.lit("")).alias(c) for c in ("key", "name", "size")]
    )


@query("read_json_envelopes", _LANDED)
def read_json_envelopes(spark, sf):
    """Responses with the rows under every known key in turn, or as a bare array; one file
    holds one response."""
    keys = F.array(F.lit(None).cast("string"), *[F.lit(k) for k in files.ENVELOPE_KEYS])
    pages = _objects(spark, sf).withColumn("kind", F.pmod("page", F.size(keys)).cast("int"))
    key = F.element_at(keys, F.col("kind") + 1)
    body = F.concat(F.lit('{"count": 1, "'), key, F.lit('": '), "value", F.lit("}"))
    return _read_back(files.read_json_rows(spark, _land_pages(spark, pages, F.coalesce(body, "value"))))


@query("read_json_pages", _LANDED)
def read_json_pages(spark, sf):
    pages = _objects(spark, sf)
    return _read_back(files.read_json_pages(spark, _land_pages(spark, pages, F.col("value"))))


def _land_pages(spark, pages, body):
    """A folder per page, so that a file holds one response. Returns a pattern for them."""
    path = scratch_path(spark, "json")
    pages.select(body.alias("value"), "page").write.partitionBy("page").text(path)
    return f"{path}/page=*"


@query(
    "preview_rows",
    """SELECT 'preview' AS kind, least(count(*), 25) AS count FROM part
UNION ALL SELECT 'all', count(*) FROM part""",
)
def preview_rows(spark, sf):
    """The documented cap of a preview, and none without it."""
    rows = _parts(spark, sf)
    counted = lambda df, kind: df.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit(kind).alias("kind"), "count"
    )
    return counted(files.preview(rows, 25), "preview").unionByName(counted(files.preview(rows), "all"))


@query(
    "mentions",
    """SELECT l_orderkey || ':' || l_linenumber || ':' || l_suppkey AS id, s_name AS name_raw,
       lower(s_name) AS norm, NULL AS city, n_name AS state, NULL AS zip
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""",
)
def mentions(spark, sf):
    supplier = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_name", F.col("s_nationkey").alias("n_nationkey")
    )
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    txns = lines.join(supplier.join(nation, "n_nationkey"), "l_suppkey").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey").alias("id"),
        F.col("s_name").alias("vendor_name_raw"),
        F.lower("s_name").alias("vendor_name_normalized"),
        F.lit(None).cast("string").alias("vendor_city"),
        F.col("n_name").alias("vendor_state"),
        F.lit(None).cast("string").alias("vendor_zip"),
    )
    return resolve.mentions_of(txns)
