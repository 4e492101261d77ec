"""The normalize job over source-like text built from the driver tables.

Line items are written out the way portals publish them: money and dates in several text
forms, blank cells, punctuation and suffix variants in names. The SQL side does not parse
that text; it states the values the text was made from.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from outlay.config import DatasetConfig
from outlay.functions import coerce, keys, names
from outlay.operators import health
from outlay.operators import normalize as norm
from outlay.plans.catalog import CTES, money, query, sql
from outlay.plans.txn import table
from outlay.sources.files import spread
from outlay.sources import selection

RETRIEVED = dt.datetime(2024, 1, 31, 12, 0, 0)

# Procurement texts in the extract and the words they stand for.
PROCUREMENT_TEXT = (
    ("Sole  Source", "sole-source"),
    ("Competitive Sealed Bid", "competitive-bid"),
    ("State Contract #12", "cooperative"),
    ("Emergency purchase", "emergency"),
    ("Miscellaneous", "other"),
    ("", None),
)

CONFIG = DatasetConfig(
    jurisdiction_id="metro",
    dataset_id="lines",
    source_url_template="https://example.test/tx/{id}?again={id}",
    mapping={
        "source_record_id": "payment_no",
        "vendor_name": ["vendor_name", "paid_to"],
        "vendor_state": "state",
        "vendor_zip": "zip",
        "department": "dept",
        "category": "fund",
        "account": {"from": "ledger_account", "fallback": "none"},
        "amount": {"from": "paid_amount", "type": "amount"},
        "transaction_date": "paid_day",
        "procurement_method": "procurement",
    },
)


def _choose(index, values):
    chosen = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        chosen = F.when(index == i, v).otherwise(chosen)
    return chosen


def payee_name():
    """A part name written as a firm: suffix and punctuation variants, some with a typo."""
    key = F.col("p_partkey")
    typo_at = (2 + F.floor(key / 7) % (F.length("p_name") - 3)).cast("int")
    mistyped = F.concat(
        F.col("p_name").substr(F.lit(1), typo_at - 1),
        F.col("p_name").substr(typo_at + 1, F.length("p_name")),
    )
    base = F.when(key % 7 == 0, mistyped).otherwise(F.col("p_name"))
    suffix = _choose(key % 5, [" Inc", " Incorporated", ", INC.", " L.L.C.", " & Company"])
    return F.concat(F.when(key % 11 == 0, "The ").otherwise(""), F.initcap(base), F.lit(" "), "p_type", suffix)


CTES["payee"] = """
  SELECT p_partkey,
         upper((CASE WHEN p_partkey % 11 = 0 THEN 'The ' ELSE '' END)
         || (CASE WHEN p_partkey % 7 = 0
                  THEN left(p_name, CAST(pos - 1 AS BIGINT)) || substr(p_name, CAST(pos + 1 AS BIGINT))
                  ELSE p_name END) || ' ' || p_type
         || CASE p_partkey % 5 WHEN 0 THEN ' Inc' WHEN 1 THEN ' Incorporated' WHEN 2 THEN ', INC.'
                               WHEN 3 THEN ' L.L.C.' ELSE ' & Company' END) AS upper_name,
         CASE WHEN p_partkey % 4 = 0 THEN NULL
              WHEN p_size % 3 = 0 THEN 'CA' WHEN p_size % 3 = 1 THEN 'TX' ELSE 'NY' END AS state,
         CASE WHEN p_partkey % 3 = 0 THEN lpad(CAST(p_size * 100 AS VARCHAR), 5, '0') END AS zip,
         p_brand AS city
  FROM (SELECT *, 2 + (p_partkey // 7) % (length(p_name) - 3) AS pos FROM part)"""

# Names as keys: separators become spaces, "THE" goes, suffixes are shortened and
# neighbouring single letters are marked and joined.
CTES["payee_key"] = r"""
  SELECT *, replace(replace(array_to_string(list_transform(string_split(
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(
             trim(regexp_replace(replace(upper_name, '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')),
             '^THE ', ''), '\bINCORPORATED\b', 'INC', 'g'), '\bCOMPANY\b', 'CO', 'g'),
             '\bCORPORATION\b', 'CORP', 'g'), ' '),
           lambda t: CASE WHEN length(t) = 1 THEN '~' || t || '~' ELSE t END), ' '),
         '~ ~', ''), '~', '') AS norm
  FROM payee"""


def payees(spark, sf):
    """Parts as payees with a name, state, zip and city."""
    part = table(spark, sf, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    return part.select(
        "p_partkey",
        payee_name().alias("name_raw"),
        F.when(key % 4 == 0, None)
        .when(size % 3 == 0, "CA")
        .when(size % 3 == 1, "TX")
        .otherwise("NY")
        .alias("state"),
        F.when(key % 3 == 0, F.lpad((size * 100).cast("string"), 5, "0")).alias("zip"),
        F.col("p_brand").alias("city"),
    )


#: Tasks that the line items are read by at least; the given table is one file.
SCAN_TASKS = 16


def extract(spark, sf, lines=None):
    """Line items as a portal would publish them: every column is text. ``lines`` may be a
    stream of line items."""
    lines = spread(table(spark, sf, "lineitem"), SCAN_TASKS) if lines is None else lines
    line = F.col("l_linenumber")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    commas = F.format_number(price, 2)
    amount = F.when(F.col("l_quantity") == 13, _choose(line % 3, ["N/A", "", " - "])).otherwise(
        _choose_column(
            line % 5,
            [
                F.concat(F.lit("$"), commas),
                F.concat(F.lit("($"), commas, F.lit(")")),
                F.concat(commas, F.lit("-")),
                F.concat(F.lit("  -USD "), price.cast("string")),
                price.cast("string"),
            ],
        )
    )
    day = F.to_date("l_shipdate")
    date = _choose_column(
        F.col("l_suppkey") % 6,
        [
            F.date_format(day, "yyyy-MM-dd"),
            F.date_format(day, "M/d/yyyy"),
            F.date_format(day, "yyyyMMdd"),
            F.date_format(day, "MMMM d, yyyy"),
            F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00.000")),
            F.lit("not a date"),
        ],
    )
    lines = lines.withColumnRenamed("l_partkey", "p_partkey")
    return lines.join(payees(spark, sf), "p_partkey").select(
        F.col("l_orderkey").cast("string").alias("payment_no"),
        F.when(line == 1, "  ").otherwise(F.col("name_raw")).alias("vendor_name"),
        F.concat(F.lit(" Payee "), F.col("l_suppkey").cast("string")).alias("paid_to"),
        F.lower("state").alias("state"),
        F.concat("zip", F.lit("-1234")).alias("zip"),
        F.concat(F.col("l_returnflag"), F.lit(" & Rec   Dept.")).alias("dept"),
        F.concat(F.lit("Fund  "), F.col("l_linestatus")).alias("fund"),
        amount.alias("paid_amount"),
        date.alias("paid_day"),
        _choose(line % 6, [text for text, _ in PROCUREMENT_TEXT]).alias("procurement"),
        F.concat_ws("/", "l_linenumber", "p_partkey", "l_suppkey").alias("line"),
    )


def _choose_column(index, columns):
    chosen = columns[-1]
    for i, c in enumerate(columns[:-1]):
        chosen = F.when(index == i, c).otherwise(chosen)
    return chosen


_PROCUREMENT_CASE = " ".join(
    f"WHEN {i} THEN {repr(word) if word else 'NULL'}" for i, (_, word) in enumerate(PROCUREMENT_TEXT)
)

CTES["line"] = f"""
  SELECT CAST(l_orderkey AS VARCHAR) AS source_record_id,
         CASE WHEN l_linenumber = 1 THEN 'PAYEE ' || l_suppkey ELSE norm END AS vendor_name_normalized,
         state AS vendor_state, zip AS vendor_zip,
         l_returnflag || ' & Rec   Dept.' AS department_raw,
         l_returnflag || ' AND REC DEPARTMENT' AS department,
         'Fund ' || l_linestatus AS category,
         CASE WHEN l_quantity <> 13 THEN
           CAST(l_extendedprice AS DECIMAL(18,2))
           * CASE WHEN l_linenumber % 5 IN (1, 2, 3) THEN -1 ELSE 1 END END AS amount,
         CASE WHEN l_suppkey % 6 <> 5 THEN CAST(l_shipdate AS DATE) END AS date,
         CASE l_linenumber % 6 {_PROCUREMENT_CASE} END AS procurement_method,
         concat_ws('/', l_linenumber, p_partkey, l_suppkey) AS line
  FROM lineitem JOIN payee_key ON p_partkey = l_partkey"""

_LINE = ("payee", "payee_key", "line")


def normalized(spark, sf):
    return norm.normalize(extract(spark, sf), CONFIG, RETRIEVED)


@query(
    "normalize_transactions",
    sql(
        f"""SELECT 'metro' AS jurisdiction_id, 'lines' AS dataset_id, source_record_id,
       vendor_name_normalized, vendor_state, vendor_zip, department_raw, department, category,
       'none' AS account, {money('amount', 'amount')}, 'USD' AS currency,
       strftime(date, '%Y-%m-%d') AS date,
       CAST(year(date) + CASE WHEN month(date) >= 7 THEN 1 ELSE 0 END AS BIGINT) AS fiscal_year,
       procurement_method,
       'https://example.test/tx/' || source_record_id || '?again={{id}}' AS source_url,
       '2024-01-31 12:00:00' AS retrieved_at, line
FROM line WHERE amount IS NOT NULL""",
        *_LINE,
    ),
)
def normalize_transactions(spark, sf):
    columns = [
        "jurisdiction_id",
        "dataset_id",
        "source_record_id",
        "vendor_name_normalized",
        "vendor_state",
        "vendor_zip",
        "department_raw",
        "department",
        "category",
        "account",
        "amount",
        "currency",
        "date",
        "fiscal_year",
        "procurement_method",
        "source_url",
        "retrieved_at",
    ]
    return normalized(spark, sf).records.select(*columns, F.col("raw")["line"].alias("line"))


@query(
    "normalize_rejects",
    sql(
        """SELECT 'metro' AS jurisdiction_id, 'no parseable amount in paid_amount' AS reason,
       source_record_id AS payment_no, line FROM line WHERE amount IS NULL""",
        *_LINE,
    ),
)
def normalize_rejects(spark, sf):
    raw = F.col("raw")
    return normalized(spark, sf).rejects.select(
        "jurisdiction_id",
        "reason",
        raw["payment_no"].alias("payment_no"),
        raw["line"].alias("line"),
    )


@query(
    "normalize_row_ids",
    sql(
        "SELECT count(*) AS rows, count(DISTINCT (source_record_id, line, vendor_name_normalized,"
        " department, category, amount, date)) AS ids FROM line WHERE amount IS NOT NULL",
        *_LINE,
    ),
)
def normalize_row_ids(spark, sf):
    ids = normalized(spark, sf).records
    return ids.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))


@query(
    "run_counters",
    sql(
        """SELECT count(*) AS rows_seen, count(amount) AS rows_mapped,
       count(*) - count(amount) AS mapping_errors FROM line""",
        *_LINE,
    ),
)
def run_counters(spark, sf):
    result = normalized(spark, sf)
    return health.run_counters(result.records, result.rejects)


BUDGET = DatasetConfig(
    jurisdiction_id="metro",
    record_type="budget",
    fiscal_year_start_month=10,
    mapping={
        "amount_budgeted": "limit",
        "fiscal_year": "fy",
        "transaction_date": "opened",
        "department": "segment",
        "category": "status",
        "source_record_id": "id",
    },
)


@query(
    "normalize_budgets",
    """SELECT 'metro' AS jurisdiction_id, c_mktsegment || ' AND CO' AS department,
       o_orderstatus AS category,
       CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2031
            ELSE year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END END
            AS BIGINT) AS fiscal_year,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount_budgeted, 'USD' AS currency,
       CAST(NULL AS VARCHAR) AS source_url
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 10 <> 7""",
)
def normalize_budgets(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    lines = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.cast("string").alias("id"),
        F.when(key % 10 == 7, "tbd").otherwise(F.format_number(price, 2)).alias("limit"),
        F.when(key % 3 == 0, "FY 2031").otherwise("").alias("fy"),
        F.date_format("o_orderdate", "MM-dd-yyyy").alias("opened"),
        F.concat(F.lower("c_mktsegment"), F.lit(" & co.")).alias("segment"),
        F.col("o_orderstatus").alias("status"),
    )
    columns = ["jurisdiction_id", "department", "category", "fiscal_year", "amount_budgeted"]
    records = norm.normalize(lines, BUDGET, RETRIEVED).records
    return records.select(*columns, "currency", "source_url")


CONTRACT = DatasetConfig(
    jurisdiction_id="metro",
    record_type="contract",
    mapping={
        "vendor_name": "name",
        "amount": "value",
        "term_start": "start",
        "term_end": "end",
        "contract_type": "type",
        "procurement_method": "how",
        "description": "note",
    },
)


@query(
    "normalize_contracts",
    """SELECT 'CUSTOMER ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS vendor_name_normalized,
       'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS vendor_name_raw,
       CASE WHEN o_orderkey % 4 <> 1 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END
         AS amount,
       strftime(o_orderdate, '%Y-%m-%d') AS term_start, CAST(NULL AS VARCHAR) AS term_end,
       o_orderstatus AS contract_type,
       CASE WHEN o_orderkey % 2 = 0 THEN 'competitive-bid' END AS procurement_method,
       CASE WHEN o_orderkey % 2 = 0 THEN 'low bid' END AS procurement_method_raw,
       'two words' AS description
FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def normalize_contracts(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    lines = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("name"),
        F.when(key % 4 == 1, None).otherwise(price.cast("string")).alias("value"),
        F.date_format("o_orderdate", "M.d.yyyy").alias("start"),
        F.lit("13/40/2024").alias("end"),
        F.col("o_orderstatus").alias("type"),
        F.when(key % 2 == 0, "low \t bid").otherwise(" ").alias("how"),
        F.lit("two \n words ").alias("note"),
    )
    columns = ["vendor_name_raw", "vendor_name_normalized", "amount", "term_start", "term_end"]
    records = norm.normalize(lines, CONTRACT, RETRIEVED).records
    return records.select(
        *columns, "contract_type", "procurement_method", "procurement_method_raw", "description"
    )


@query("vendor_keys", sql("SELECT p_partkey, norm AS key FROM payee_key", "payee", "payee_key"))
def vendor_keys(spark, sf):
    return payees(spark, sf).select("p_partkey", names.vendor_key(F.col("name_raw")).alias("key"))


@query(
    "department_names",
    """SELECT DISTINCT c_mktsegment AS raw, o_orderpriority,
       c_mktsegment || ' AND DEPARTMENT OF ' || replace(o_orderpriority, '-', ' ') AS name
FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def department_names(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    both = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    pairs = both.select("c_mktsegment", "o_orderpriority").distinct()
    text = F.concat("c_mktsegment", F.lit(" & Dept./of-"), "o_orderpriority")
    return pairs.select(
        F.col("c_mktsegment").alias("raw"), "o_orderpriority", names.department(text).alias("name")
    )


@query(
    "procurement_vocabulary",
    f"""SELECT CASE l_linenumber % 6 {_PROCUREMENT_CASE} END AS method, count(*) AS count
FROM lineitem GROUP BY 1""",
)
def procurement_vocabulary(spark, sf):
    text = _choose(F.col("l_linenumber") % 6, [t for t, _ in PROCUREMENT_TEXT])
    lines = table(spark, sf, "lineitem").select(coerce.procurement(text).alias("method"))
    return lines.groupBy("method").agg(F.count(F.lit(1)).alias("count"))


@query(
    "fiscal_year_calc",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS january,
       CAST(year(o_orderdate) + (month(o_orderdate) >= 7)::INT AS BIGINT) AS july,
       CAST(year(o_orderdate) + (month(o_orderdate) >= 10)::INT AS BIGINT) AS october
FROM orders""",
)
def fiscal_year_calc(spark, sf):
    day = F.to_date("o_orderdate")
    starts = {"january": 1, "july": 7, "october": 10}
    years = [coerce.fiscal_year(day, month).alias(name) for name, month in starts.items()]
    return table(spark, sf, "orders").select("o_orderkey", *years)


@query(
    "amount_coercion",
    """SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS plain,
       -abs(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE)) AS wrapped,
       -abs(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE)) AS trailing,
       CAST(NULL AS DOUBLE) AS nothing,
       CAST(CAST(c_custkey AS VARCHAR) || '.25' AS DOUBLE) AS dots
FROM customer""",
)
def amount_coercion(spark, sf):
    balance = F.col("c_acctbal").cast("decimal(18,2)")
    size = F.format_number(F.abs(balance), 2)
    key = F.col("c_custkey").cast("string")
    return table(spark, sf, "customer").select(
        "c_custkey",
        coerce.amount(F.concat(F.lit(" "), balance.cast("string"))).alias("plain"),
        coerce.amount(F.concat(F.lit("( $"), size, F.lit(" )"))).alias("wrapped"),
        coerce.amount(F.concat(F.lit("$"), size, F.lit(" - "))).alias("trailing"),
        coerce.amount(F.concat(F.lit("n/a "), F.regexp_replace("c_mktsegment", r"\d", ""))).alias(
            "nothing"
        ),
        coerce.amount(F.concat(key, F.lit(".2.5"))).alias("dots"),
    )


@query(
    "date_coercion",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso,
       strftime(o_orderdate, '%Y-%m-%d') AS us, strftime(o_orderdate, '%Y-%m-%d') AS compact,
       strftime(o_orderdate, '%Y-%m-%d') AS spelled,
       CASE WHEN o_orderkey % 100 < 70 THEN '20' ELSE '19' END
         || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '-03-09' AS short,
       CAST(NULL AS VARCHAR) AS invalid
FROM orders""",
)
def date_coercion(spark, sf):
    day = F.to_date("o_orderdate")
    two = F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        coerce.date(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:30"))).alias("iso"),
        coerce.date(F.date_format(day, "MM.dd.yyyy")).alias("us"),
        coerce.date(F.date_format(day, " yyyyMMdd ")).alias("compact"),
        coerce.date(F.date_format(day, "d MMM yyyy")).alias("spelled"),
        coerce.date(F.concat(F.lit("3/9/"), two)).alias("short"),
        coerce.date(F.concat(F.lit("31/"), two, F.lit("/2020"))).alias("invalid"),
    )


@query(
    "integer_coercion",
    """SELECT c_custkey, c_custkey AS worded, -c_custkey AS signed, CAST(NULL AS BIGINT) AS broken
FROM customer""",
)
def integer_coercion(spark, sf):
    key = F.col("c_custkey").cast("string")
    return table(spark, sf, "customer").select(
        "c_custkey",
        coerce.integer(F.concat(F.lit("FY "), key)).alias("worded"),
        coerce.integer(F.concat(F.lit("- "), key)).alias("signed"),
        coerce.integer(F.concat(key, F.lit("-"), key)).alias("broken"),
    )


@query(
    "source_links",
    """SELECT o_orderkey, 'https://example.test/' || CASE WHEN o_orderkey % 2 = 0
  THEN CAST(o_orderkey AS VARCHAR) ELSE '' END || '/view' AS link FROM orders""",
)
def source_links(spark, sf):
    record = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string"))
    link = keys.source_link("https://example.test/{id}/view", record)
    return table(spark, sf, "orders").select("o_orderkey", link.alias("link"))


@query(
    "union_extracts",
    """SELECT 'orders' AS source, count(*) AS rows, 0 AS zips FROM orders
UNION ALL SELECT 'lines', count(*),
  count(CASE WHEN p_partkey % 3 = 0 THEN 1 END) FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def union_extracts(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.lit("orders").alias("source"), F.col("o_totalprice").cast("string").alias("paid_amount")
    )
    lines = extract(spark, sf).withColumn("source", F.lit("lines"))
    both = norm.union_extracts([orders, lines])
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.count("zip").alias("zips")
    )


@query(
    "schema_drift",
    """SELECT * FROM (VALUES ('department', 'dept|department'), ('amount', 'paid_amount'))
 AS t(field, sources) WHERE (SELECT count(*) FROM orders) > 0""",
)
def schema_drift(spark, sf):
    # Orders land as rows that differ in their keys: the status is only there when set.
    orders = table(spark, sf, "orders").select(
        F.map_from_arrays(
            F.array(F.lit("id"), F.concat(F.lit("status_"), "o_orderstatus")),
            F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus")),
        ).alias("raw")
    )
    config = DatasetConfig(
        jurisdiction_id="metro",
        mapping={
            "source_record_id": "id",
            "department": ["dept", "department"],
            "category": ["status", "status_F", "status_O"],
            "fund": {"from": "fund", "fallback": "general"},
            "amount": "paid_amount",
        },
    )
    return selection.drifted_fields(orders, config)


CTES["assigned"] = """
  SELECT norm AS vendor_name_normalized, 'V-' || norm AS vendor_id, min(upper_name) AS canonical_name
  FROM payee_key WHERE norm LIKE '%INC' GROUP BY norm"""


@query(
    "analytics_rows",
    sql(
        f"""SELECT coalesce(a.vendor_id, 'unresolved:' || vendor_name_normalized) AS vendor_id,
       department, category, strftime(date, '%Y-%m') AS period, procurement_method,
       {money('sum(amount)', 'total')}, count(*) AS count
FROM line LEFT JOIN assigned a USING (vendor_name_normalized)
WHERE amount IS NOT NULL GROUP BY ALL""",
        *_LINE,
        "assigned",
    ),
)
def analytics_rows(spark, sf):
    key = names.vendor_key(F.col("name_raw")).alias("vendor_name_normalized")
    known = payees(spark, sf).select(key, F.upper("name_raw").alias("name"))
    known = known.where(F.col("vendor_name_normalized").endswith("INC"))
    vendor_id = F.concat(F.lit("V-"), "vendor_name_normalized").alias("vendor_id")
    assignment = known.select("vendor_name_normalized", vendor_id).distinct()
    vendors = known.groupBy(vendor_id).agg(F.min("name").alias("canonical_name"))
    rows = norm.analytics_rows(normalized(spark, sf).records, assignment, vendors)
    return rows.groupBy("vendor_id", "department", "category", "period", "procurement_method").agg(
        F.sum("amount").alias("total"), F.count(F.lit(1)).alias("count")
    )
