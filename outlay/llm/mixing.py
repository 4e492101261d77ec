"""Mixing sources to target weights by systematic sampling.

Sources in code point order, null last, have the weights ``WEIGHTS`` in turn and share
``SHARE`` times the words of all documents. A target stops at ``MOST_COPIES`` times the
words of its source; what it can't take is shared out again by weight among the others
until none is above.

Every document of a source is expected as often as the others: target over source size.
Documents stand in order of size, their expected copies are summed up in that order, one
offset per source is added, and a document is taken once per whole number that its stretch
of the sum crosses. Since the order is by size, the words taken stay within about the
largest document of the target. The offset is a hash of the source, so reruns agree.

Places in the order come from one sort by source, size and id, dealt by range over all three:
a source with a third of all rows, or rows of one size, spread over many tasks. The target
shares are found by rounds over one row per source.

Defined results: a null or empty text has size zero; a source without words has target
zero and none of its documents are taken; repeated rows are sampled like different ones; an
empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.llm.base import WORD, only, text_or_empty
from outlay.operators.common import join_rules
from outlay.session import cut

# Weights of the sources in turn, share of all words, most copies.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, content`` of every row: the number of words, and a hash of the
    text that tells rows with one id apart."""
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size")
    return only(docs, "doc_id", "source", "text").select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), size, _content()
    )


def _content() -> Column:
    return F.xxhash64("source", "text").alias("content")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Adds ``place``, the position from 0 of each row in the given order.

    Rows are sorted over all tasks; a place is the row's number within its task plus the
    rows of the tasks before, of which there is one count per task.
    """
    ordered = cut(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    task = F.shiftright("_id", 33)
    counts = ordered.groupBy(task.alias("t")).agg(F.count("*").alias("n")).orderBy("t").collect()
    before, total = {"_task": [], "_before": []}, 0
    for row in counts:
        before["_task"].append(row["t"])
        before["_before"].append(total)
        total += row["n"]
    # A row per task, so small whatever the rows. Arrow tables need no Python workers to be read.
    places = pa.schema([("_task", pa.int64()), ("_before", pa.int64())])
    known = df.sparkSession.createDataFrame(pa.table(before, schema=places))
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ordered.withColumn("_task", task.cast("long"))
        .join(F.broadcast(known), "_task")
        .withColumn("place", inside + F.col("_before"))
        .drop("_id", "_task", "_before")
    )


def targets(sources: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, a row per source."""
    weight = F.element_at(
        F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int")
    )
    weighed = cut(
        numbered(sources, F.asc_nulls_last("source")).withColumn("weight", weight).drop("place")
    )
    most = MOST_COPIES * F.col("source_size")
    wanted = SHARE * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    # Per unit of weight; it only rises, as capped sources give their excess to the others.
    level, capped = 0.0, -1
    while True:
        full = most < level * F.col("weight")
        row = weighed.agg(
            F.coalesce(F.sum(F.when(full, most)), F.lit(0)).alias("taken"),
            F.count_if(full).alias("n"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], (wanted - row["taken"]) / row["open"]
    share = F.lit(level) * F.col("weight")
    return weighed.select("source", "source_size", F.least(most.cast("double"), share).alias("target"))


def mixed(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, content, source_size, target, copies`` of every document."""
    order = (F.asc_nulls_last("source"), F.col("size"), F.col("doc_id"), F.col("content"))
    sizes = numbered(sized(docs), *order)
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.min("place").alias("_first")
    )
    goal = targets(sources.select("source", "source_size"))
    first = sources.select(_named(F.col("source")).alias("_key"), "_first")
    goal = goal.withColumn("_key", _named(F.col("source"))).drop("source").join(first, "_key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("place") - F.col("_first")
    upto = F.floor(offset(F.col("source")) + (rank + 1) * rate)
    below = F.floor(offset(F.col("source")) + rank * rate)
    copies = F.least(upto - below, F.lit(MOST_COPIES)).cast("long")
    # Never dealt by source alone: a counted few sources are broadcast, more are salted.
    return join_rules(sizes.withColumn("_key", _named(F.col("source"))), goal, ["_key"]).select(
        "doc_id", "source", "size", "content", "source_size", "target", copies.alias("copies")
    )


def _named(source: Column) -> Column:
    """A key for a source that null has too."""
    return F.coalesce(F.concat(F.lit("1"), source), F.lit("0"))


def offset(source: Column) -> Column:
    """Between 0 and 1, the same for a source on every run."""
    return F.conv(F.substring(F.md5(_named(source)), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def mixture(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of the documents, a row for every time one is taken. Rows that share id,
    source and text are one document, taken as often as all of them together."""
    copies = mixed(docs).groupBy(F.col("doc_id").alias("_doc_id"), F.col("content").alias("_content"))
    copies = copies.agg(F.sum("copies").alias("_copies")).where(F.col("_copies") > 0)
    needed = dict.fromkeys((*columns, "doc_id", "source", "text"))
    found = only(docs, *needed).withColumn("_same", _content())
    found = found.join(
        copies, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_same") == F.col("_content"))
    ).dropDuplicates(["_doc_id", "_content"])
    times = F.explode(F.sequence(F.lit(1), F.col("_copies")))
    return found.select(*columns, times.alias("_time")).select(*columns)


ORACLE_SQL = """
WITH RECURSIVE sized AS MATERIALIZED (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), sources AS MATERIALIZED (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
           WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source
), levels(step, level, capped) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(-1 AS BIGINT)
  UNION ALL
  SELECT step + 1,
         (1.5 * (SELECT sum(source_size) FROM sources)::DOUBLE
            - (SELECT coalesce(sum(2 * source_size), 0)::DOUBLE FROM sources
               WHERE 2 * source_size < level * weight))
           / (SELECT sum(weight)::DOUBLE FROM sources WHERE NOT 2 * source_size < level * weight),
         (SELECT count(*) FROM sources WHERE 2 * source_size < level * weight)
  FROM levels
  WHERE (SELECT count(*) FROM sources WHERE 2 * source_size < level * weight) <> capped
    AND EXISTS (SELECT 1 FROM sources WHERE NOT 2 * source_size < level * weight)
), goal AS MATERIALIZED (
  SELECT source, source_size,
         least((2 * source_size)::DOUBLE,
               (SELECT level FROM levels ORDER BY step DESC LIMIT 1) * weight) AS target,
         CAST('0x' || substr(md5(coalesce('1' || source, '0')), 1, 8) AS BIGINT)
           / 4294967296.0::DOUBLE AS start
  FROM sources
), ranked AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.start,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS FIRST) - 1 AS r,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size::DOUBLE ELSE 0 END AS rate
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * least(floor(start + (r + 1) * rate) - floor(start + r * rate), 2) AS BIGINT)
         AS taken
FROM ranked
"""
