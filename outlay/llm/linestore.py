"""Lines found in many documents, by levelled sorted runs of line hashes.

A line is known by its key: the line without ASCII white space at both ends and with A-Z in
lower case. Keys of one character or more that stand in ``least`` documents or more are common,
and every line with a common key goes. A key is known by 128 bits of its hash.

``LineRuns`` keeps how many documents hold each key. Documents come in batches. A batch's keys
are counted and written as a run: a table sorted by hash within buckets of hashes. Keys that a
run already knows to be common need no further count, so a new batch is first merged against
the runs of all levels and leaves those out (anti join), then its own run goes to the lowest
level. A level with ``fanout`` runs is compacted: its runs are merged, counts of one key added
up, into one run of the next level. So there are few runs at any time, and a key is rewritten
once a level. All runs have the same buckets, so the anti joins don't shuffle what is stored.

Which keys are common is known once all batches are in. A key that stands for more than one
in ``HEAVY`` of the (document, key) rows of a batch is heavy. Fewer than ``HEAVY`` keys of a
batch are, whatever the data, so heavy keys are broadcast. The others are joined by hash to the
rows of their documents, and none has more than that share of them, so none is too much for a
task.

Defined results: every row is a document, repeated rows included; a null or empty text is one
empty line; an empty key is never common; a key that repeats within a document counts once
there; texts are taken whole; a document whose lines all go keeps no line and is an empty
text; rows without an id are treated alike; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm.base import in_batches, only, text_or_empty
from outlay.session import cut, discard, scratch_path

LEAST_DOCUMENTS = 10
#: Batches a whole table is dealt to.
BATCHES = 8
#: Runs of a level that are merged into one of the next.
FANOUT = 3
#: A batch has fewer heavy keys than this; all batches together ``BATCHES`` times as many.
HEAVY = 20_000
WHITE = b" \t\n\x0b\x0c\r"
KEY = ["high", "low"]


def line_hashes(text: bytes) -> np.ndarray:
    """For every line of a text the two halves of its key's hash; zeros for an empty key."""
    keys = [line.strip(WHITE).lower() for line in text.split(b"\n")]
    digests = b"".join([xxhash.xxh3_128_digest(k) if k else bytes(16) for k in keys])
    return np.frombuffer(digests, dtype=">i8").astype(np.int64).reshape(-1, 2)


def _texts(docs: DataFrame) -> DataFrame:
    """Rows with ``print``, by which equal rows are one."""
    rows = only(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return rows.withColumn("print", F.xxhash64("doc_id", "text", F.length("text")))


def _keys(texts: DataFrame) -> DataFrame:
    """``doc_id, print, high, low``: a row per document and distinct key."""

    def work(rows: pa.RecordBatch) -> dict:
        high, low = [], []
        for text in rows.column("text"):
            found = line_hashes(text.as_buffer().to_pybytes())
            found = np.unique(found[found.any(axis=1)], axis=0)
            high.append(found[:, 0])
            low.append(found[:, 1])
        same = {c: rows.column(c) for c in ("doc_id", "print")}
        return same | {"high": high, "low": low}

    schema = "doc_id long, print long, high array<long>, low array<long>"
    found = in_batches(texts, work, schema)
    return found.select("doc_id", "print", F.inline(F.arrays_zip("high", "low")))


class LineRuns:
    """Counts of keys in levels of runs. Use it as a context: its tables go in the end."""

    def __init__(self, spark: SparkSession, least: int = LEAST_DOCUMENTS, fanout: int = FANOUT):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._tables: dict[str, str] = {}

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *problem: object) -> None:
        for name in list(self._tables):
            self._drop(name)

    def _store(self, counts: DataFrame) -> str:
        """A run: one file per bucket, as the counts are shuffled by the same hash."""
        name = f"line_run_{uuid.uuid4().hex}"
        self._tables[name] = scratch_path(self.spark, name)
        writer = counts.select(*KEY, "docs").write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.option("path", self._tables[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, self._tables.pop(name))

    def runs(self) -> list[str]:
        """Tables of all levels, the largest first."""
        return [name for level in reversed(self.levels) for name in level]

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs with the counts of one key added up. They are read as plain files: a union of
        bucketed scans would pass for bucketed too, which Spark 4.1 gets wrong in columnar plans."""
        rows = self.spark.read.schema("high long, low long, docs long")
        return rows.parquet(*[self._tables[n] for n in names]).groupBy(*KEY).agg(F.sum("docs").alias("docs"))

    def add(self, counts: DataFrame) -> None:
        """Take in a batch: ``high, low, docs``, a row per key."""
        for run in self.runs():
            settled = self.spark.table(run).where(F.col("docs") >= self.least).select(*KEY)
            counts = counts.join(settled, KEY, "left_anti")
        self._push(self._store(counts), 0)

    def _push(self, run: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self._store(self._merged(full))
            for name in full:
                self._drop(name)
            self._push(merged, level + 1)

    def common(self) -> DataFrame:
        """``high, low, docs`` of the common keys. Counts are least ones: a key is no longer
        counted once it is known to be common."""
        if not self.levels:
            return self.spark.createDataFrame([], "high long, low long, docs long")
        return self._merged(self.runs()).where(F.col("docs") >= self.least)


def common_keys(
    keys: DataFrame, least: int = LEAST_DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT
) -> tuple[DataFrame, DataFrame]:
    """Keys that ``least`` rows of ``high, low, part`` or more hold: the heavy ones, and the
    others. The rows of a ``part`` (0 to ``batches`` - 1) are one batch."""
    spark = keys.sparkSession
    staged = scratch_path(spark, "line-keys")
    counts = keys.groupBy("part", *KEY).agg(F.count(F.lit(1)).alias("docs"))
    counts.write.partitionBy("part").parquet(staged)
    rows = spark.read.schema("high long, low long, docs long, part int").parquet(staged)
    with LineRuns(spark, least, fanout) as runs:
        for part in range(batches):
            batch = rows.where(F.col("part") == part).groupBy(*KEY).agg(F.sum("docs").alias("docs"))
            runs.add(batch)
        common = cut(runs.common().select(*KEY))
    sizes = rows.groupBy("part").agg(F.sum("docs").alias("size"))
    large = rows.join(F.broadcast(sizes), "part").where(F.col("docs") * HEAVY > F.col("size"))
    heavy = cut(common.join(F.broadcast(large.select(*KEY).distinct()), KEY, "left_semi"))
    discard(spark, staged)
    return heavy, common.join(F.broadcast(heavy), KEY, "left_anti")


def without_common_lines(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and the text ``kept`` of every row."""
    texts = _texts(docs)
    keys = _keys(texts)
    part = F.pmod("print", F.lit(batches)).cast("int")
    heavy, light = common_keys(keys.select(*KEY, part.alias("part")), least, batches, fanout)
    met = keys.join(F.broadcast(heavy), KEY, "left_anti").join(light, KEY)
    key = F.struct(*KEY)
    gone = met.groupBy("doc_id", "print").agg(F.collect_set(key).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("_doc_id"), F.col("print").alias("_print"), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("print") == F.col("_print"))
    marked = texts.join(gone, same, "left").select(
        "doc_id", "text", F.col("gone.high").alias("high"), F.col("gone.low").alias("low")
    )
    return _kept(marked, {(r["high"], r["low"]) for r in heavy.collect()})


def _kept(marked: DataFrame, heavy: set[tuple[int, int]]) -> DataFrame:
    """Texts without the lines whose key is heavy or among the row's own."""

    def work(rows: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_lines": [], "n_dropped": [], "kept": []}
        for text, *own in zip(*[rows.column(c) for c in ("text", "high", "low")]):
            data = text.as_buffer().to_pybytes()
            gone = set(zip(*[x.as_py() for x in own])) if own[0].is_valid else set()
            lines = data.split(b"\n")
            keys = map(tuple, line_hashes(data).tolist())
            kept = [line for line, key in zip(lines, keys) if key not in heavy and key not in gone]
            out["n_lines"].append(len(lines))
            out["n_dropped"].append(len(lines) - len(kept))
            out["kept"].append(b"\n".join(kept).decode())
        return {"doc_id": rows.column("doc_id")} | out

    return in_batches(marked, work, "doc_id long, n_lines long, n_dropped long, kept string")


#: The same rows of ``op12_line_dedup``, by keys themselves.
ORACLE_SQL = f"""
WITH line AS (
  SELECT row, doc_id, unnest(range(1, len(lines) + 1)) AS place, unnest(lines) AS line
  FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
        FROM documents)),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= {LEAST_DOCUMENTS})
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (common.key IS NULL), ''))
         AS kept_sha256
FROM keyed LEFT JOIN common USING (key) GROUP BY row, doc_id
"""
