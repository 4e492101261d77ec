"""Stored tables: partitioned Parquet in versions, each of which is whole.

A write never changes files that are there. It puts new files beside them, in a folder of its
own below each partition, and then adds a manifest: the next version of the table, which names
the folders that belong to each partition. Readers follow the newest manifest, so they see a
table before a write or after it, and a table read earlier stays as it was. A writer that dies
leaves files that no manifest names. Two writers can't add the same version: the second checks
whether the first changed what it read, and then either goes on from there or fails with
``Conflict``. ``vacuum`` removes old versions and what dead writers left.

An upsert reads and rewrites only the partitions it touches, and in these only the writes that hold
a key of the batch; rows with new keys are added as a further write. The batch is staged in the shared
folder; it and the stored rows of those writes are shuffled once, by key, which gives the
rows to write and the counts of new and replaced ones. The tasks of that shuffle write them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outlay.operators import name_index
from outlay.operators.common import ranked
from outlay.operators.explore import Search, searched_text
from outlay.operators.incremental import STATE, State, Step
from outlay.schema import TABLES
from outlay.session import cut, discard, scratch_path, tidy

#: Folder name of a null partition value.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
#: Buckets of the vendor tables; a save rewrites those its vendors fall into.
VENDOR_BUCKETS = 32
#: Order of rows in the files of a table, by which scans leave row groups out.
SORTED = {"name_postings": "piece"}
#: Codec of what is written. Ids are most of a row, and entropy coding takes a third off them.
CODEC = "zstd"
#: Partitions up to which a task of an upsert may write a file into each. For more of them rows
#: are gathered by partition first, which shuffles all once more.
MOST_FILES = 64
#: Writes that a bucket of the name index is made of before it is written anew.
MOST_WRITES = 8

# Business keys of records without an id of their own.
BUDGET_KEY = ("jurisdiction_id", "fiscal_year", "department", "category")
CONTRACT_KEY = ("jurisdiction_id", "vendor_name_normalized", "amount", "term_start")


#: The folder below a partition that one write fills, and the folders of manifests and of files
#: that are being written.
WRITE, VERSIONS, STAGED = "write", "_versions", "_staged"
#: Seconds after which files that no version names are taken to be a dead writer's.
DEAD_AFTER = 7 * 24 * 3600.0


class Conflict(RuntimeError):
    """Another writer changed what this write is based on; nothing was written."""


@dataclass(frozen=True)
class Version:
    """A version of a table: for every partition folder the writes that fill it."""

    number: int
    folders: dict[str, list[str]]


@dataclass(frozen=True)
class Counts:
    """Rows an upsert added and rows it replaced."""

    inserted: int
    updated: int


def business_key(columns: tuple[str, ...]) -> Column:
    """One key, in which equal texts of different columns stay apart; null parts are empty."""
    return F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def last_wins(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of every key. Each task keeps one row per key before the shuffle. Sorting
    starts with a number, so that texts and structs are hardly ever compared."""
    hashed = df.withColumn("_place", F.xxhash64(*key))
    return ranked(hashed, ["_place", *key], [order.desc()], 1).drop("rank", "_place")


def any_order(df: DataFrame) -> Column:
    """An order for batches that have none: the same on every run, latest retrieval last."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    latest = [F.col("retrieved_at")] if "retrieved_at" in df.columns else []
    return F.struct(*latest, F.xxhash64(*plain).alias("_hash"))


def split_new(batch: DataFrame, stored: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Batch rows whose key is not stored yet, and those whose key is."""
    known = stored.select(*key)
    return batch.join(known, key, "left_anti"), batch.join(known, key, "left_semi")


def upsert_counts(batch: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many batch keys are new and how many replace a stored row."""
    known = stored.select(*key).distinct().withColumn("_known", F.lit(True))
    marked = batch.select(*key).distinct().join(known, key, "left")
    return marked.agg(
        F.count_if(F.col("_known").isNull()).alias("inserted"),
        F.count_if(F.col("_known").isNotNull()).alias("updated"),
    )


def merged(batch: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows without a newer version, and the batch."""
    kept = stored.join(batch.select(*key), key, "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


class Store:
    """Tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _folder(self, path: str):
        """A path and its file system."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        """Names in a folder, none if it isn't there."""
        target, fs = self._folder(path)
        return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []

    def versions(self, table: str) -> list[int]:
        """The versions of a table that are kept, oldest first."""
        names = self._names(f"{self.path(table)}/{VERSIONS}")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def exists(self, table: str) -> bool:
        target, fs = self._folder(self.path(table))
        return bool(self.versions(table)) or bool(fs.exists(target))

    def version(self, table: str, number: int | None = None) -> Version:
        """A version of a table, the newest by default; version 0 is an empty table."""
        if number is None:
            number = max(self.versions(table), default=0)
        if number == 0:
            return Version(0, {})
        target, fs = self._folder(f"{self.path(table)}/{VERSIONS}/{number:012d}.json")
        stream = fs.open(target)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(number, json.loads(text))

    def read(self, table: str, version: Version | None = None) -> DataFrame:
        """A version of a stored table, the newest by default; one that was never written is
        empty. Folders that streams write themselves have no versions and are read whole."""
        return self._scan(table, version).drop(WRITE)

    def _scan(self, table: str, version: Version | None = None) -> DataFrame:
        """``read`` with the write that each row is from, if the table has versions."""
        schema: T.StructType = TABLES[table]
        if version is None:
            version = self.version(table)
            if version.number == 0 and self._names(self.path(table)):
                plain = [n for n in self._names(self.path(table)) if not n.startswith("_")]
                if plain and not any(n.startswith(f"{WRITE}=") for n in plain):
                    return self.spark.read.schema(schema).parquet(self.path(table))
        paths = [
            "/".join([self.path(table), *([folder] if folder else []), f"{WRITE}={write}"])
            for folder, writes in sorted(version.folders.items())
            for write in writes
        ]
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(T.StructType([*schema.fields, T.StructField(WRITE, T.StringType())]))
        return reader.option("basePath", self.path(table)).parquet(*paths)

    @staticmethod
    def _fitted(df: DataFrame, table: str, *further: str) -> DataFrame:
        """The columns and types of a table; what ``df`` lacks is null."""
        return df.select(
            *[
                (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in TABLES[table].fields
            ],
            *further,
        )

    def _put(
        self, df: DataFrame, table: str, partition: list[str], gather: bool = True
    ) -> tuple[str, list[str], dict[str, int]]:
        """Write rows beside what is stored; gives the name of the write, the partition folders it
        fills, and how many rows have each value of the column ``_mark``, if there is one. Without
        ``gather`` every task writes its own file into each partition it has rows of."""
        marked = df if "_mark" in df.columns else df.withColumn("_mark", F.lit(None).cast("string"))
        fitted = self._fitted(marked, table, "_mark")
        # Rebalancing keeps the files of a partition together and splits a hot partition
        # over several tasks. Marks are counted behind it, in the tasks that write: those of a
        # lost executor are counted once, which earlier stages don't assure.
        writer = fitted.hint("rebalance", *partition) if partition and gather else fitted
        if table in SORTED:
            writer = writer.sortWithinPartitions(*partition, SORTED[table])
        counted = Observation()
        marks = [F.count_if(F.col("_mark") == m).alias(m) for m in ("inserted", "updated")]
        write = uuid.uuid4().hex
        staged = f"{self.path(table)}/{STAGED}/{write}"
        with tidy(self.spark):
            writer.observe(counted, *marks).drop("_mark").write.partitionBy(*partition).parquet(
                staged, compression=CODEC
            )
        folders = [""]
        for _ in partition:
            folders = [
                f"{above}/{name}" if above else name
                for above in folders
                for name in self._names(f"{staged}/{above}" if above else staged)
                if not name.startswith("_")
            ]
        for folder in folders:
            source, fs = self._folder(f"{staged}/{folder}" if folder else staged)
            place = "/".join(x for x in (self.path(table), folder) if x)
            fs.mkdirs(self._folder(place)[0])
            if not fs.rename(source, self._folder(f"{place}/{WRITE}={write}")[0]):
                raise OSError(f"could not move {source} into {place}")
        if partition:
            discard(self.spark, staged)
        return write, folders, counted.get

    def _commit(
        self,
        table: str,
        base: Version,
        write: str,
        filled: list[str],
        cleared: list[str],
        read: list[str] | None,
        gone: set[str] | None = None,
    ) -> None:
        """Add the next version: the newest one without the folders ``cleared``, or only without their
        writes ``gone``, and with the new write in those ``filled``. ``read`` are the folders the write is based on (none: the whole
        table, empty: nothing); if another writer changed one of them since ``base``, it fails."""
        folder = f"{self.path(table)}/{VERSIONS}"
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        while True:
            now = self.version(table)
            watched = set(now.folders) | set(base.folders) if read is None else set(read)
            if any(now.folders.get(f) != base.folders.get(f) for f in watched):
                raise Conflict(f"{table} changed from version {base.number} to {now.number}")
            folders = {}
            for f, writes in now.folders.items():
                left = [w for w in writes if f not in cleared or (gone is not None and w not in gone)]
                if left:
                    folders[f] = left
            for f in filled:
                folders[f] = [*folders.get(f, []), write]
            draft, fs = self._folder(f"{folder}/.{write}")
            target, _ = self._folder(f"{folder}/{now.number + 1:012d}.json")
            fs.mkdirs(draft.getParent())
            stream = fs.create(draft, True)
            stream.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
            stream.close()
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()
            )
            plain = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            try:
                # Fails if the version is there already, so one writer only gets it.
                context.rename(context.makeQualified(draft), context.makeQualified(target), plain)
                return
            except Py4JJavaError as problem:
                if "FileAlreadyExists" not in problem.java_exception.getClass().getName():
                    raise

    def append(self, df: DataFrame, table: str, partition: list[str] | None = None) -> None:
        base = self.version(table)
        write, filled, _ = self._put(df, table, partition or [])
        self._commit(table, base, write, filled, [], [])

    def vacuum(self, table: str, keep: int = 2, dead_after: float = DEAD_AFTER) -> int:
        """Keep the newest versions only; gives the number of folders removed. Folders of older
        versions go, and those no version names once they are ``dead_after`` seconds old."""
        numbers = self.versions(table)
        old = {self._key(f, w) for n in numbers[:-keep] for f, ws in self.version(table, n).folders.items() for w in ws}
        used = {self._key(f, w) for n in numbers[-keep:] for f, ws in self.version(table, n).folders.items() for w in ws}
        for n in numbers[:-keep]:
            discard(self.spark, f"{self.path(table)}/{VERSIONS}/{n:012d}.json")
        removed = 0
        for path, changed in self._writes(self.path(table), ""):
            dead = path not in used and time.time() - changed > dead_after
            if path in old - used or dead:
                discard(self.spark, f"{self.path(table)}/{path}")
                removed += 1
        return removed

    @staticmethod
    def _key(folder: str, write: str) -> str:
        return f"{folder}/{WRITE}={write}" if folder else f"{WRITE}={write}"

    def _writes(self, root: str, below: str) -> Iterator[tuple[str, float]]:
        """Folders of single writes below a table, and when they were changed (seconds)."""
        target, fs = self._folder(f"{root}/{below}" if below else root)
        for status in fs.listStatus(target) if fs.exists(target) else []:
            name = status.getPath().getName()
            path = f"{below}/{name}" if below else name
            if name.startswith(f"{WRITE}=") or below == STAGED:
                yield path, status.getModificationTime() / 1000
            elif status.isDirectory() and name != VERSIONS:
                yield from self._writes(root, path)

    def upsert(
        self,
        batch: DataFrame,
        table: str,
        key: list[str],
        partition: str,
        order: Column | None = None,
        moves: bool = True,
        kept: bool = False,
    ) -> Counts:
        """Insert or replace rows by key. Of equal keys in the batch the last one wins.

        Stored rows are read in the partitions of the batch only. With ``moves`` a stored row
        may lie in another partition than its new version, so the keys of the others are
        looked through as well; tables whose keys contain the partition need not do that. A batch
        that is ``kept`` in files already is read from these as often as needed.
        """
        order = [] if order is None else [order.alias("_order")]
        if kept:
            return self._merge(batch.select("*", *order), table, [F.col(c) for c in key], partition, moves)
        with self._staged(batch.select("*", *order)) as batch:
            return self._merge(batch, table, [F.col(c) for c in key], partition, moves)

    def _merge(self, batch: DataFrame, table: str, key: list[Column], partition: str, moves: bool) -> Counts:
        """Put a staged batch among the stored rows."""
        base = self.version(table)
        touched = self._values(batch, partition)
        if moves and len(self._held(base, touched)) < len(base.folders):
            elsewhere = self.read(table, base).where(~self._within(partition, touched))
            keys = [c.alias(f"_{i}") for i, c in enumerate(key)]
            names = [f"_{i}" for i in range(len(key))]
            found = elsewhere.select(partition, *keys).join(batch.select(*keys), names, "left_semi")
            touched += self._values(found, partition)
        stored, met = None, set()
        if self._held(base, touched):
            met = self._met(batch, table, base, partition, touched, key)
        if met:
            some = {f: [w for w in writes if w in met] for f, writes in base.folders.items()}
            stored = self.read(table, Version(base.number, some)).where(self._within(partition, touched))
        rows = self._newest(batch, stored, table, key)
        gather = len(touched) > MOST_FILES
        return self._replace(rows, table, partition, touched, base, whole=moves, gather=gather, gone=met)

    def _met(
        self, batch: DataFrame, table: str, base: Version, partition: str, touched: list, key: list[Column]
    ) -> set[str]:
        """The writes in the ``touched`` partitions that may hold a key of the batch; the others stay
        as they are. Keys are compared by a hash, so that little is shuffled; two keys with one hash
        cost no more than a write that is read in vain."""
        number = F.xxhash64(*key).alias("_number")
        stored = self._scan(table, base).where(self._within(partition, touched)).select(WRITE, number)
        found = stored.join(batch.select(number), "_number", "left_semi").select(WRITE).distinct()
        return {r[0] for r in found.collect()}

    @classmethod
    def _newest(cls, batch: DataFrame, stored: DataFrame | None, table: str, key: list[Column]) -> DataFrame:
        """The last batch row of every key, and stored rows without a newer version, from one
        shuffle; ``_mark`` says which rows are ``inserted`` or ``updated``. A key with a null is
        equal to none that is stored."""
        given = ["_order"] if "_order" in batch.columns else []
        rows = cls._fitted(batch, table, *given, F.lit(True).alias("_new"))
        if stored is not None:
            old = stored.withColumn("_new", F.lit(False))
            rows = rows.unionByName(old, allowMissingColumns=True)
        # The key's number and the order needn't be shuffled, they are made behind it. Sorting
        # starts with the number, so that texts are hardly ever compared.
        number = F.xxhash64(*key)
        rows = rows.repartition(number).withColumn("_place", number)
        if not given:
            rows = rows.withColumn("_order", any_order(rows.drop("_new", "_place")))
        ordered = Window.partitionBy("_place", *key).orderBy(F.desc("_new"), F.desc("_order"))
        last = F.row_number().over(ordered) == 1
        if stored is None:
            return rows.withColumn("_last", last).where("_last").withColumn("_mark", F.lit("inserted"))
        some_null = F.lit(False)
        for c in key:
            some_null = some_null | c.isNull()
        # In the same order, so that rows are sorted once.
        same = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        met = ~some_null & F.max("_new").over(same) & ~F.min("_new").over(same)
        rows = rows.withColumn("_last", last).withColumn("_met", met)
        rows = rows.where(F.when(F.col("_new"), F.col("_last")).otherwise(~F.col("_met")))
        mark = F.when(F.col("_new"), F.when(F.col("_met"), "updated").otherwise("inserted"))
        return rows.withColumn("_mark", mark)

    @staticmethod
    def _held(version: Version, values: list) -> list[str]:
        """The folders of a version that hold these partition values."""
        names = {NULL_PARTITION if v is None else str(v) for v in values}
        return [f for f in version.folders if unquote(f.partition("=")[2]) in names]

    @staticmethod
    def _values(df: DataFrame, partition: str) -> list:
        """Partition values of a batch; as many as it has jurisdictions or buckets."""
        return [r[0] for r in df.select(partition).distinct().collect()]

    @staticmethod
    def _within(partition: str, values: list) -> Column:
        """A filter on a partition column, which prunes the scan."""
        column = F.col(partition)
        some = [v for v in values if v is not None]
        inside = column.isin(some) if some else F.lit(False)
        if None in values:
            return column.isNull() | F.coalesce(inside, F.lit(False))
        return column.isNotNull() & inside

    @contextmanager
    def _staged(self, df: DataFrame) -> Iterator[DataFrame]:
        """Rows written to the shared folder for as long as they are needed."""
        path = scratch_path(self.spark, "stage")
        try:
            with tidy(self.spark):
                df.write.parquet(path, compression=CODEC)
            yield self.spark.read.schema(df.schema).parquet(path)
        finally:
            target, fs = self._folder(path)
            fs.delete(target, True)

    def _replace(
        self,
        df: DataFrame,
        table: str,
        partition: str,
        touched: list,
        base: Version,
        whole: bool = False,
        gather: bool = True,
        gone: set[str] | None = None,
    ) -> Counts:
        """A version in which the touched partitions hold the rows of ``df`` and nothing else, or
        besides what they hold but for the writes ``gone``. It is based on these partitions of ``base``,
        or on the ``whole`` table."""
        write, filled, marks = self._put(df, table, [partition], gather)
        cleared = self._held(base, touched)
        read = None if whole else [*cleared, *filled]
        self._commit(table, base, write, filled, [*cleared, *filled], read, gone)
        return Counts(marks["inserted"], marks["updated"])

    def replace_jurisdiction(
        self, df: DataFrame, table: str, jurisdictions: list[str] | None = None
    ) -> None:
        """Replace everything stored for the named jurisdictions, those of ``df`` by default.
        One that ``df`` has no rows for is cleared."""
        base = self.version(table)
        if jurisdictions is not None:
            # What is read is known, so rows are written as they come, each task's into a file of its own.
            gather = len(jurisdictions) > MOST_FILES
            self._replace(df, table, "jurisdiction_id", jurisdictions, base, gather=gather)
            return
        with self._staged(df) as rows:
            own = self._values(rows, "jurisdiction_id")
            self._replace(rows, table, "jurisdiction_id", own, base)

    def insert_absent(
        self,
        df: DataFrame,
        table: str,
        key: list[str],
        partition: list[str],
        alike: tuple[str, ...],
    ) -> int:
        """Append rows whose key is not stored; returns how many. Stored keys are looked up
        among the batch's values of the columns ``alike``, in which equal keys must agree."""
        base = self.version(table)
        with self._staged(last_wins(df, key, any_order(df))) as batch:
            stored = self.read(table, base)
            for column in alike:
                stored = stored.where(self._within(column, self._values(batch, column)))
            fresh = batch.join(stored.select(*key), key, "left_anti").withColumn("_mark", F.lit("inserted"))
            gather = batch.select(*partition).distinct().limit(MOST_FILES + 1).count() > MOST_FILES
            write, filled, marks = self._put(fresh, table, partition, gather)
            if marks["inserted"]:
                self._commit(table, base, write, filled, [], None)
        return marks["inserted"]

    def save_transactions(
        self, batch: DataFrame, order: Column | None = None, moves: bool = True, kept: bool = False
    ) -> Counts:
        """Without ``moves`` ids must contain the jurisdiction, as normalized rows' ids do. Partitions
        that many writes fill, as a stream adds them, are written anew as one."""
        if "vendor_name_raw" in batch.columns:
            self.index_names(batch.select("jurisdiction_id", F.col("vendor_name_raw").alias("vendor_name")))
        counts = self.upsert(batch, "transactions", ["id"], "jurisdiction_id", order, moves, kept)
        self.compact("transactions", "jurisdiction_id")
        return counts

    def index_names(self, payments: DataFrame) -> None:
        """Add the names of ``payments`` that are not in the name index yet. This comes before the
        payments are stored, so the index always has all their names; the list of names comes after
        the postings, so that a name on it has them."""
        named = name_index.pairs_of(payments)
        place = name_index.bucket("vendor_name", VENDOR_BUCKETS)
        with self._staged(named.withColumn("bucket", place)) as pairs:
            known = self.read("indexed_names").where(self._within("bucket", self._values(pairs, "bucket")))
            same = [pairs[c].eqNullSafe(known[c]) for c in name_index.PAIR]
            with self._staged(pairs.join(known, same, "left_anti")) as fresh:
                if fresh.isEmpty():
                    return
                postings = name_index.postings_of(fresh)
                places = name_index.bucket("piece", VENDOR_BUCKETS)
                self.append(postings.withColumn("bucket", places), "name_postings", ["bucket"])
                self.append(fresh, "indexed_names", ["bucket"])
        for table in ("name_postings", "indexed_names"):
            self.compact(table, "bucket")

    def compact(self, table: str, partition: str, most: int = MOST_WRITES) -> int:
        """Write the partitions that more than ``most`` writes fill anew as one; how many."""
        base = self.version(table)
        values = [unquote(f.partition("=")[2]) for f, writes in base.folders.items() if len(writes) > most]
        if values:
            column = F.coalesce(F.col(partition).cast("string"), F.lit(NULL_PARTITION))
            rows = self.read(table, base).where(column.isin(values))
            self._replace(rows, table, partition, values, base)
        return len(values)

    def names_like(self, text: str) -> DataFrame:
        """Names, by jurisdiction, that contain a text, from the name index."""
        return name_index.matching(self.spark, self.read("name_postings"), text, VENDOR_BUCKETS)

    def searched(self, s: Search, payments: DataFrame | None = None) -> DataFrame:
        """The payments among which a search is to look: those of the names that contain its
        text, by the name index, or all if it has none."""
        if payments is None:
            payments = self.read("transactions").withColumnRenamed("vendor_name_raw", "vendor_name")
        text = searched_text(s)
        return payments if text is None else name_index.narrowed(payments, cut(self.names_like(text)))

    def save_budgets(self, batch: DataFrame, order: Column | None = None) -> Counts:
        return self._by_business_key(batch, "budgets", BUDGET_KEY, order)

    def save_contracts(self, batch: DataFrame, order: Column | None = None) -> Counts:
        return self._by_business_key(batch, "contracts", CONTRACT_KEY, order)

    def _by_business_key(
        self, batch: DataFrame, table: str, columns: tuple[str, ...], order: Column | None
    ) -> Counts:
        """Of rows with one business key the last by ``order`` stays."""
        key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
        given = [] if order is None else [order.alias("_order")]
        with self._staged(batch.select("*", *given)) as rows:
            if not self._repeated(rows, key):
                return self._merge(rows, table, key, "jurisdiction_id", moves=False)
            latest = F.col("_order") if given else any_order(rows)
            fewer = last_wins(rows.withColumn("_key", business_key(columns)), ["_key"], latest).drop("_key")
            with self._staged(fewer) as rows:
                return self._merge(rows, table, key, "jurisdiction_id", moves=False)

    @staticmethod
    def _repeated(rows: DataFrame, key: list[Column]) -> bool:
        """Whether most rows repeat another one's key, so that it pays to drop all but one of a
        key in every task before they are shuffled."""
        distinct = F.approx_count_distinct(F.xxhash64(*key)).alias("distinct")
        found = rows.agg(F.count(F.lit(1)).alias("rows"), distinct).first()
        return 2 * found["distinct"] < found["rows"]

    def save_vendors(
        self, vendors: DataFrame, variants: DataFrame, affected: DataFrame | None = None
    ) -> None:
        """Replace the attributes and spellings of the ``affected`` vendor ids, by default those
        of ``vendors``; others stay."""
        gone = vendors.select("vendor_id") if affected is None else affected.select("vendor_id")
        self._swap(vendors, "vendors", "vendor_id", {"vendor_id": gone})
        self._swap(variants, "vendor_variants", "vendor_id", {"vendor_id": gone})

    def _swap(self, rows: DataFrame, table: str, place: str, gone: dict[str, DataFrame]) -> None:
        """Put ``rows`` in place of the stored ones whose column is among ``gone``. Only the
        buckets that hold such rows or get new ones are read in full and written; ``place`` is the
        column that says which bucket a row is in."""
        bucket = F.pmod(F.xxhash64(place), F.lit(VENDOR_BUCKETS)).cast("int")
        base = self.version(table)
        with self._staged(rows.withColumn("bucket", bucket)) as fresh:
            stored = self.read(table, base)
            touched = set(self._values(fresh, "bucket"))
            for column, values in gone.items():
                key = values.toDF(column)
                if column == place:
                    touched |= set(self._values(key.withColumn("bucket", bucket), "bucket"))
                else:
                    touched |= set(self._values(stored.join(key, column, "left_semi"), "bucket"))
            kept = stored.where(self._within("bucket", sorted(touched)))
            for column, values in gone.items():
                kept = kept.join(values.toDF(column), column, "left_anti")
            after = kept.unionByName(fresh, allowMissingColumns=True)
            self._replace(after, table, "bucket", sorted(touched), base)

    def resolution_state(self) -> State:
        """What earlier batches left of entity resolution."""
        return State(*[self.read(table).drop("bucket") for table in STATE])

    def save_resolution(self, step: Step) -> None:
        """Store what a step of entity resolution changes, with its vendors and lineage."""
        founders = step.lost_founders.select("vendor_id").union(step.founders.select("vendor_id"))
        changes = {
            "resolution_counts": (step.counts, {"norm": step.touched}),
            "resolution_clusters": (step.clusters, {"norm": step.rebuilt}),
            "resolution_pairs": (step.pairs, {"a": step.changed, "b": step.changed}),
            "resolution_founders": (step.founders, {"vendor_id": founders}),
        }
        for table, (rows, gone) in changes.items():
            self._swap(rows, table, STATE[table], gone)
        self.save_vendors(step.vendors, step.variants, step.affected)
        self.append(step.lineage, "vendor_lineage")

    def save_events(self, events: DataFrame) -> int:
        """Events that are new, as a batch of their own, by which the alert job finds them."""
        batch = F.lit(time.time_ns() // 1000).alias("event_batch")
        return self.insert_absent(
            events.withColumn("event_batch", batch),
            "spend_events",
            ["dedupe_key"],
            ["jurisdiction_id", "event_batch"],
            ("jurisdiction_id", "period"),
        )

    def batches_without_alerts(self) -> list[int]:
        """Event batches that no alert run has finished."""
        done = self.read("alert_runs").select("event_batch")
        batches = self.read("spend_events").select("event_batch").distinct()
        return sorted(r[0] for r in batches.join(done, "event_batch", "left_anti").collect())

    def save_run(self, run: DataFrame) -> None:
        self.append(run, "sync_runs")
