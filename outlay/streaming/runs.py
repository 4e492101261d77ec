"""Partial sums of a stream, merged in levels as they grow in number.

Every micro-batch adds a run of its own. As soon as ``FANOUT`` runs of a level stand side by side
they are summed into one of the next level, so a reader opens at most ``FANOUT - 1`` runs a level,
and each partial sum is rewritten once a level. A merged run is written aside and renamed when it
is whole; until then, and after a writer that died, readers use the runs it is made of. These
are removed when the next run of that level is written, so readers that listed them before
have had a whole generation's time.

A micro-batch that is repeated overwrites its own run, or finds it merged already. Micro-batch 0
starts a stream anew: what an earlier stream left in the folder goes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.session import discard

BATCH = "batch_id"
#: Runs of a level that are merged into one of the next.
FANOUT = 8
#: Folder of merged runs; its name keeps it apart from the runs of micro-batches.
MERGED = "_merged"


@dataclass(frozen=True, order=True)
class Run:
    """The partial sums of micro-batches ``first`` to ``last``."""

    first: int
    last: int
    level: int
    path: str


class Runs:
    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path, fanout

    def _names(self, path: str) -> list[str]:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []

    def stored(self) -> list[Run]:
        """All runs, also those that a merged one replaces."""
        found = []
        for name in self._names(self.path):
            if name.startswith(f"{BATCH}="):
                batch = int(name.partition("=")[2])
                found.append(Run(batch, batch, 0, f"{self.path}/{name}"))
        for name in self._names(f"{self.path}/{MERGED}"):
            if not name.startswith("_"):
                level, first = map(int, name.split("-"))
                last = first + self.fanout**level - 1
                found.append(Run(first, last, level, f"{self.path}/{MERGED}/{name}"))
        return found

    def current(self) -> list[Run]:
        """The fewest runs that hold every micro-batch once."""
        chosen: list[Run] = []
        for run in sorted(self.stored(), key=lambda r: (r.first, -r.level)):
            if not chosen or run.first > chosen[-1].last:
                chosen.append(run)
        return chosen

    def read(self, runs: list[Run] | None = None) -> DataFrame:
        """Partial sums; ``batch_id`` is that of the last micro-batch in them."""
        runs = self.current() if runs is None else runs
        single = [r.path for r in runs if not r.level]
        merged = [r.path for r in runs if r.level]
        parts = []
        if single:
            parts.append(self.spark.read.option("basePath", self.path).parquet(*single))
        if merged:
            parts.append(self.spark.read.parquet(*merged))
        return reduce(DataFrame.unionByName, parts)

    def add(self, sums: DataFrame, batch_id: int, keys: list[str]) -> None:
        """Store the ``total`` and ``count`` per key of a micro-batch, and merge what is due."""
        if batch_id == 0:
            for run in self.stored():
                discard(self.spark, run.path)
        if not any(r.first <= batch_id <= r.last for r in self.stored() if r.level):
            sums.write.mode("overwrite").parquet(f"{self.path}/{BATCH}={batch_id}")
        level, size = 1, self.fanout
        while (batch_id + 1) % size == 0:
            self._merge(level, batch_id + 1 - size, batch_id, keys)
            level, size = level + 1, size * self.fanout

    def _merge(self, level: int, first: int, last: int, keys: list[str]) -> None:
        within = [r for r in self.current() if first <= r.first and r.last <= last]
        if not within or within[0].level >= level:
            return
        rows = self.read(within)
        kinds = dict(rows.dtypes)
        summed = rows.groupBy(*keys).agg(
            F.sum("total").cast(kinds["total"]).alias("total"),
            F.sum("count").alias("count"),
            F.max(BATCH).alias(BATCH),
        )
        staged = f"{self.path}/{MERGED}/_staged-{uuid.uuid4().hex}"
        summed.write.parquet(staged)
        jvm = self.spark.sparkContext._jvm
        source = jvm.org.apache.hadoop.fs.Path(staged)
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{MERGED}/{level}-{first}")
        fs = source.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.rename(source, target):
            raise OSError(f"can't rename {staged}")
        current = self.current()
        for run in self.stored():
            if run.last < first and run not in current:
                discard(self.spark, run.path)
