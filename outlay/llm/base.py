"""What the operators share: tables, words, and Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as the result contracts define it; the rest are words.
WORD = r"[^\x20\x09-\x0D]+"

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further ones can't clash with what is added."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Bytes of Arrow data handled at once by ``in_batches``.
SLICE_BYTES = 16_000_000


_kept: list[Callable] = []


def kept_by_worker(make: Callable) -> Callable:
    """What ``make`` gives, kept from task to task until the worker does other work."""
    cached = lru_cache(maxsize=1)(make)
    _kept.append(cached)
    return cached


def _forget_all_but(name: str) -> None:
    for cached in _kept:
        if cached.__name__ != name:
            cached.cache_clear()


def in_batches(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], dict],
    schema: str,
    size: int = SLICE_BYTES,
    keeps: str = "",
) -> DataFrame:
    """Apply ``work`` to Arrow batches; it gives columns by name (lists or arrays).

    A batch is handled in slices of about ``size`` bytes, so that a worker holds that much
    text at a time. A single longer text is a slice of its own. What Arrow keeps of a slice
    is given back after it, since workers stay while others work. For the same reason a worker
    first forgets what is ``kept_by_worker`` for other work than ``keeps``.
    """
    fields = _arrow_schema(schema)

    def run(batches: Batches) -> Batches:
        _forget_all_but(keeps)
        for batch in batches:
            for part in _slices(batch, size):
                out = work(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in fields], schema=fields
                )
                del out
                pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Batches:
    n = batch.num_rows
    step = max(1, n * size // max(batch.nbytes, 1))
    for start in range(0, n, step):
        yield batch.slice(start, step)


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of texts as codes: codes of all words in a row, words per text, and the word
    that each code stands for."""
    lists = pc.ascii_split_whitespace(texts)
    dictionary = lists.flatten().dictionary_encode()
    codes = dictionary.indices.to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    empty = pc.index(dictionary.dictionary, pa.scalar("", texts.type)).as_py()
    kept = codes != empty
    before = np.append(0, np.cumsum(kept))
    return codes[kept], np.diff(before[ends.astype(np.int64)]), dictionary.dictionary


def _arrow_schema(schema: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(),
        "int": pa.int32(),
        "double": pa.float64(),
        "string": pa.string(),
        "boolean": pa.bool_(),
        "binary": pa.binary(),
    }
    fields = []
    for part in schema.split(", "):
        name, kind = part.split(" ")
        inner = kind.removeprefix("array<").removesuffix(">")
        fields.append(pa.field(name, pa.list_(kinds[inner]) if inner != kind else kinds[kind]))
    return pa.schema(fields)


def partitions_for(rows: int, per_partition: int) -> int:
    """Partitions that keep each at about ``per_partition`` rows."""
    return max(1, -(-rows // per_partition))


