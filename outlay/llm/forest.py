"""Nearest neighbours by cosine with a forest of hash prefixes.

Each tree gives a vector a string of ``BITS`` signs of random projections and keeps the
strings in order, so that the vectors sharing a prefix with a query stand together. A query
descends all trees to prefixes that hold about ``BLOCK`` vectors and ranks what it finds
there. It then ascends all trees at once, to the longest prefix at which a neighbour as
close as the last one found shares a prefix in one of the trees with probability
``RECALL``: two vectors at angle t agree in a sign with probability 1 - t/pi. What it finds
there can only be closer, which would allow longer prefixes, so one ascent is enough. Queries
in dense places stay near the leaves; those without close neighbours go up almost to the
root, and where the trees together would be searched more than ``MOST_WORK`` times over, the
root of one tree is searched instead.

Equal vectors stand in the index once, with their ``k + 1`` least ids: no more of them can be
among the ``k`` nearest of any query. A prefix is one block of work for a task; larger ones
are split into salted parts of ``PART`` vectors, and so are its queries.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component
take no part; vectors are compared with those of the same number of components; equal
scores are ordered by id; rows that repeat an id and a vector count once; fewer candidates
than ``k`` give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from functools import lru_cache
from math import acos, floor, log, log2, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.llm.base import in_batches, only
from outlay.session import cut

TREES = 16
BITS = 24
BLOCK = 256
RECALL = 0.9
MOST_WORK = 2.0
PART = 8192
QUERY_PART = 2048
SEED = 11

_KEY = ["size", "tree", "depth", "prefix"]


def nearest(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest of every row that satisfies the
    condition ``queries`` on ``vec_id``, among all other rows."""
    rows = usable(vectors).withColumn("asks", queries)
    index = cut(hashed(distinct_vectors(rows, k + 1)))
    asking = cut(index.where("asks").select("rep", "size", "vector", "hashes"))
    sizes = {r["size"]: r["n"] for r in index.groupBy("size").agg(F.count("*").alias("n")).collect()}
    start = [F.when(F.col("size") == s, first_depth(n)) for s, n in sizes.items()]
    first = asking.withColumn("depth", F.coalesce(*start, F.lit(0)).cast("int"))
    found = cut(search(index, first, k + 1))
    last = found.where(F.col("place") == k + 1).select("rep", F.col("score").alias("_last"))
    again = first.join(last, "rep", "left").withColumn("_ascent", ascent(F.col("_last")))
    again = again.where(F.col("_ascent") < F.col("depth")).drop("depth", "_last")
    again = cut(search(index, again.withColumnRenamed("_ascent", "depth"), k + 1))
    best = ranked(found.unionByName(again).drop("place"), k + 1)
    # A query's own row is among the k + 1 best or does not matter; then the others move up.
    ids = rows.where("asks").select(F.col("vec_id").alias("query_id"), "vector").distinct()
    ids = ids.join(index.where("asks").select("rep", "vector"), "vector").drop("vector")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        ids.join(best, "rep")
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id long, vector`` of the rows that take part."""
    finite = F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    some = F.exists("vector", lambda x: x != 0)
    return (
        only(vectors, "vec_id", "embedding")
        .select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & some)
    )


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """``rep, vector, ids, asks``: each vector once with its least ids; ``rep`` is the least."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    least = rows.groupBy("vector", "vec_id").agg(F.max("asks").alias("asks"))
    asked = least.where("asks").select("vector").distinct().withColumn("_asked", F.lit(True))
    return (
        least.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= most)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .join(asked, "vector", "left")
        .select(
            F.col("ids")[0].alias("rep"), "vector", "ids", F.coalesce("_asked", F.lit(False)).alias("asks")
        )
    )


@lru_cache(maxsize=8)
def _planes(size: int) -> np.ndarray:
    return np.random.default_rng(SEED + size).standard_normal((size, TREES * BITS))


def hashed(vectors: DataFrame) -> DataFrame:
    """Adds ``size`` and ``hashes``, the sign string of each tree as a number."""
    powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def work(rows: pa.RecordBatch) -> dict:
        hashes, sizes = [], []
        for vector in rows.column("vector").to_pylist():
            signs = (np.array(vector) @ _planes(len(vector)) > 0).reshape(TREES, BITS)
            hashes.append((signs @ powers).tolist())
            sizes.append(len(vector))
        kept = {c: rows.column(c) for c in ("rep", "vector", "ids", "asks")}
        return kept | {"size": sizes, "hashes": hashes}

    return in_batches(
        vectors,
        work,
        "rep long, vector array<double>, ids array<long>, asks boolean, size int, hashes array<long>",
    )


def first_depth(n: int) -> int:
    """Prefix length at which a block holds about ``BLOCK`` of ``n`` vectors."""
    return max(0, min(BITS, floor(log2(max(1.0, n / BLOCK)))))


def needed_depth(score: float | None) -> int:
    """The longest prefix that a vector of this cosine shares in a tree as often as asked."""
    if score is None or score <= -1:
        return 0
    agree = 1 - acos(min(1.0, score)) / pi
    least = 1 - (1 - RECALL) ** (1 / TREES)
    if agree >= 1:
        return BITS
    depth = min(BITS, floor(log(least) / log(agree))) if agree > 0 else 0
    return depth if TREES / 2**depth < MOST_WORK else 0


def ascent(score: Column) -> Column:
    """``needed_depth`` of a column: a step for every prefix length."""
    depth = F.lit(0)
    for d in range(1, BITS + 1):
        if TREES / 2**d < MOST_WORK:
            low, high = -1.0, 1.0
            for _ in range(60):  # the least cosine that needs no shorter prefix
                middle = (low + high) / 2
                low, high = (low, middle) if needed_depth(middle) >= d else (middle, high)
            depth = F.when(score >= high, d).otherwise(depth)
    return F.coalesce(depth, F.lit(0)).cast("int")


def _filed(df: DataFrame) -> DataFrame:
    """A row per tree; the root is that of the first tree alone."""
    tree = F.posexplode("hashes").alias("tree", "hash")
    out = df.select(*[c for c in df.columns if c != "hashes"], tree)
    out = out.where((F.col("depth") > 0) | (F.col("tree") == 0))
    prefix = F.call_function("shiftright", F.col("hash"), F.lit(BITS) - F.col("depth"))
    return out.withColumn("prefix", prefix).drop("hash")


def search(index: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest that share a prefix of the query's ``depth`` with it in a tree:
    ``rep`` of the query, ``vec_id``, ``score`` and ``place`` in order."""
    depths = [r["depth"] for r in queries.select("depth").distinct().collect()]  # BITS at most
    filed = _filed(index.withColumn("depth", F.explode(F.array(*map(F.lit, depths)).cast("array<int>"))))
    asked = _filed(queries)
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    blocks = (
        asked.groupBy(*_KEY)
        .agg(F.count("*").alias("_asking"))
        .join(filed.groupBy(*_KEY).agg(F.count("*").alias("_held")), _KEY)
        .select(*_KEY, parts("_asking", QUERY_PART).alias("_q"), parts("_held", PART).alias("_p"))
    )
    salt = lambda of: F.pmod(F.xxhash64("rep"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    held = filed.join(blocks, _KEY).withColumn("p", salt("_p")).withColumn("q", every("_q"))
    asked = asked.join(blocks, _KEY).withColumn("q", salt("_q")).withColumn("p", every("_p"))
    cell = [*_KEY, "p", "q"]
    pairs = (
        asked.select(*cell, "rep", "vector")
        .toDF(*cell, "rep", "vector")  # names of their own: both sides come from one table
        .groupBy(*cell)
        .cogroup(held.select(*cell, "rep", "vector", "ids").groupBy(*cell))
        .applyInPandas(
            lambda asking, there: _closest(asking, there, most),
            "rep long, vec_id long, score double",
        )
    )
    return ranked(pairs, most)


def ranked(pairs: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of each query; a vector may have been found in several trees."""
    order = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    )


def _closest(asking: pd.DataFrame, there: pd.DataFrame, most: int) -> pd.DataFrame:
    out: dict[str, list] = {"rep": [], "vec_id": [], "score": []}
    if len(asking) and len(there):
        a, b = np.stack(asking["vector"].to_numpy()), np.stack(there["vector"].to_numpy())
        norm_a, norm_b = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (a, b))
        scores = (a @ b.T) / norm_b
        count = min(most, len(b))
        for i, rep in enumerate(asking["rep"]):
            # Sums differ in the last digits with their order: all that could tie are kept.
            least = np.partition(scores[i], -count)[-count]
            near = np.flatnonzero(scores[i] >= least - 1e-9 * norm_a[i])
            exact = [(-cosine(a[i], b[j], norm_a[i], norm_b[j]), j) for j in near]
            for negative, j in sorted(exact, key=lambda e: (e[0], there["rep"].iloc[e[1]]))[:most]:
                for vec_id in there["ids"].iloc[j]:
                    out["rep"].append(rep)
                    out["vec_id"].append(vec_id)
                    out["score"].append(-negative)
    return pd.DataFrame(out).astype({"rep": "int64", "vec_id": "int64", "score": "float64"})


def cosine(a: np.ndarray, b: np.ndarray, norm_a: float, norm_b: float) -> float:
    return float((a * b).sum() / (norm_a * norm_b))
