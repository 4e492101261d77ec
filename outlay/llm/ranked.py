"""Ranked search for words: the documents that score highest for each of a set of items.

A term's weight ``w`` is ``floor(1000 * ln((2 N + 2) / (2 df + 1)))`` and a document's score sums
``w * ((10**9 tf) div (1000 tf + 20 m))`` over the item's distinct terms, with ``m = 50 + (50 n
N) div L``; see ``score_parts``. Everything but the logarithm is whole numbers.

Items are taken in blocks of bounded size, and a block is searched in all documents: counts
first (``statistics``), then scores. In the second pass a task goes through its documents in
slices. For the terms of the block it builds the posting lists of a slice, ordered by document,
and then searches every item:

- Its shorter lists are added up term by term. The sums, ordered by document, are then one more
  list, whose greatest sum bounds it like the greatest part of any list does.
- Documents are gone through in blocks of places. A block is skipped when the bounds that the
  lists have within it can't reach the least score that is still among the best. In
  the others the lists are taken from the greatest bound on until those left can't reach that
  score alone: only documents of these lists are candidates. A candidate's parts in the lists
  left are looked up by skipping ahead to it, as long as it can still get there.

The least score to reach comes from all documents the task has seen, so later slices skip more.
A task gives ``k`` documents an item at most, and the best of those are picked in two steps.

Defined results: a null text has no terms; documents without terms aren't counted in ``N``; a
null item, or one whose terms no document has, gives no rows; items of one id and text are
one; items of one id and different texts are ranked each on its own; rows without an id are
found like others, behind the equal scores of those with one (an id of 2^63 - 1 counts as
missing too); repeated rows are documents of
their own; no score of 0 is given; texts are taken whole; empty tables give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.llm.base import Batches, _slices, coded_words, only, text_or_empty
from outlay.operators.common import ranked

BEST = 50
#: Bytes of item texts that are searched for at a time.
BLOCK_BYTES = 2_000_000
#: Lists of at most this share of the documents of a slice are added up first.
SHORT = 16
#: Documents gone through at a time.
PLACES = 1024
#: Groups in which the best of all tasks are picked first.
GROUPS = 64
_LAST = np.iinfo(np.int64).max  # stands for a missing id

_APART = bytes(b if chr(b).isalnum() or b > 0x7F else 0x20 for b in range(256)).lower()


def as_terms(texts: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case and a space for every ASCII character that is neither a
    letter nor a digit, so that the terms are the words."""
    if not len(texts):
        return texts
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    changed = (data.to_pybytes()[ends[0] : ends[-1]] if data else b"").translate(_APART)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(changed))


class Postings:
    """For the terms asked: which documents of a slice hold them, how often, and the number of
    terms of each document."""

    def __init__(self, texts: pa.Array, asked: dict[str, int]):
        codes, self.n_terms, known = coded_words(as_terms(texts))
        number = np.fromiter((asked.get(t, -1) for t in known.to_pylist()), np.int64, len(known))
        term = number[codes]
        doc = np.repeat(np.arange(len(texts)), self.n_terms)[term >= 0]
        pairs, times = np.unique(term[term >= 0] * max(len(texts), 1) + doc, return_counts=True)
        self.terms, starts = np.unique(pairs // max(len(texts), 1), return_index=True)
        self.ends = np.append(starts, len(pairs))
        self.docs, self.times = pairs % max(len(texts), 1), times


def statistics(texts: DataFrame, asked: dict[str, int]) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, terms of all documents, and for each term asked the documents
    that hold it. A task adds up before anything is sent."""

    def count(batches: Batches) -> Batches:
        docs, terms, held = 0, 0, np.zeros(len(asked), dtype=np.int64)
        for batch in batches:
            for part in _slices(batch):
                found = Postings(part.column("text"), asked)
                docs += int((found.n_terms > 0).sum())
                terms += int(found.n_terms.sum())
                held[found.terms] += np.diff(found.ends)
        at = np.flatnonzero(held)
        numbers = [pa.array(np.append([-2, -1], at)), pa.array(np.append([docs, terms], held[at]))]
        yield pa.RecordBatch.from_arrays(numbers, names=["term", "n"])

    rows = texts.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r["term"]: r["n"] for r in rows.collect()}
    return counts.pop(-2, 0), counts.pop(-1, 0), counts


def score_parts(weight: int, times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * times) // (1000 * times + 20 * m))


class Best:
    """The ``k`` best documents found for an item so far: highest score, then least id."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


class List:
    """Documents of a slice and their parts of a score, in the order of their places."""

    def __init__(self, docs: np.ndarray, parts: np.ndarray, n_docs: int):
        self.docs, self.parts, self.blocks = docs, parts, -(-n_docs // PLACES)

    @cached_property
    def fences(self) -> np.ndarray:
        return np.searchsorted(self.docs, np.arange(self.blocks + 1) * PLACES)

    @cached_property
    def bounds(self) -> np.ndarray:
        """The greatest part within each block of places."""
        out = np.zeros(self.blocks, dtype=np.int64)
        held = np.flatnonzero(np.diff(self.fences))
        if len(held):
            out[held] = np.maximum.reduceat(self.parts, self.fences[held])
        return out

    def within(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.fences[block], self.fences[block + 1])
        return self.docs[own], self.parts[own]


def _summed(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    docs, kind = np.unique(np.concatenate([d for d, _ in lists]), return_inverse=True)
    sums = np.zeros(len(docs), dtype=np.int64)
    np.add.at(sums, kind, np.concatenate([p for _, p in lists]))
    return docs, sums


def search(lists: list[List], n_docs: int, ids: np.ndarray, best: Best) -> int:
    """Take the documents of ``lists`` into ``best``; gives the number of parts looked at."""
    short = [x for x in lists if SHORT * len(x.docs) <= n_docs]
    looked = sum(len(x.docs) for x in short)
    all_lists = [x for x in lists if SHORT * len(x.docs) > n_docs]
    if short:
        all_lists.append(List(*_summed([(x.docs, x.parts) for x in short]), n_docs))
    bounds = np.array([x.bounds for x in all_lists])
    for block in np.flatnonzero(bounds.sum(axis=0) >= best.least).tolist():
        order = np.argsort(-bounds[:, block], kind="stable")
        ahead = np.append(np.cumsum(bounds[order, block][::-1])[::-1], 0)
        if ahead[0] < best.least:
            continue
        # Lists from the first whose bounds, with those after it, stay below the least score.
        first = int((ahead >= best.least).sum())
        lead = [all_lists[i].within(block) for i in order[:first]]
        looked += sum(len(d) for d, _ in lead)
        docs, scores = _summed(lead)
        for k in range(first, len(order)):
            near = scores + ahead[k] >= best.least
            docs, scores = docs[near], scores[near]
            held, parts = all_lists[order[k]].within(block)
            if not len(docs) or not len(held):
                continue
            at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            scores = scores + np.where(held[at] == docs, parts[at], 0)
            looked += len(docs)
        good = scores >= best.least
        best.add(scores[good], ids[docs[good]])
    return looked


def _searched(texts: DataFrame, asked: dict[str, int], items: list[list[int]], k: int) -> DataFrame:
    """``item, doc_id, score``: the ``k`` best of every task."""
    n_docs, n_terms, held = statistics(texts, asked)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in held.items()}

    def work(batches: Batches) -> Batches:
        best = [Best(k) for _ in items]
        for batch in batches:
            for part in _slices(batch):
                found = Postings(part.column("text"), asked)
                m = 50 + (50 * found.n_terms * n_docs) // max(n_terms, 1)
                ids = part.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
                parts = {}
                for t, a, b in zip(found.terms.tolist(), found.ends[:-1], found.ends[1:]):
                    docs = found.docs[a:b]
                    parts[t] = List(docs, score_parts(weight[t], found.times[a:b], m[docs]), len(ids))
                for item, own in zip(items, best):
                    lists = [parts[t] for t in item if t in parts]
                    if lists:
                        search(lists, len(ids), ids, own)
        for at, own in enumerate(best):
            missing = own.ids == _LAST
            columns = [np.full(len(own.ids), at), own.ids, own.scores]
            arrays = [pa.array(c, pa.int64(), mask=missing if c is own.ids else None) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=["item", "doc_id", "score"])

    return texts.mapInArrow(work, "item long, doc_id long, score long")


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[DataFrame]:
    """The items in blocks of about so many bytes of text."""
    size = items.agg(F.sum(F.octet_length("text") + F.lit(16)).alias("n")).first()["n"]
    blocks = max(1, -(-(size or 0) // block_bytes))
    for block in range(blocks):
        yield items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)


def search_items(docs: DataFrame, items: DataFrame, k: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents of each item."""
    spark = docs.sparkSession
    texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    items = only(items, "item_id", "text").select("item_id", text_or_empty().alias("text")).distinct()
    out = None
    for block in _blocks(items, block_bytes):
        rows = block.orderBy("item_id", "text").collect()
        terms = [sorted(set(t.split())) for t in as_terms(pa.array([r["text"] for r in rows], pa.string())).to_pylist()]
        asked = {t: i for i, t in enumerate(sorted({t for own in terms for t in own}))}
        found = _searched(texts, asked, [[asked[t] for t in own] for own in terms], k)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        group = F.pmod(F.xxhash64("doc_id", "score"), F.lit(GROUPS))
        found = ranked(found.withColumn("_group", group), ["item", "_group"], order, k).drop("rank", "_group")
        found = ranked(found, ["item"], order, k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item long, item_id long")
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


#: The same rows of ``op13_ranked_search``: every score, then the best of each item.
ORACLE_SQL = f"""
WITH term AS (
  SELECT row, doc_id, unnest(regexp_extract_all(lowered, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id,
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
        FROM documents)),
whole AS (SELECT count(DISTINCT row) AS n_docs, count(*) AS n_terms FROM term),
size AS (SELECT row, 50 + (50 * count(*) * any_value(n_docs)) // any_value(n_terms) AS m
         FROM term, whole GROUP BY row),
posting AS (SELECT row, doc_id, term, count(*) AS tf FROM term GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
           FROM posting, whole GROUP BY term),
item AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, text, row, any_value(doc_id) AS doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM item JOIN posting USING (term) JOIN weight USING (term) JOIN size USING (row)
  GROUP BY item_id, text, row)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank
      FROM scored WHERE score > 0) WHERE rank <= {BEST}
"""
