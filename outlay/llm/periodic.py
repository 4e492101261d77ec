"""Periodic runs of words: a stretch that repeats the same few words over and over.

A run is a stretch of consecutive words with smallest period ``q``, that is words ``q`` apart
are equal, which is at least ``LEAST_LENGTH`` words and ``LEAST_REPEATS`` periods long, and
which no neighbouring word continues.

Every word of a run stands in it ``LEAST_REPEATS`` times or more. So a word that is rarer
within its segment of the text is in no run, and splits the segment. The parts are counted
anew, until nothing splits any more (``surviving``); all segments of a batch of texts are
counted together. What is left is scanned lag by lag (``runs_in``). A lag below
``GRAM`` compares all words. A larger lag ``q`` looks at every ``q``-th place only: of such
places a run holds at least four in a row, and at the first three the next ``GRAM`` words are
the same. Where that is so the stretch is followed to both ends. Places within a run that is
known already belong to that run, as its period divides their lag, and aren't followed again.
So a segment of ``n`` words costs about ``n log n``, however long it is.

Defined results: a null, empty or white text has no words and no runs; rows without an id and
repeated rows give a row each; texts are taken whole, whatever their length; other columns
are left out; an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.llm.base import coded_words, in_batches, only, text_or_empty

LEAST_LENGTH = 6
LEAST_REPEATS = 4
#: Words that are compared at a place of the lag scan.
GRAM = 8
_TIMES = np.uint64(0x9E3779B185EBCA87)

Run = tuple[int, int, int]


def collapsed(docs: DataFrame) -> DataFrame:
    """``doc_id``, the runs as ``starts``, ``lengths`` and ``periods`` (word numbers from 0,
    by start, then period), and the text ``kept``: words joined by single spaces without
    those that a run holds beyond its first period."""

    def work(rows: pa.RecordBatch) -> dict:
        codes, n_words, known = coded_words(rows.column("text"))
        found = runs_of(codes, n_words)
        dropped = np.zeros(len(codes), dtype=bool)
        first = np.append(0, np.cumsum(n_words))
        for at, runs in found.items():
            for start, length, period in runs:
                dropped[first[at] + start + period : first[at] + start + length] = True
        ends = np.append(0, np.cumsum(~dropped))[first]
        words = known.take(pa.array(codes[~dropped]))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words)
        columns = {
            name: [[run[k] for run in found.get(at, ())] for at in range(len(n_words))]
            for k, name in enumerate(("starts", "lengths", "periods"))
        }
        return {"doc_id": rows.column("doc_id"), "kept": pc.binary_join(lists, " ")} | columns

    texts = only(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    schema = "doc_id long, starts array<long>, lengths array<long>, periods array<long>, kept string"
    return in_batches(texts, work, schema)


def runs_of(codes: np.ndarray, n_words: np.ndarray) -> dict[int, list[Run]]:
    """Runs of the texts that have any: ``codes`` are their words in a row."""
    first = np.append(0, np.cumsum(n_words))
    found: dict[int, list[Run]] = {}
    for start, end in zip(*surviving(codes, n_words)):
        at = int(np.searchsorted(first, start, "right")) - 1
        shift = int(start - first[at])
        runs = [(a + shift, length, q) for a, length, q in runs_in(codes[start:end])]
        if runs:
            found.setdefault(at, []).extend(runs)
    return {at: sorted(runs, key=lambda r: (r[0], r[2])) for at, runs in found.items()}


def surviving(codes: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments in which every word is frequent enough for a run.

    A segment that loses no word in a round is finished; the others are counted again.
    """
    place = np.arange(len(codes))
    segment = np.repeat(np.arange(len(n_words)), n_words)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(place):
        width = int(codes[place].max()) + 1
        _, kind, times = np.unique(segment * width + codes[place], return_inverse=True, return_counts=True)
        frequent = times[kind] >= LEAST_REPEATS
        size = np.bincount(segment)
        whole = (np.bincount(segment, ~frequent, len(size)) == 0) & (size >= LEAST_LENGTH)
        begins = np.append(True, segment[1:] != segment[:-1])
        done = begins & whole[segment]
        starts.append(place[done])
        ends.append(place[done] + size[segment[done]])
        left = frequent & ~whole[segment]
        place, segment = place[left], segment[left]
        if len(place):
            new = np.append(True, (np.diff(place) != 1) | (np.diff(segment) != 0))
            part = np.cumsum(new) - 1
            long = np.bincount(part)[part] >= LEAST_LENGTH
            place, segment = place[long], part[long]
            segment = np.cumsum(np.append(False, segment[1:] != segment[:-1])) if len(place) else segment
    start, end = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(start)
    return start[order], end[order]


def runs_in(words: np.ndarray) -> list[Run]:
    """Runs of one segment: start, length and smallest period."""
    n = len(words)
    found: dict[tuple[int, int], int] = {}
    covered = np.zeros(n, dtype=np.int64)  # the end of the known run, of those around a word, that goes furthest

    def add(start: int, end: int, lag: int) -> None:
        # A stretch that also has a smaller period is the run of that period.
        if end - start >= max(LEAST_LENGTH, LEAST_REPEATS * lag) and (start, end) not in found:
            found[start, end] = lag
            covered[start:end] = np.maximum(covered[start:end], end)

    for lag in range(1, min(GRAM, n // LEAST_REPEATS + 1)):
        same = np.concatenate(([False], words[lag:] == words[:-lag], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        long = edges[1::2] - edges[::2] >= max(LEAST_LENGTH, LEAST_REPEATS * lag) - lag
        for start, end in zip(edges[::2][long].tolist(), edges[1::2][long].tolist()):
            add(start, end + lag, lag)
    if n < LEAST_REPEATS * GRAM:
        return _listed(found)

    grams = np.zeros(n - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        grams = grams * _TIMES + words[k : n - GRAM + 1 + k].astype(np.uint64)
    for lag in range(GRAM, n // LEAST_REPEATS + 1):
        at = grams[::lag]
        same = at[1:] == at[:-1]
        hits = np.flatnonzero(same[1:] & same[:-1])
        if not len(hits):
            continue
        places = hits * lag
        places = places[covered[places] < places + 2 * lag].tolist()
        k = 0
        while k < len(places):
            start, end = _stretch(words, lag, places[k])
            add(start, end, lag)
            k = max(k + 1, bisect_left(places, end - 2 * lag + 1))
    return _listed(found)


def _listed(found: dict[tuple[int, int], int]) -> list[Run]:
    return [(start, end - start, lag) for (start, end), lag in found.items()]


def _stretch(words: np.ndarray, lag: int, at: int) -> tuple[int, int]:
    """Start and end of the stretch around ``at`` whose words are equal ``lag`` apart."""
    after = _first_apart(words[at:-lag], words[at + lag :])
    before = _first_apart(words[:at][::-1], words[lag : at + lag][::-1])
    return at - before, at + after + lag


def _first_apart(a: np.ndarray, b: np.ndarray) -> int:
    """Place of the first difference, looked for in pieces of doubling length."""
    at, step = 0, 64
    while at < len(a):
        apart = a[at : at + step] != b[at : at + step]
        if apart.any():
            return at + int(apart.argmax())
        at, step = at + step, 2 * step
    return len(a)


def digests(found: DataFrame) -> DataFrame:
    """Per row the number of runs, the run with the greatest length in periods (ties: smallest
    start, then period), and digests of all runs and of the kept words."""
    run = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"), F.col("periods").alias("period"))
    written = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    best = F.col("best")
    return found.withColumn("runs", run).withColumn("best", _longest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(written, ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def _longest(runs: Column) -> Column:
    """The first run with the greatest length in periods, compared by products of whole numbers."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(
        F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))),
        F.get(runs, F.lit(0)),
        lambda a, b: F.when(better(a, b), b).otherwise(a),
    )


def repeated(docs: DataFrame) -> DataFrame:
    """``docs`` in which a tenth of the texts end in a repetition of their own words.

    With ``h`` the CRC-32 of the decimal id, ``g`` its tenth rounded down and ``n`` words, a
    text whose ``h`` ends in 0 goes on from word ``a = g % n`` with the next ``1 + (n - a) div
    (3 + g % 8)`` words over and over. Rows without an id keep their text.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(text_or_empty(), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    g, n, a, p = F.floor(h / 10), F.size("words"), F.col("a"), F.col("p")
    rows = only(docs, "doc_id", "text").withColumn("words", F.when(chosen, words)).withColumn("g", g)
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    over = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), times)), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), a), over), " ")
    return rows.select("doc_id", F.when(a.isNotNull(), changed).otherwise(F.col("text")).alias("text"))
