"""Near duplicates by SimHash, compared in bit-sliced form.

A fingerprint has 64 bits; two documents are linked when theirs differ in ``RADIUS`` bits
or fewer, and a group is whatever links reach. Copies share a fingerprint, so comparison
works on distinct fingerprints.

Fingerprints that differ in at most two bits agree on at least six of their eight bytes, so
each is filed under all 28 choices of six bytes. A file holds at most 2**16 different
fingerprints however much data there is, because only two bytes are left to differ.

Within a file the bits are stored vertically: one 64-bit word holds the same bit of 64
fingerprints. A fingerprint is compared with 64 others at once: the word of every bit is
XORed with its own bit and added to carry-save counters of two bits, and the word is
abandoned as soon as all its lanes exceed the radius. A file reports the links as a star
around its least fingerprint of each group, never as pairs.

Defined results: a text without words (null, empty, white space) has fingerprint zero and
links like any other; a null ``doc_id`` takes part in groups, and a group without any other
id has a null ``component_id``; repeated rows give a row each; an empty table gives none.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.llm.base import Batches, in_batches, only, text_or_empty
from outlay.operators.resolve import component_labels
from outlay.session import cut

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Masks that keep six of the eight bytes.
MASKS = tuple(
    sum(0xFF << (8 * byte) for byte in kept) for kept in combinations(range(8), 8 - RADIUS)
)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingles' hashes, as an unsigned number."""
    words = text.encode().lower().split()  # bytes: only ASCII letters and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: max(1, len(words) - shingle + 1)].tolist()
    stops = (ends - 1)[min(shingle, len(words)) - 1 :].tolist()
    parts = [joined[a:b] for a, b in zip(starts, stops)]
    n = len(parts)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype="<u8", count=n)
    by_byte = hashes.view(np.uint8).reshape(n, 8)
    bits = 0
    for byte in range(8):
        counts = np.bincount(by_byte[:, byte], minlength=256) @ _BITS
        for bit in np.flatnonzero(2 * counts > n):
            bits |= 1 << (8 * byte + int(bit))
    return bits


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id long, fp long`` for every row."""

    def work(rows: pa.RecordBatch) -> dict:
        fps = [fingerprint(t) for t in rows.column("text").to_pylist()]
        return {"doc_id": rows.column("doc_id"), "fp": np.array(fps, dtype=np.uint64).view(np.int64)}

    texts = only(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return in_batches(texts, work, "doc_id long, fp long")


def components(prints: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``fingerprints``."""
    prints = cut(prints)
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = component_labels(near_links(distinct))
    labels = labels.select(F.col("norm").alias("fp"), F.col("component").alias("label"))
    roots = labels.select(F.col("label").alias("fp"), "label").distinct()
    members = labels.unionByName(roots).join(distinct, "fp")
    groups = members.groupBy("label").agg(F.min("least").alias("component_id"))
    linked = members.join(groups, "label").select("fp", "component_id")
    answer = distinct.join(linked, "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id")
    )
    return prints.join(answer, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_links(distinct: DataFrame) -> DataFrame:
    """Links ``a long, b long`` between different fingerprints that differ in ``RADIUS`` bits
    or fewer, as stars: they connect exactly what all such pairs would connect."""
    signed = [m - (1 << 64) if m >> 63 else m for m in MASKS]
    files = F.array(
        *[
            F.struct(F.lit(i).alias("file"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
            for i, m in enumerate(signed)
        ]
    )
    filed = distinct.select("fp", F.explode(files).alias("f")).select("f.file", "f.key", "fp")
    filed = filed.repartition("file", "key").sortWithinPartitions("file", "key")
    return filed.mapInArrow(_links_of_files, "a long, b long")


def _links_of_files(batches: Batches) -> Batches:
    """Batches sorted by file; a file may go on in the next batch."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        file, key = rows.column("file").to_numpy(), rows.column("key").to_numpy()
        if not len(file):
            continue
        first_of_last = int(np.flatnonzero((file != file[-1]) | (key != key[-1]))[-1:].sum() + 1)
        if (file[0], key[0]) == (file[-1], key[-1]):
            first_of_last = 0
        whole = rows.slice(0, first_of_last)
        rest = rows.slice(first_of_last).combine_chunks().to_batches()[0]
        if first_of_last:
            yield from _stars(whole)
    if rest is not None:
        yield from _stars(pa.Table.from_batches([rest]))


def _stars(rows: pa.Table) -> Batches:
    file, key = rows.column("file").to_numpy(), rows.column("key").to_numpy()
    fps = rows.column("fp").to_numpy()
    starts = np.append(True, (file[1:] != file[:-1]) | (key[1:] != key[:-1]))
    run = np.cumsum(starts) - 1
    many = np.bincount(run)[run] > 1
    fps, run = fps[many], run[many]
    if not len(fps):
        return
    a, b = pairs_within(fps.view(np.uint64), run)
    least = least_reachable(len(fps), a, b)
    linked = np.flatnonzero(least != np.arange(len(fps)))
    if len(linked):
        yield pa.RecordBatch.from_arrays(
            [pa.array(fps[linked]), pa.array(fps[least[linked]])], names=["a", "b"]
        )


def pairs_within(fps: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of the same run that differ in ``RADIUS`` bits or fewer; ``run``
    ascends."""
    n = len(fps)
    words = -(-n // 64)
    padded = np.zeros(words * 64, dtype="<u8")
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(words, 64, 8), axis=2, bitorder="little")
    planes = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
    planes = np.ascontiguousarray(planes).view("<u8").reshape(words, 64)
    run_end = np.searchsorted(run, run, side="right")
    found_a, found_b = [], []
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    query, ahead = np.arange(n), 0
    while len(query):
        word = query // 64 + ahead
        going = word * 64 < run_end[query]
        query, word = query[going], word[going]
        # Lanes that count: later than the query, and of its run.
        low = np.clip(query + 1 - word * 64, 0, 64)
        high = np.clip(run_end[query] - word * 64, 0, 64)
        over = ~(_below(high) & ~_below(low))
        lanes = _within(fps[query], planes, word, over, full)
        hit = lanes != 0
        for q, w, mask in zip(query[hit].tolist(), word[hit].tolist(), lanes[hit].tolist()):
            while mask:
                bit = mask & -mask
                found_a.append(q)
                found_b.append(w * 64 + bit.bit_length() - 1)
                mask ^= bit
        ahead += 1
    return np.array(found_a, dtype=np.int64), np.array(found_b, dtype=np.int64)


def _below(n: np.ndarray) -> np.ndarray:
    """Words whose ``n`` lowest bits are set, ``n`` from 0 to 64."""
    shifted = np.left_shift(np.uint64(1), np.minimum(n, 63).astype(np.uint64)) - np.uint64(1)
    return np.where(n == 64, np.uint64(0xFFFFFFFFFFFFFFFF), shifted)


def _within(fps, planes, word, over, full) -> np.ndarray:
    """Lanes of each word whose distance from its fingerprint is within the radius.

    ``ones`` and ``twos`` count differing bits up to three in carry-save form; ``over`` collects
    the lanes that have passed a radius of two and those that don't count.
    """
    out = np.zeros(len(fps), dtype=np.uint64)
    at = np.arange(len(fps))
    ones, twos = np.zeros_like(over), np.zeros_like(over)
    for bit in range(64):
        if bit % 4 == 0:
            alive = over != full
            if not alive.all():
                at, fps, word = at[alive], fps[alive], word[alive]
                ones, twos, over = ones[alive], twos[alive], over[alive]
            if not len(at):
                return out
        own = np.where((fps >> np.uint64(bit)) & np.uint64(1), full, np.uint64(0))
        differs = planes[word, bit] ^ own
        carry = ones & differs
        ones ^= differs
        over = over | (twos & carry)  # four
        twos ^= carry
        over = over | (ones & twos)  # three
    out[at] = ~over
    return out


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` positions the least one that pairs ``a, b`` connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def representatives(grouped: DataFrame) -> DataFrame:
    """The ``doc_id`` that stays of every group of ``components``: its least."""
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return grouped.where(own).select("doc_id").distinct()
