"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. A text is cut
into windows of a few words, each is compressed with both dictionaries, and the bytes that
the toxic one saves tell how close the window is to toxic text. The highest saving, the
windows with a saving and their sum are calibrated to a score by logistic regression.

A toxic document is ordinary text with some toxic passages, and so the toxic dictionary must
be trained on what sets it apart: stretches of words whose letter groups occur in far more
toxic than ordinary documents of the sample. It is completed by the ordinary dictionary,
nearer to the window, so that ordinary words cost the same in both and only toxic passages
differ.

Dictionaries and calibration are fitted on at most ``MOST_TOXIC`` and ``MOST_ORDINARY``
labelled documents, chosen by a hash of the id. Calibration uses documents that the
dictionaries have not seen. Scoring reads every whole text.

Defined results: a null or empty text is one empty window without a saving; rows that share
an id are scored each; without labels of both kinds every score is the share of toxic labels
(0.0 if there are none); an empty table gives no rows.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.llm.base import in_batches, only, text_or_empty

#: Bound of the labelled sample.
MOST_TOXIC = 3000
MOST_ORDINARY = 6000
WINDOW_WORDS = 9
GRAM = 5
#: Toxic documents that a letter group must occur in, at least and as a share of them, and by
#: how much more often there than in ordinary ones.
LEAST_DOCUMENTS = 3
LEAST_SHARE = 0.02
LEAST_ODDS = 8.0
ORDINARY_BYTES = 32_768
TOXIC_BYTES = 16_384


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def windows(text: str, size: int = WINDOW_WORDS) -> list[bytes]:
    words = text.lower().split()
    return [(" " + " ".join(words[i : i + size]) + " ").encode() for i in range(0, len(words), size)] or [b""]


def _grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)]


def fit(texts: list[str], toxic: list[int], seed: int = 7) -> Model:
    """Fit on labelled texts: dictionaries on two thirds of them, calibration on the rest."""
    share = sum(toxic) / max(1, len(toxic))
    if not 0 < share < 1:
        return Model(b"", b"", (log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0, 0.0, 0.0))
    order = list(range(len(texts)))
    random.Random(seed).shuffle(order)
    train = [i for n, i in enumerate(order) if n % 3]
    rest = [i for n, i in enumerate(order) if n % 3 == 0]
    ordinary, bad = _dictionaries(
        [texts[i] for i in train if not toxic[i]], [texts[i] for i in train if toxic[i]], seed
    )
    uncalibrated = Model(ordinary, bad, ())
    x = np.array([features(texts[i], uncalibrated) for i in rest])
    y = np.array([toxic[i] for i in rest], dtype=float)
    return Model(ordinary, bad, _logistic(x, y))


def _dictionaries(ordinary: list[str], bad: list[str], seed: int) -> tuple[bytes, bytes]:
    pick = random.Random(seed)
    sample = []
    for text in ordinary:
        own = windows(text)
        sample += pick.sample(own, min(20, len(own)))
    common = _trained(sample, ORDINARY_BYTES)
    telling = _telling(ordinary, bad)
    stretches: Counter[str] = Counter()
    for text in bad:
        for word in sorted(set(text.lower().split())):
            stretches.update(_stretches(word, telling))
    often = [s for s, n in stretches.most_common() if n >= LEAST_DOCUMENTS]
    # The most frequent last: nearest to the window.
    content = "".join(reversed(often)).encode()[-TOXIC_BYTES:]
    return common, content + common


def _telling(ordinary: list[str], bad: list[str]) -> set[str]:
    """Letter groups that occur in far more toxic than ordinary documents."""
    found = []
    for texts in (bad, ordinary):
        counts: Counter[str] = Counter()
        for text in texts:
            counts.update({g for w in set(text.lower().split()) for g in _grams(w)})
        found.append(counts)
    in_bad, in_ordinary = found
    odds = LEAST_ODDS * (len(bad) + 1) / (len(ordinary) + 1)
    least = max(LEAST_DOCUMENTS, LEAST_SHARE * len(bad))
    return {g for g, n in in_bad.items() if n >= least and n >= odds * (in_ordinary[g] + 0.5)}


def _stretches(word: str, telling: set[str]) -> list[str]:
    """Parts of a word, with the spaces around it, that telling letter groups cover."""
    padded = f" {word} "
    covered, out = [False] * len(padded), []
    for i, gram in enumerate(_grams(word)):
        if gram in telling:
            covered[i : i + GRAM] = [True] * GRAM
    start = None
    for i, c in enumerate([*covered, False]):
        if c and start is None:
            start = i
        elif not c and start is not None:
            out.append(padded[start:i])
            start = None
    return out


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on samples; too few to train on serve as they are."""
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


@lru_cache(maxsize=4)
def compressor(content: bytes) -> zstd.ZstdCompressor:
    """For windows: no frame header to speak of, matches from four bytes on."""
    parameters = zstd.ZstdCompressionParameters(
        strategy=zstd.STRATEGY_GREEDY,
        min_match=4,
        window_log=18,
        hash_log=15,
        chain_log=15,
        search_log=4,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
        format=zstd.FORMAT_ZSTD1_MAGICLESS,
    )
    dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstd.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def features(text: str, model: Model) -> tuple[float, float, float, float]:
    """Highest saving, windows with a saving, their sum, and the number of windows, on a
    logarithmic scale."""
    plain, bad = compressor(model.ordinary).compress, compressor(model.toxic).compress
    own = windows(text)
    saved = [s for w in own if (s := len(plain(w)) - len(bad(w))) > 0]
    return (
        float(max(saved, default=0)),
        float(np.log1p(len(saved))),
        float(np.log1p(sum(saved))),
        float(np.log(len(own))),
    )


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> tuple[float, ...]:
    """Weights, intercept first, by Newton's method with a ridge."""
    design = np.column_stack([np.ones(len(x)), x])
    weights = np.zeros(design.shape[1])
    ridge = np.diag([0.0] + [penalty] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        curve = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + ridge
        step = np.linalg.solve(curve, design.T @ (y - p) - ridge @ weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(w) for w in weights)


def score(text: str, model: Model) -> float:
    if not model.ordinary:
        value = model.weights[0]
    else:
        value = model.weights[0] + float(np.dot(model.weights[1:], features(text, model)))
    return float(1 / (1 + np.exp(-np.clip(value, -30, 30))))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled documents that are not held out."""
    marked = only(labels, "doc_id", "toxic").where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ranked = F.xxhash64("doc_id")
    chosen = None
    for value, most in ((1, MOST_TOXIC), (0, MOST_ORDINARY)):
        part = marked.where(F.col("toxic") == value).orderBy(ranked, "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most MOST_TOXIC + MOST_ORDINARY rows of an id and a label.
    sample = (
        only(docs, "doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "toxic", text_or_empty().alias("text"))
        .dropDuplicates(["doc_id"])
        .orderBy("doc_id")
        .collect()
    )
    return fit([r["text"] for r in sample], [int(r["toxic"]) for r in sample])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""

    def work(rows: pa.RecordBatch) -> dict:
        scores = [score(text, model) for text in rows.column("text").to_pylist()]
        return {"doc_id": rows.column("doc_id"), "score": scores}

    texts = only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long"), text_or_empty().alias("text")
    )
    return in_batches(texts, work, "doc_id long, score double")
