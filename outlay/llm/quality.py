"""Quality rules: robust multivariate outliers per language and source.

Every text gets counts and seven transformed statistics. Texts that pass the base rules are
judged by the minimum-covariance-determinant (MCD) estimate of their language and source:
the location and scatter of the three quarters of texts that lie closest together, found by
concentration steps. A text is rejected when its squared Mahalanobis distance passes
``CUTOFF``. Every language and source has an estimate of its own, however small it is.

The steps run on all texts as aggregations. Statistics are whole numbers on a grid, so sums
are exact and reruns agree whatever the order. A step bins the distances of a stratum on a
logarithmic scale and sums the moments of every bin, on the map side first; the bins up to
the one that holds the needed share give the next estimate. Only bins reach a single task,
and their number per stratum is bounded, so a source with a third of all rows is no harder
than any other.

An estimate from few texts is uncertain, so in the end each is drawn towards that of its
language by the weight of ``PRIOR_ROWS`` texts, and a language's towards that of all texts. The
pull fades smoothly with the number of texts, and no number changes the rule. The scatter
also gets what lies between the two locations, so a source whose own style is far from its
language's isn't judged by the latter's narrow scatter.

Text that is mostly alike in a statistic (no symbols at all, say) would leave the scatter
singular, and then any text that differs at all would lie infinitely far away. So the square
of ``TOLERANCE`` is added to each variance: a step of that size is never remarkable alone.

Defined results: a null or empty text has zero counts and fails the base rules; null
languages and sources are groups of their own; repeated rows are judged alike; an empty
table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.llm.base import coded_words, in_batches, only, text_or_empty
from outlay.operators.common import join_rules
from outlay.session import cut

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Bytes of text whose words a task holds at a time.
SLICE = 4_000_000
#: Share of texts that an estimate rests on, and the steps taken from the first estimate.
SHARE = 0.75
STEPS = 4
#: Texts that the estimate of the next wider group counts for.
PRIOR_ROWS = 100.0
#: Squared distance beyond which a text is an outlier.
CUTOFF = 60.0
#: Statistics lie between 0 and 1 on a grid of this many steps.
GRID = 4096
#: Bins of squared distance for each doubling of it.
BINS = 8

#: Each statistic and the least spread it is judged by.
TOLERANCE = {
    "word_length": 0.015,
    "symbols": 0.03,
    "capitals": 0.05,
    "punctuation": 0.05,
    "digits": 0.06,
    "repeated_lines": 0.12,
    "repeated_words": 0.12,
}
NAMES = tuple(TOLERANCE)
P = len(NAMES)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_UPPER, _LOWER, _DIGIT, _PUNCTUATION, _OTHER = range(5)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Character class of every code point of the basic plane, one more for the rest."""
    kinds = {"Lu": _UPPER, "Lt": _UPPER, "Ll": _LOWER, "Nd": _DIGIT}
    table = np.full(0x10001, _OTHER, dtype=np.uint8)
    for point in range(0x10000):
        kind = unicodedata.category(chr(point))
        table[point] = kinds.get(kind, _PUNCTUATION if kind[0] in "PS" else _OTHER)
    return table


def repeated_in_windows(codes: np.ndarray, size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    n = len(codes) - size + 1
    if n < 2:
        return 0
    width = int(codes.max()) + 1
    window = codes[:n].astype(np.int64)
    for k in range(1, size):
        if (int(window.max()) + 1) * width >= 1 << 63:
            _, window = np.unique(window, return_inverse=True)
        window = window * width + codes[k : k + n]
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(codes), dtype=bool)
    for k in range(size):
        covered[k : k + n] |= again
    return int(covered.sum())


def _line_counts(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def _statistics(text: str, words: int, word_chars: int, symbols: int, repeated: int) -> list[float]:
    lines, dup_lines = _line_counts(text)
    points = np.minimum(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), 0x10000)
    kinds = np.bincount(_classes()[points], minlength=5).tolist()
    letters = max(1, kinds[_UPPER] + kinds[_LOWER])
    chars = max(1, word_chars)
    return [
        np.log1p(word_chars / max(1, words)) / 8,
        np.sqrt(symbols / chars),
        np.sqrt(kinds[_UPPER] / letters),
        np.sqrt(kinds[_PUNCTUATION] / chars),
        np.sqrt(kinds[_DIGIT] / chars),
        np.sqrt(dup_lines / max(1, lines)),
        np.sqrt(repeated / max(1, words)),
    ]


def text_statistics(docs: DataFrame) -> DataFrame:
    """Counts and statistics of every row: ``doc_id``, ``lang``, ``source``, ``content`` (a
    hash that tells rows with one id apart), ``COUNTS``, and a whole number per statistic."""

    def work(rows: pa.RecordBatch) -> dict:
        texts = rows.column("text")
        codes, n_words, _ = coded_words(texts)
        out: dict = {c: [] for c in (*COUNTS, *NAMES)}
        at = 0
        for text, n in zip(texts.to_pylist(), n_words.tolist()):
            own = codes[at : at + n]
            at += n
            word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
            symbols = sum(map(text.count, SYMBOLS))
            repeated = repeated_in_windows(own)
            counts = (n, word_chars, symbols, _line_counts(text)[1], repeated)
            stats = _statistics(text, n, word_chars, symbols, repeated)
            grid = np.round(np.clip(stats, 0, 1) * GRID).astype(int).tolist()
            for name, value in zip(out, (*counts, *grid)):
                out[name].append(value)
        return out | {c: rows.column(c) for c in ("doc_id", "lang", "source", "content")}

    schema = ", ".join(
        ["doc_id long", "lang string", "source string", "content long"]
        + [f"{c} long" for c in COUNTS]
        + [f"{c} long" for c in NAMES]
    )
    texts = only(docs, "doc_id", "lang", "source", "text").select(
        F.col("doc_id").cast("long"),
        F.col("lang").cast("string"),
        F.col("source").cast("string"),
        content().alias("content"),
        text_or_empty().alias("text"),
    )
    return in_batches(texts, work, schema, SLICE)


def content() -> Column:
    """Rows with the same value have the same text, language and source, so one verdict."""
    return F.xxhash64("lang", "source", "text")


def base_failed() -> Column:
    often = 100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    return (F.col("n_words") < LEAST_WORDS) | often


def judged(stats: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``text_statistics`` with ``base_failed``, ``distance`` (squared, null for texts that
    fail the base rules) and ``kept``."""
    stats = cut(_with_strata(stats))
    sound = stats.where(~F.col("base_failed"))
    strata = F.explode(F.array("stratum", "_wider", F.lit(ALL)))
    fit = sound.select(strata.alias("stratum"), *NAMES)
    estimate = cut(_first_estimate(fit))
    for _ in range(STEPS):
        estimate = cut(_concentrated(fit, estimate))
    wider = sound.select("stratum", "_wider").distinct()
    languages = wider.select(F.col("_wider").alias("stratum"), F.lit(ALL).alias("_wider")).distinct()
    # One row: a join by its constant key would pair all partitions with each other.
    of_all = F.broadcast(estimate.where(F.col("stratum") == ALL))
    by_language = _drawn(estimate.join(languages, "stratum"), of_all)
    estimate = cut(_drawn(estimate.join(wider, "stratum"), by_language))
    stats = stats.drop("_wider")
    measured = join_rules(stats.where(~F.col("base_failed")), estimate, ["stratum"])
    measured = measured.withColumn("distance", _distance())
    out = [*stats.columns, "distance"]
    failed = stats.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
    return measured.select(*out).unionByName(failed).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    )


def _with_strata(stats: DataFrame) -> DataFrame:
    """Adds ``base_failed``, ``stratum`` (language and source) and ``_wider`` (the language)."""
    own = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    wider = F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})
    return stats.withColumns({"base_failed": base_failed(), "stratum": own, "_wider": wider})


def _drawn(own: DataFrame, wider: DataFrame) -> DataFrame:
    """Estimates drawn towards those of their wider group, named in ``_wider``."""
    names = [f.split(" ")[0] for f in ESTIMATE.split(", ")]
    both = own.join(wider.select(*[F.col(c).alias(f"w_{c}") for c in names]), F.col("_wider") == F.col("w_stratum"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [_estimate_row(*_blend(r, PRIOR_ROWS)) for _, r in frame.iterrows()]
            yield pd.concat(rows) if rows else pd.DataFrame(columns=names)

    return both.mapInPandas(draw, ESTIMATE)


def _blend(row: pd.Series, prior: float) -> tuple[str, float, np.ndarray, np.ndarray]:
    """Of a row with an estimate and the wider one (``w_``): stratum, texts, location, scatter."""
    (mean, scatter), (wide_mean, wide_scatter) = _moments(row, ""), _moments(row, "w_")
    own = row["n"] / (row["n"] + prior)
    apart = np.outer(mean - wide_mean, mean - wide_mean)
    return (
        row["stratum"],
        row["n"],
        own * mean + (1 - own) * wide_mean,
        own * scatter + (1 - own) * wide_scatter + own * (1 - own) * apart,
    )


def _moments(row: pd.Series, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    """Location and scatter of a stored estimate."""
    mean = np.array([row[f"{prefix}m{i}"] for i in range(P)])
    inverse = np.zeros((P, P))
    for i in range(P):
        for j in range(i, P):
            inverse[i, j] = inverse[j, i] = row[f"{prefix}s{i}_{j}"] / (1 if i == j else 2)
    return mean, np.linalg.inv(inverse) - _floor()


#: The stratum of all texts, and the columns of an estimate.
ALL = ""
ESTIMATE = (
    "stratum string, n double, "
    + ", ".join(f"m{i} double" for i in range(P))
    + ", "
    + ", ".join(f"s{i}_{j} double" for i in range(P) for j in range(i, P))
)


def _first_estimate(fit: DataFrame) -> DataFrame:
    """Medians and quartile distances of each statistic, from counts of its grid values."""
    pairs = [F.struct(F.lit(i).alias("dim"), F.col(c).alias("value")) for i, c in enumerate(NAMES)]
    values = F.explode(F.array(*pairs))
    counted = (
        fit.select("stratum", values.alias("v"))
        .groupBy("stratum", "v.dim", "v.value")
        .agg(F.count("*").alias("n"))
    )

    def quartiles(rows: pd.DataFrame) -> pd.DataFrame:
        middle, variance = np.zeros(P), np.zeros(P)
        for i, own in rows.groupby("dim"):
            own = own.sort_values("value")
            share = own["n"].cumsum().to_numpy() / own["n"].sum()
            low, mid, high = own["value"].to_numpy()[np.searchsorted(share, (0.25, 0.5, 0.75))]
            middle[i] = mid
            variance[i] = ((high - low) / 1.349) ** 2
        n = float(rows.loc[rows["dim"] == 0, "n"].sum())
        return _estimate_row(rows["stratum"].iloc[0], n, middle / GRID, np.diag(variance / GRID**2))

    return counted.groupBy("stratum").applyInPandas(quartiles, ESTIMATE)


def _concentrated(fit: DataFrame, estimate: DataFrame) -> DataFrame:
    """The estimate of the texts closest to the last one."""
    bin_of = F.floor(BINS * F.log2(_distance() + F.lit(2.0**-8))).cast("int")
    sums = [F.sum(c).alias(f"t{i}") for i, c in enumerate(NAMES)]
    sums += [
        F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"t{i}_{j}")
        for i in range(P)
        for j in range(i, P)
    ]
    binned = (
        join_rules(fit, estimate, ["stratum"])
        .select("stratum", bin_of.alias("bin"), *NAMES)
        .groupBy("stratum", "bin")
        .agg(F.count("*").alias("n"), *sums)
    )

    def closest(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        reached = rows["n"].cumsum().to_numpy()
        last = int(np.searchsorted(reached, SHARE * reached[-1]))
        own = rows.iloc[: last + 1]
        n = float(reached[last])
        mean = np.array([own[f"t{i}"].sum() for i in range(P)]) / n / GRID
        scatter = np.zeros((P, P))
        for i in range(P):
            for j in range(i, P):
                product = own[f"t{i}_{j}"].sum() / n / GRID**2 - mean[i] * mean[j]
                scatter[i, j] = scatter[j, i] = product
        whole = float(reached[-1])
        return _estimate_row(rows["stratum"].iloc[0], whole, mean, scatter * consistency(n / whole))

    return binned.groupBy("stratum").applyInPandas(closest, ESTIMATE)


@lru_cache(maxsize=None)
def _chi_squared(p: int) -> tuple[np.ndarray, np.ndarray]:
    """A grid and the distribution function of chi-squared on it."""
    x = np.linspace(0, 40 + 10 * p, 200_001)
    density = np.append(0, x[1:] ** (p / 2 - 1)) * np.exp(-x / 2)
    total = np.cumsum(density)
    return x, total / total[-1]


def consistency(share: float) -> float:
    """By how much the scatter of the closest ``share`` of a normal sample is too small."""
    x, within = _chi_squared(P)
    quantile = x[min(np.searchsorted(within, share), len(x) - 1)]
    wider, more = _chi_squared(P + 2)
    return share / float(more[np.searchsorted(wider, min(quantile, wider[-1]))])


def _floor() -> np.ndarray:
    return np.diag(np.array(list(TOLERANCE.values())) ** 2)


def _estimate_row(stratum: str, n: float, mean: np.ndarray, scatter: np.ndarray) -> pd.DataFrame:
    inverse = np.linalg.inv(scatter + _floor())
    row = [stratum, n, *mean]
    row += [float(inverse[i, j]) * (1 if i == j else 2) for i in range(P) for j in range(i, P)]
    return pd.DataFrame([row], columns=[part.split(" ")[0] for part in ESTIMATE.split(", ")])


def _distance() -> Column:
    """Squared Mahalanobis distance; the inverse scatter is stored with its off-diagonal
    entries doubled."""
    off = [F.col(c) / GRID - F.col(f"m{i}") for i, c in enumerate(NAMES)]
    terms = [off[i] * off[j] * F.col(f"s{i}_{j}") for i in range(P) for j in range(i, P)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.greatest(total, F.lit(0.0))
