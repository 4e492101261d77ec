"""Secrets in texts: fixed forms, and strings that pass a battery of randomness tests.

Three fixed forms are always reported: assignments to names such as ``password``, access
key ids, and long runs of hexadecimal digits. Other secrets have no form except that they
look random. What the fixed forms leave of a run of letters, digits and the marks of base 64
is tested as a whole, and so is every part between marks, since keys often have a prefix of
another encoding or stand side by side. A string is given the narrowest encoding that fits
(digits alone are numbers and have none), and is tested for randomness in it:

* chi-squared, whether all symbols of the alphabet are alike frequent, and likewise its
  digits, capitals and small letters;
* runs above and below the middle of the alphabet;
* correlation of each symbol with the next.

Fisher's method combines the tests to one probability of being random text. Among random
strings it is uniform between 0 and 1, among others close to 0, so the number of random
strings of a stratum (an encoding and a class of lengths) is twice the number beyond one
half. Each stratum gets the lowest cutoff at which no more than ``FALSE_SHARE`` of what
passes is expected not to be random. Short strings of wide alphabets overlap more with
ordinary ones, and so get a higher cutoff by themselves.

Strata are counted over the whole corpus; a few hundred counts reach the driver. Every stratum
is completed, by the same rule at every count, by the strings of other lengths in its encoding
(the fewer it has itself and the nearer they are, the more they count) and by ``PRIOR`` random
strings. Of a whole and its parts, the kind that holds the most random string is reported if
it passes, and else the other.

Defined results: null and empty texts have no spans; repeated rows count repeatedly, as
more evidence of the same; an empty table gives no rows.
"""

from __future__ import annotations

import re
from math import erfc, exp, log, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.llm.base import in_batches, only, text_or_empty
from outlay.session import cut

# The fixed forms, their order and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_LENGTH = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LENGTH = 20
HEX = re.compile(r"[0-9a-f]+")
HEX_LENGTH = 24
_NAMES = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)

#: Shortest string that is tested.
LEAST_LENGTH = 20
FALSE_SHARE = 0.05
#: Least cutoff.
PLAIN_CUTOFF = 0.01
#: Random strings that every stratum has to begin with.
PRIOR = 20.0
#: Weight of the next length class, and the count at which other lengths count half as much.
NEIGHBOUR, HALF = 0.5, 40.0
#: Steps in which probabilities are counted.
STEPS = 100
LENGTH_CLASSES = (20, 24, 32, 48, 64, 128)

_DIGITS = "0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
ENCODINGS = {
    "lower": _LOWER,
    "upper": _UPPER,
    "hex": _DIGITS + "abcdef",
    "hex_upper": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "base36_upper": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _DIGITS + _UPPER + _LOWER + "+/",
    "base64_url": _DIGITS + _UPPER + _LOWER + "-_",
}
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST_LENGTH)
_PART = re.compile(r"[A-Za-z0-9]{%d,}" % LEAST_LENGTH)
_MARKS = "+/_-"
_SETS = {name: frozenset(symbols) for name, symbols in ENCODINGS.items()}
_GROUPS = (frozenset(_DIGITS), frozenset(_UPPER), frozenset(_LOWER))
_NUMBER = _GROUPS[0] | frozenset(_MARKS)


def encoding_of(text: str) -> str | None:
    """The narrowest encoding of a string; none if it has no letter."""
    found = set(text)
    if found <= _NUMBER:
        return None
    return next((name for name, symbols in _SETS.items() if found <= symbols), None)


def chi_squared_tail(x: float, freedom: float) -> float:
    """Probability of a larger chi-squared value, by the cube-root normal approximation."""
    if x <= 0:
        return 1.0
    spread = 2 / (9 * freedom)
    return 0.5 * erfc(((x / freedom) ** (1 / 3) - (1 - spread)) / sqrt(2 * spread))


def _uniform(counts: list[int], shares: list[float], n: int) -> float:
    """Pearson's statistic against a chi-squared with its exact mean and variance, which
    differ from the usual ones when most symbols are expected less than once."""
    value = sum(c * c / (n * s) for c, s in zip(counts, shares)) - n
    mean = len(shares) - 1
    variance = 2 * mean + (sum(1 / s for s in shares) - len(shares) ** 2 - 2 * mean) / n
    scale = variance / (2 * mean)
    return chi_squared_tail(value / scale, mean / scale)


def randomness(text: str, encoding: str) -> float:
    """Combined probability that random text in the encoding is less regular."""
    symbols = ENCODINGS[encoding]
    k, n = len(symbols), len(text)
    values = [symbols.index(c) for c in text]
    counts = [0] * k
    for v in values:
        counts[v] += 1
    tests = [_uniform(counts, [1 / k] * k, n)]
    sizes = [sum(c in g for c in symbols) for g in _GROUPS]
    if k > 16:
        shares = [s / k for s in sizes if s]
        groups = [sum(c in g for c in text) for g, s in zip(_GROUPS, sizes) if s]
        if sum(groups) == n and len(groups) > 1:
            total = sum(shares)
            tests.append(_uniform(groups, [s / total for s in shares], n))
    tests.append(_runs([v * 2 >= k for v in values]))
    tests.append(_serial(values, k))
    statistic = -2 * sum(log(max(p, 1e-300)) for p in tests)
    term = total = 1.0
    for i in range(1, len(tests)):
        term *= statistic / 2 / i
        total += term
    return min(1.0, exp(-statistic / 2) * total)


def _runs(above: list[bool]) -> float:
    """Two-sided test of the number of runs, given how many values are above the middle."""
    n, high = len(above), sum(above)
    low = n - high
    if not high or not low:
        return 2.0 ** (1 - n)
    runs = 1 + sum(a != b for a, b in zip(above, above[1:]))
    mean = 1 + 2 * high * low / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    if variance <= 0:
        return 1.0
    return erfc(max(0.0, abs(runs - mean) - 0.5) / sqrt(2 * variance))


def _serial(values: list[int], k: int) -> float:
    """Two-sided test of the correlation of neighbours under uniform independent symbols."""
    middle, variance = (k - 1) / 2, (k * k - 1) / 12
    total = sum((a - middle) * (b - middle) for a, b in zip(values, values[1:]))
    return erfc(abs(total) / (variance * sqrt(len(values) - 1)) / sqrt(2))


def _tested(text: str, start: int, end: int) -> list[tuple[int, int, str, float, int]]:
    """Start, end, stratum, probability and rank of a string and of its parts between marks.
    Rank 0 has the whole or the parts, whichever holds the most random one."""
    spans = [(start, end)]
    spans += [m.span() for m in _PART.finditer(text, start, end) if m.span() != (start, end)]
    found = []
    for s, e in spans:
        encoding = encoding_of(text[s:e])
        if encoding:
            found.append((s, e, stratum_of(encoding, e - s), randomness(text[s:e], encoding)))
    best = max(found, key=lambda t: t[3], default=None)
    return [(*t, int((t[:2] == (start, end)) != (best[:2] == (start, end)))) for t in found]


def _left_over(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What fixed spans leave of the runs of a text, without marks where it was cut."""
    out, first = [], 0
    ends = [(s, e) for s, _, e in base]
    for m in _RUN.finditer(text):
        start, end = m.span()
        while first < len(ends) and ends[first][1] <= start and ends[first][0] <= start:
            first += 1
        at = first
        while at < len(ends) and ends[at][0] < end:
            s, e = ends[at]
            if e > start:
                out.append(_trimmed(text, start, s, start > m.start(), True))
                start = max(start, e)
            at += 1
        out.append(_trimmed(text, start, end, start > m.start(), False))
    return [(s, e) for s, e in out if e - s >= LEAST_LENGTH]


def _trimmed(text: str, start: int, end: int, left: bool, right: bool) -> tuple[int, int]:
    while left and start < end and text[start] in _MARKS:
        start += 1
    while right and end > start and text[end - 1] in _MARKS:
        end -= 1
    return start, end


def stratum_of(encoding: str, length: int) -> str:
    return f"{encoding}:{max(c for c in LENGTH_CLASSES if c <= length)}"


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind by number, and end of the fixed forms, in order."""
    spans = []
    if _NAMES.search(text):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LENGTH:
                spans.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LENGTH:
                spans.append((m.start(), 1, m.end()))
    for m in _LONG_HEX.finditer(text):
        spans.append((m.start(), 2, m.end()))
    return sorted(spans)


#: A greedy run of hexadecimal digits is as long as it can be, so the least length may be
#: asked for at once.
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LENGTH)


def candidates(docs: DataFrame) -> DataFrame:
    """Fixed spans and tested strings of every row.

    ``doc_id long, base_kind, base_start, base_end array<int>``, and for the strings that fixed
    spans leave ``start, end array<int>, stratum array<string>, p array<double>``, ``run
    array<int>`` (a whole and its parts have one number) and ``rank array<int>``.
    """
    names = ("base_kind", "base_start", "base_end", "start", "end", "stratum", "p", "rank", "run")

    def work(rows: pa.RecordBatch) -> dict:
        out: dict = {n: [] for n in names}
        for text in rows.column("text").to_pylist():
            base = fixed_spans(text)
            tested = [
                (*t, run) for run, span in enumerate(_left_over(text, base)) for t in _tested(text, *span)
            ]
            row = [
                [k for _, k, _ in base],
                [s for s, _, _ in base],
                [e for _, _, e in base],
                *([t[i] for t in tested] for i in range(6)),
            ]
            for name, value in zip(names, row):
                out[name].append(value)
        return out | {"doc_id": rows.column("doc_id")}

    kinds = ["int", "int", "int", "int", "int", "string", "double", "int", "int"]
    schema = ", ".join(["doc_id long", *(f"{n} array<{k}>" for n, k in zip(names, kinds))])
    texts = only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long"), text_or_empty().alias("text")
    )
    return in_batches(texts, work, schema)


def cutoffs(found: DataFrame) -> dict[str, float]:
    """The lowest probability that passes, by stratum."""
    step = F.least(F.floor(F.col("t.p") * STEPS), F.lit(STEPS - 1)).cast("int")
    counted = (
        found.where(F.size("p") > 0)
        .select(F.explode(F.arrays_zip("stratum", "p")).alias("t"))
        .groupBy("t.stratum", step.alias("step"))
        .agg(F.count("*").alias("n"))
    )
    tables: dict[str, list[int]] = {}
    for row in counted.collect():  # strata times STEPS at most
        tables.setdefault(row["stratum"], [0] * STEPS)[row["step"]] = row["n"]
    return {stratum: _cutoff(_completed(stratum, tables)) for stratum in tables}


def _completed(stratum: str, tables: dict[str, list[int]]) -> list[float]:
    """Counts of a stratum, completed by those of other lengths in its encoding."""
    encoding, length = stratum.split(":")
    at = LENGTH_CLASSES.index(int(length))
    counts = [float(n) for n in tables[stratum]]
    yielding = HALF / (HALF + sum(counts))
    for i, other in enumerate(LENGTH_CLASSES):
        if i != at:
            weight = yielding * NEIGHBOUR ** abs(i - at)
            for step, n in enumerate(tables.get(f"{encoding}:{other}", ())):
                counts[step] += weight * n
    return counts


def _cutoff(counts: list[float]) -> float:
    counts = [n + PRIOR / STEPS for n in [*counts, *[0] * (STEPS - len(counts))]]
    random = 2 * sum(counts[STEPS // 2 :])
    for step in range(STEPS):
        passing = sum(counts[step:])
        if passing and passing - random * (1 - step / STEPS) <= FALSE_SHARE * passing:
            return max(step / STEPS, PLAIN_CUTOFF)
    return 1.0


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``, an array of structs ``start, kind, end`` (``kind`` by number)
    in order; code points, end exclusive."""
    found = cut(candidates(docs))
    limits = cutoffs(found)
    columns = ("run", "rank", "start", "end", "stratum", "p")

    def work(rows: pa.RecordBatch) -> dict:
        out: dict = {"kind": [], "start": [], "end": []}
        base = zip(*(rows.column(f"base_{c}").to_pylist() for c in out))
        for own, tested in zip(base, zip(*(rows.column(c).to_pylist() for c in columns))):
            for name, fixed, value in zip(out, own, list(zip(*_passing(zip(*tested), limits))) or [()] * 3):
                out[name].append([*fixed, *value])
        return out | {"doc_id": rows.column("doc_id")}

    schema = "doc_id long, kind array<int>, start array<int>, end array<int>"
    zipped = F.arrays_zip("start", "kind", "end")
    return in_batches(found, work, schema).select("doc_id", F.array_sort(zipped).alias("spans"))


def _passing(tested, limits: dict[str, float]) -> list[tuple[int, int, int]]:
    """Kind, start and end of the strings that pass, of each run those of the least rank."""
    passing = [t for t in tested if t[5] >= limits[t[4]]]
    least: dict[int, int] = {}
    for run, rank, *_ in passing:
        least[run] = min(rank, least.get(run, rank))
    random = KINDS.index("random")
    return [(random, start, end) for run, rank, start, end, *_ in passing if rank == least[run]]


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    )
    return F.array_join(F.transform(spans, one), ",")
