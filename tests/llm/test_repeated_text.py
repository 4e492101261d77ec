"""Periodic runs and line dedup against plain versions."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from outlay.llm import linestore, periodic
from outlay.llm import queries as llm_queries
from outlay.llm.base import coded_words

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every lag, every place: maximal stretches, each with its least period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((start, end - start, q) for (start, end), q in found.items())


def own_runs(text):
    codes, n_words, _ = coded_words(pa.array([text], pa.string()))
    return periodic.runs_of(codes, n_words).get(0, [])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.integers(1, 9)), max_size=8))
def test_runs_are_those_of_a_plain_search(parts):
    words = [w for part, times in parts for w in part * times]
    assert own_runs(" ".join(words)) == plain_runs(words)


@pytest.mark.parametrize("seed", range(12))
def test_runs_with_long_periods(seed):
    pick = random.Random(seed)
    words = []
    for _ in range(6):
        part = [pick.choice("abcdefghijkl"[: pick.choice([2, 4, 12])]) for _ in range(pick.randint(1, 90))]
        words += part * pick.randint(1, 7) + part[: pick.randint(0, len(part))]
        words += [f"w{pick.randint(0, 60)}" for _ in range(pick.randint(0, 30))]
    runs = own_runs(" ".join(words))
    assert runs == plain_runs(words)


def test_a_very_long_segment_is_scanned():
    assert own_runs("x " * 300_000) == [(0, 300_000, 1)]
    words = [str(i % 1000) for i in range(50_000)]
    assert own_runs(" ".join(words)) == [(0, 50_000, 1000)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=60), max_size=5))
def test_segments_hold_frequent_words_only(texts):
    codes, n_words, _ = coded_words(pa.array([" ".join(t) for t in texts], pa.string()))
    starts, ends = periodic.surviving(codes, n_words)
    inside = np.zeros(len(codes), dtype=bool)
    for start, end in zip(starts, ends):
        assert end - start >= 6 and not inside[start:end].any()
        inside[start:end] = True
        assert np.unique(codes[start:end], return_counts=True)[1].min() >= 4


def plain_op11(doc_id, text):
    words = WORDS.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    written = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha(written), sha(kept))


def test_op11_is_the_plain_version(spark, documents, prose, tmp_path):
    rows = [(i, prose(i, 20 + 3 * (i % 60), 30 + i), "en", "s") for i in range(150)]
    rows += [(1000 + i, " ".join(prose(i, 9).split() * (i % 7)) + " end", "en", "s") for i in range(40)]
    rows += [(2000, None, None, None), (2001, "", "en", "s"), (2002, " \n\t", "en", "s"), (None, "a b " * 9, "en", "s")]
    rows += [(2003, "a b c " * 8, None, None), rows[3], rows[3]]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = llm_queries.queries()["op11_periodic"](spark, str(tmp_path))
    expected = [plain_op11(r[0], r[1]) for r in rows]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, expected))
    assert sum(r[1] > 0 for r in expected) > 20


def test_runs_of_messy_and_empty_tables(messy, empty):
    assert periodic.digests(periodic.collapsed(messy)).count() == messy.count()
    assert periodic.digests(periodic.collapsed(periodic.repeated(empty))).count() == 0


# Line dedup


def plain_op12(rows, least=10):
    keyed = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        keys = [re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r")) for line in lines]
        keyed.append((doc_id, lines, keys))
    held = Counter(k for _, _, keys in keyed for k in set(keys) if k)
    out = []
    for doc_id, lines, keys in keyed:
        kept = [line for line, k in zip(lines, keys) if held[k] < least]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def _lined(seed, n):
    pick = random.Random(seed)
    known = ["", " ", "Accept Cookies", "\taccept cookies ", "É", "é", "a\x0bb", "\x0bx\x0c", "x\x85", "x", " x"]
    known += [f"line {i}" for i in range(12)]
    return [(i, "\n".join(pick.choices(known, k=pick.randint(0, 6)))) for i in range(n)]


@pytest.mark.parametrize("batches, fanout, heavy", [(1, 2, 20_000), (5, 2, 20_000), (7, 3, 1), (4, 4, 20)])
def test_lines_of_many_documents_go(spark, documents, monkeypatch, batches, fanout, heavy):
    monkeypatch.setattr(linestore, "HEAVY", heavy)
    rows = _lined(batches, 90) + [(500, None), (501, ""), (None, "x\nline 1"), (7, "line 2"), (7, "line 2")]
    docs = documents([(i, t, "en", "s") for i, t in rows])
    got = linestore.without_common_lines(docs, batches=batches, fanout=fanout)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_op12(rows)


def test_runs_are_levelled_and_merged(spark):
    with linestore.LineRuns(spark, least=10, fanout=2) as runs:
        for i in range(7):
            batch = [(k, 0, 4) for k in range(i, i + 3)] + [(100, 0, 1)]
            runs.add(spark.createDataFrame(batch, "high long, low long, docs long").repartition(4, "high", "low"))
        assert [len(level) for level in runs.levels] == [1, 1, 1]
        counts = {r["high"]: r["docs"] for r in runs._merged(runs.runs()).collect()}
        assert counts == {0: 4, 1: 8, 8: 4, 7: 8, 100: 7} | dict.fromkeys(range(2, 7), 12)
        assert {r["high"] for r in runs.common().collect()} == set(range(2, 7))
        paths = list(runs._tables.values())
    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_stored_runs_are_not_shuffled(spark):
    with linestore.LineRuns(spark, fanout=9) as runs:
        for i in range(2):
            rows = spark.range(100).select((F.col("id") + i).alias("high"), (7 * (F.col("id") + i)).alias("low"))
            runs.add(rows.groupBy("high", "low").agg(F.count(F.lit(1)).alias("docs")))
        batch = spark.range(200).select(F.col("id").alias("high"), (7 * F.col("id")).alias("low"))
        batch = batch.groupBy("high", "low").agg(F.count(F.lit(1)).alias("docs"))
        for name in runs.runs():
            batch = batch.join(spark.table(name).hint("merge"), ["high", "low"], "left_anti")
        plan = batch._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 2
        assert batch.count() == 99


def test_lines_of_messy_and_empty_tables(messy, empty):
    assert linestore.without_common_lines(messy).count() == messy.count()
    assert linestore.without_common_lines(empty).count() == 0
