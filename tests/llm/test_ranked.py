"""Ranked search against a plain version that scores every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from outlay.llm import ranked
from outlay.llm import queries as llm_queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=50):
    counts = [(doc_id, Counter(terms_of(text))) for doc_id, text in docs]
    n_docs = sum(bool(c) for _, c in counts)
    total = sum(c.total() for _, c in counts)
    held = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in sorted(set(items), key=str):
        scored = []
        for doc_id, c in counts:
            score = 0
            for t in set(terms_of(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                    m = 50 + (50 * c.total() * n_docs) // total
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scored, key=lambda s: s[:2] + (s[2] or 0,))[:k], 1):
            out.append((item_id, rank, doc_id, -score))
    return sorted(out, key=str)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aBcZ09 -_.\x00\x7f\xa0é中\n'", max_size=20), max_size=5))
def test_terms_are_those_of_the_contract(texts):
    found = ranked.as_terms(pa.array([*texts, "x"], pa.string()).slice(0, len(texts)))
    assert [re.findall(r"[^ \n]+", t) for t in found.to_pylist()] == [terms_of(t) for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_skipping_finds_what_scoring_everything_finds(monkeypatch, seed):
    monkeypatch.setattr(ranked, "PLACES", 16)
    pick = random.Random(seed)
    known = [f"t{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(pick.choices(known, weights, k=pick.randint(0, 30)))) for i in range(900)]
    items = [(i, " ".join(pick.choices(known, k=8))) for i in range(12)]
    terms = {t: i for i, t in enumerate(known)}
    counts = [Counter(terms_of(t)) for _, t in docs]
    n_docs, total = sum(map(bool, counts)), sum(c.total() for c in counts)
    held = Counter(t for c in counts for t in c)
    best = [ranked.Best(10) for _ in items]
    looked = parts_in_all = 0
    for start in range(0, len(docs), 300):
        part = docs[start : start + 300]
        found = ranked.Postings(pa.array([t for _, t in part], pa.string()), terms)
        m = 50 + (50 * found.n_terms * n_docs) // total
        lists = {}
        for t, a, b in zip(found.terms.tolist(), found.ends[:-1], found.ends[1:]):
            w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[known[t]] + 1)))
            own = found.docs[a:b]
            lists[t] = ranked.List(own, ranked.score_parts(w, found.times[a:b], m[own]), len(part))
        for (_, text), own in zip(items, best):
            mine = [lists[terms[t]] for t in set(terms_of(text)) if terms[t] in lists]
            looked += ranked.search(mine, len(part), np.arange(start, start + 300), own)
            parts_in_all += sum(len(x.docs) for x in mine)
    got = [(i, r + 1, int(d), int(s)) for i, b in enumerate(best) for r, (d, s) in enumerate(zip(b.ids, b.scores))]
    assert sorted(got, key=str) == plain_search(docs, items, 10)
    assert looked < parts_in_all


def test_op13_is_the_plain_version(spark, documents, prose, tmp_path):
    rows = [(i, prose(i, 10 + i % 50, 120), "en", "s") for i in range(160)]
    rows += [(500, rows[4][1], "en", "s"), rows[4], (None, rows[4][1], "en", "s"), (501, None, None, None), (502, "", "", "")]
    items = [(i, prose(900 + i, 12, 120)) for i in range(9)] + [(20, None), (21, ""), (22, "no such words"), (None, "a")]
    items += [(1, prose(1, 8, 120)), items[2]]
    documents(rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = llm_queries.queries()["op13_ranked_search"](spark, str(tmp_path)).collect()
    docs = [r[:2] for r in rows]
    assert sorted((tuple(r) for r in got), key=str) == plain_search(docs, items)


def test_blocks_of_items_give_what_one_block_gives(spark, documents, prose):
    docs = documents([(i, prose(i, 30, 90), "en", "s") for i in range(40)])
    items = spark.createDataFrame([(i, prose(100 + i, 5, 90)) for i in range(8)], "item_id long, text string")
    small = ranked.search_items(docs, items, 3, block_bytes=200)
    assert sorted(small.collect()) == sorted(ranked.search_items(docs, items, 3).collect())


def test_searching_messy_and_empty_tables(spark, messy, empty):
    items = spark.createDataFrame([(1, "the unit"), (2, None)], "item_id long, text string")
    assert ranked.search_items(empty, items).count() == 0
    assert ranked.search_items(messy, items.limit(0)).count() == 0
    assert ranked.search_items(messy, items).where("score <= 0").count() == 0
