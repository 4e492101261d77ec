"""The pipeline: every stage on what the one before it kept, against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from outlay.llm import jaccard, mixing, pii, quality, simhash


@pytest.fixture(scope="module")
def corpus(documents, prose):
    clean = [(i, prose(i, 90 + i % 60), "en", f"s{i % 4}") for i in range(300)]
    copies = [(1000 + i, clean[i][1], "en", "s9") for i in range(20)]
    junk = [(2000 + i, prose(i, 90).replace(" ", "### "), "en", "s1") for i in range(10)]
    short = [(3000 + i, "too short", "en", "s1") for i in range(5)]
    private = [(4000, prose(777, 90) + " mail jane.doe@example.com or 10.20.30.40", "en", None)]
    odd = [(None, prose(888, 80), None, None), (None, None, None, None), (5000, None, "en", "s1")]
    return documents(clean + copies + junk + short + private + odd + clean[:1])


def test_stages_in_turn(spark, corpus):
    docs, kept = corpus, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    ids = {n: Counter(r["doc_id"] for r in rows) for n, rows in kept.items()}
    good = {r["doc_id"] for r in quality.judged(quality.text_statistics(corpus)).collect() if r["kept"]}
    assert set(ids["quality"]) == good >= {*range(300), *range(1000, 1020), 4000, None}
    assert not set(ids["quality"]) & {*range(2000, 2010), *range(3000, 3005), 5000}
    assert ids["near_duplicates"] == Counter([*range(300), 4000, None])
    assert ids["pii"] == ids["near_duplicates"]
    (private,) = [r for r in kept["pii"] if r["doc_id"] == 4000]
    assert "jane.doe" not in private["text"] and "10.20.30.40" not in private["text"]
    assert private["n_chars"] == len(private["text"])
    copies = Counter()
    for r in mixing.mixed(spark.createDataFrame(kept["pii"], corpus.select(*corpus_pipeline.COLUMNS).schema)).collect():
        copies[r["doc_id"]] += r["copies"]
    assert ids["mixing"] == +copies
    first = Counter(r["doc_id"] for r in kept["packing"] if r["piece"] == 0)
    assert first == ids["mixing"]
    fills = Counter()
    for r in kept["packing"]:
        fills[r["sequence_id"]] += r["length"]
    assert max(fills.values()) <= 2048


def test_run_writes_and_rereads(spark, corpus, tmp_path):
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    drop = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    key = lambda t: [str(x) for x in t]
    assert sorted(map(drop, rows), key=key) == sorted(map(drop, again), key=key)


def test_empty_documents(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_operators_agree_with_their_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality",
        "near_duplicates",
        "pii",
        "mixing",
        "packing",
    ]
    assert all(m.__doc__ and "Defined results" in m.__doc__ for m in (quality, simhash, pii, mixing))


def _brute(texts):
    """Least position of each group by the rule itself."""
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


def _edited(text, places):
    words = text.split(" ")
    for p in places:
        words[p] = f"edited{p}"
    return " ".join(words)


def test_near_copies_go(spark, documents, prose):
    base = [" ".join(prose(i, 120).split()) for i in range(12)]
    texts = list(base)
    for i, text in enumerate(base):
        texts.append(_edited(text, [10 + i]))  # 0.92
        texts.append(_edited(text, [30 + i, 90]))  # 0.84
        texts.append(_edited(text, [30, 50 + i, 90]))  # 0.77
        texts.append(_edited(text, [30 + i, 90, 60, 70]))  # 0.83 from the second of these
    texts += [t + " " + base[0] for t in base[1:4]]  # a long passage in common
    want = _brute(texts)
    assert len(set(want)) < len(texts) - 24
    docs = documents([(i, t, "en", "s") for i, t in enumerate(texts)])
    kept = corpus_pipeline.deduplicate(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want))


def test_near_copies_without_ids_or_with_one_id(spark, documents, prose):
    one, two = (" ".join(prose(i, 120).split()) for i in (1, 2))
    near = _edited(one, [40])
    docs = documents([(None, one, "en", "s"), (None, near, "en", "s"), (7, two, "en", "s"), (7, one + " more", "fr", "s")])
    kept = corpus_pipeline.deduplicate(spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["lang"]) for r in kept), key=str) == [(7, "en"), (7, "fr")]
    unnamed = corpus_pipeline.deduplicate(spark, docs.where("doc_id is null"), "").collect()
    assert [r["doc_id"] for r in unnamed] == [None]


def test_texts_of_one_mould_give_few_pairs(spark, documents, prose, monkeypatch):
    """Texts that each change other words of one text meet in many files and are hardly ever
    links: the pairs that need whole sets must not grow with the square of their number."""
    mould, tested = " ".join(prose(5, 150, 2000).split()), []
    linked = jaccard.linked
    monkeypatch.setattr(jaccard, "CELL", 40)
    monkeypatch.setattr(jaccard, "linked", lambda p, *a: tested.append(p.count()) or linked(p, *a))
    pick = random.Random(3)
    texts = [_edited(mould, pick.sample(range(len(mould.split())), 4)) for _ in range(160)]
    texts = [t.replace("edited", f"own{i}x") for i, t in enumerate(texts)]
    docs = documents([(i, t, "en", "s") for i, t in enumerate(texts)])
    kept = corpus_pipeline.deduplicate(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(_brute(texts)))
    assert sum(tested) < 3 * len(texts)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_sketches_differ_less_than_their_sets(a, b):
    one, other = (jaccard.sketch(np.array(sorted(s), np.uint64)) for s in (a, b))
    assert sum(int(x).bit_count() for x in (one ^ other).view(np.uint64)) <= len(a ^ b)
