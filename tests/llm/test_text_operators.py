"""Packing, near duplicates, mixing and quality against plain versions on small tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from math import log1p

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from outlay.llm import mixing, packing, quality, simhash
from outlay.llm.base import coded_words
from outlay.llm.queries import TOKENIZER

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# Words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85\xa0ab,é中", max_size=30), max_size=5))
def test_coded_words_are_the_words_of_the_contract(texts):
    codes, counts, words = coded_words(pa.array(texts, pa.string()))
    known, at = words.to_pylist(), 0
    for text, n in zip(texts, counts.tolist()):
        assert [known[c] for c in codes[at : at + n]] == WORDS.findall(text)
        at += n


# Packing

SPELLED = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", " ", "\n", "Word"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(SPELLED | st.text(max_size=20), max_size=6).map("".join), min_size=1, max_size=4))
@example(["hello x<|endoftext|>y <|EndOfText|> <|startoftext|><|endoftext|>", "plain Text"])
def test_ids_are_those_of_the_whole_text(texts):
    plain = Tokenizer.from_file(TOKENIZER)
    ids, counts = packing.encoder(TOKENIZER)(pa.array(texts, pa.string()))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for text, own in zip(texts, parts):
        assert own.tolist() == plain.encode(text, add_special_tokens=False).ids


def _check_packing(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        assert 1 <= r["length"] <= capacity
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pieces_and_places(messy):
    rows = packing.pack(packing.tokenize(messy, TOKENIZER)).collect()
    _check_packing(rows, packing.CAPACITY)
    plain = Tokenizer.from_file(TOKENIZER)
    want = []
    for d in messy.collect():
        ids = [*plain.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = np.array(ids[at : at + packing.CAPACITY], dtype="<u4")
            want.append((d["doc_id"], piece, at, len(part), zlib.crc32(part.tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert Counter(got) == Counter(want)


def test_sequences_hold_the_ids(messy):
    docs = messy.where("doc_id < 20 or doc_id = 103")
    pieces = packing.tokenize(docs, TOKENIZER, with_ids=True)
    packed = packing.pack(packing.tokenize(docs, TOKENIZER))
    total = 0
    for r in packing.assemble(packed, pieces).collect():
        ids = b"".join(r["ids"])
        assert 0 < len(ids) <= 4 * packing.CAPACITY
        total += len(ids) // 4
    assert total == sum(r["length"] for r in packed.collect())


def test_equal_rows_spread_over_the_cells(spark, documents):
    pieces = packing.tokenize(documents([(None, None, None, None)] * 400), TOKENIZER)
    rows = packing.pack(pieces, cell_pieces=100).collect()
    _check_packing(rows, packing.CAPACITY)
    cells = Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(rows) == 400 and len(cells) == 4 and max(cells.values()) < 180


def test_many_cells(messy):
    pieces = packing.tokenize(messy, TOKENIZER)
    rows = packing.pack(pieces, cell_pieces=10).collect()
    _check_packing(rows, packing.CAPACITY)
    assert len(rows) == pieces.count()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=120))
def test_fill_respects_the_capacity(sizes):
    lengths = np.array(sorted(sizes, reverse=True))
    bins, offsets = packing.fill(lengths, 100)
    rows = [
        {"sequence_id": b, "offset": o, "length": n} for b, o, n in zip(bins, offsets, lengths.tolist())
    ]
    used = _check_packing(rows, 100)
    assert -(-sum(sizes) // 100) <= used <= 2 * -(-sum(sizes) // 100)


@pytest.mark.parametrize(
    "lengths, used",
    [
        ([48, 47, 42, 38, 35, 30, 26, 23], 3),
        ([56, 51, 49, 44, 44, 44, 42, 39, 32, 28, 23, 21, 18], 5),
        ([30, 29, 26, 25, 25, 24, 23, 23, 23, 23, 21, 17], 3),
    ],
)
def test_local_search_saves_a_bin(lengths, used):
    assert len(packing._best_fit(lengths, 100)) == used + 1
    assert packing.fill(np.array(lengths), 100)[0].max() + 1 == used


# Near duplicates


def _fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def _components(prints):
    """Least id reachable, by comparing all pairs."""
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbB \n\tÄé\x1c\xa0", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == _fingerprint(text)


def test_groups_of_messy_rows(messy):
    rows = simhash.components(simhash.fingerprints(messy)).collect()
    source = [(d["doc_id"], _fingerprint(d["text"])) for d in messy.collect()]
    labels = _components([fp for _, fp in source])
    least = {}
    for (i, _), label in zip(source, labels):
        if i is not None:
            least[label] = min(i, least.get(label, i))
    want = Counter((i, fp, least.get(label)) for (i, fp), label in zip(source, labels))
    assert Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in rows) == want


def test_chains_of_near_prints(spark):
    pick = np.random.default_rng(5)
    prints = []
    for _ in range(40):
        fp = int(pick.integers(0, 2**63)) * 2 + 1
        for _ in range(int(pick.integers(1, 9))):
            prints.append(fp)
            for bit in pick.integers(0, 64, int(pick.integers(0, 4))):
                fp ^= 1 << int(bit)
    signed = [(i, fp - 2**64 if fp >> 63 else fp) for i, fp in enumerate(prints)]
    rows = simhash.components(spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(_components(prints)))


def test_bit_sliced_pairs_are_all_pairs_of_a_run():
    pick = np.random.default_rng(6)
    base = pick.integers(0, 2**62, 20, dtype=np.uint64)
    flips = np.uint64(1) << pick.integers(0, 64, (2, 20, 12)).astype(np.uint64)
    fps = np.unique(np.concatenate([base, (base[:, None] ^ flips[0]).ravel(), (base[:, None] ^ flips[0] ^ flips[1]).ravel()]))
    pick.shuffle(fps)
    run = np.sort(pick.integers(0, 3, len(fps)))
    got = set(zip(*(x.tolist() for x in simhash.pairs_within(fps, run))))
    want = {
        (i, j)
        for i in range(len(fps))
        for j in range(i + 1, len(fps))
        if run[i] == run[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 2
    }
    assert got == want


def test_files_that_go_on_in_the_next_batch():
    keys = np.repeat(np.arange(50), 7)
    fps = np.arange(350) * 1024 + np.tile([0, 1, 2, 4, 512, 513, 1023], 50)
    whole = pa.record_batch({"file": np.zeros(350, int), "key": keys, "fp": fps})
    edges = lambda batches: sorted(
        e for b in simhash._links_of_files(iter(batches)) for e in zip(*(c.to_pylist() for c in b.columns))
    )
    assert edges([whole.slice(i, 5) for i in range(0, 350, 5)]) == edges([whole])


# Mixing


def _mixed(docs):
    sized = [(d["doc_id"], d["source"], len(WORDS.findall(d["text"] or ""))) for d in docs]
    sources = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in sized if x == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target = dict.fromkeys(sources, 0.0)
    left, open_ = 1.5 * sum(size.values()), set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] < level * weight[s]}
        if not full:
            return sized, size, target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    return sized, size, target


def test_targets_and_what_is_taken(messy):
    sized, size, target = _mixed(messy.collect())
    rows = mixing.mixed(messy).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, n) for i, _, n in sized)
    for s in size:
        own = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in own} == {size[s]}
        assert all(r["target"] == pytest.approx(target[s]) for r in own)
        assert all(0 <= r["copies"] <= 2 for r in own)
        taken = sum(r["copies"] * r["size"] for r in own)
        assert abs(taken - target[s]) <= 2 * max(r["size"] for r in own)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed(messy.repartition(3)).collect()))


def test_mixture_repeats_documents(messy):
    copies = Counter()
    for r in mixing.mixed(messy).collect():
        copies[r["doc_id"]] += r["copies"]
    got = Counter(r["doc_id"] for r in mixing.mixture(messy, ("doc_id", "text")).collect())
    assert got == +copies


def test_places_are_the_order(spark):
    rows = spark.range(1000).selectExpr("(id * 37) % 101 as a", "id as b").repartition(7)
    placed = mixing.numbered(rows, rows["a"], rows["b"]).orderBy("place").collect()
    assert [r["place"] for r in placed] == list(range(1000))
    assert [(r["a"], r["b"]) for r in placed] == sorted((r["a"], r["b"]) for r in placed)


# Quality


def _counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {
        i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)
    }
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_of_messy_rows(messy, documents):
    odd = documents(
        [(1, "a b c a b c\nx\n x\nx\n\n", "en", "s"), (2, "a a a a", "en", "s"), (3, "#*<> |& ", None, "s")]
    )
    for docs in (messy, odd):
        rows = quality.text_statistics(docs).collect()
        got = Counter((r["doc_id"], *(r[c] for c in quality.COUNTS)) for r in rows)
        assert got == Counter((d["doc_id"], *_counts(d["text"])) for d in docs.collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25))
def test_repeated_windows(codes):
    words = list(map(str, codes))
    assert quality.repeated_in_windows(np.array(codes, dtype=np.int32)) == _counts(" ".join(words))[4]


def test_outliers_go_and_the_rest_stays(documents, prose):
    clean = [(i, prose(i, 80 + i % 50), "en", "big" if i % 3 else f"s{i % 7}") for i in range(900)]
    shout = [(1000 + i, prose(i, 90).upper().replace(" ", "!! "), "en", "big") for i in range(30)]
    marks = [(2000 + i, prose(i, 90).replace(" ", "%%% "), "en", f"s{i % 7}") for i in range(30)]
    rows = quality.judged(quality.text_statistics(documents(clean + shout + marks))).collect()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert kept == {i for i, *_ in clean}
    again = quality.judged(quality.text_statistics(documents((clean + shout + marks)[::-1]))).collect()
    assert {r["doc_id"]: r["distance"] for r in again} == {r["doc_id"]: r["distance"] for r in rows}


def test_an_estimate_is_the_mean_and_scatter_of_the_closest(spark):
    pick = np.random.default_rng(3)
    grid = np.clip(np.round(2000 + 200 * pick.standard_normal((4000, quality.P))), 0, quality.GRID)
    grid[:800] += 1500
    rows = [("x", *map(int, r)) for r in grid]
    fit = spark.createDataFrame(rows, ["stratum", *quality.NAMES])
    estimate = quality._first_estimate(fit)
    for _ in range(quality.STEPS):
        estimate = quality._concentrated(fit, estimate)
    row = estimate.first()
    clean = grid[800:] / quality.GRID
    mean = np.array([row[f"m{i}"] for i in range(quality.P)])
    assert np.abs(mean - clean.mean(axis=0)).max() < 0.01
    floor = np.diag(np.array(list(quality.TOLERANCE.values())) ** 2)
    want = np.linalg.inv(np.cov(clean.T) + floor)
    got = np.array([row[f"s{i}_{i}"] for i in range(quality.P)])
    assert np.allclose(got, np.diag(want), rtol=0.35)


def test_small_groups_are_drawn_towards_the_wider_one_smoothly():
    pick = np.random.default_rng(5)
    means = pick.random((2, quality.P))
    scatters = [np.cov(pick.random((20, quality.P)).T) for _ in range(2)]
    for n in (1, 99, 100, 101, 399, 400, 401, 10_000):
        own = quality._estimate_row("own", n, means[0], scatters[0]).iloc[0]
        wide = quality._estimate_row("wide", 5000, means[1], scatters[1]).iloc[0].add_prefix("w_")
        _, _, mean, scatter = quality._blend(quality.pd.concat([own, wide]), 100)
        w = n / (n + 100)
        assert np.allclose(mean, w * means[0] + (1 - w) * means[1])
        # Location and scatter of a mixture of the two groups.
        second = [s + np.outer(m, m) for s, m in zip(scatters, means)]
        assert np.allclose(scatter, w * second[0] + (1 - w) * second[1] - np.outer(mean, mean), atol=1e-6)


def test_every_source_has_its_own_estimate(documents, prose):
    rows = [(i, prose(i, 70 + i % 40), "en", f"s{i % 5}") for i in range(60)]
    # Prose of another kind altogether, in a source with few texts.
    rows += [(100 + i, prose(i, 70 + i).upper().replace(" ", "; "), "en", "odd") for i in range(12)]
    kept = quality.judged(quality.text_statistics(documents(rows))).where("kept")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows}


def test_consistency_factor_of_a_normal_sample():
    pick = np.random.default_rng(4).standard_normal((200_000, quality.P))
    near = pick[np.argsort((pick**2).sum(axis=1))[: int(0.75 * len(pick))]]
    assert quality.consistency(0.75) == pytest.approx(1 / near.var(axis=0).mean(), rel=0.02)


def test_base_rules_on_messy_rows(messy):
    for r in quality.judged(quality.text_statistics(messy)).collect():
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed
        assert r["kept"] is False if failed else r["distance"] is not None


# Empty tables


def test_empty_tables(empty):
    assert packing.pack(packing.tokenize(empty, TOKENIZER)).count() == 0
    assert simhash.components(simhash.fingerprints(empty)).count() == 0
    assert mixing.mixed(empty).count() == 0
    assert mixing.mixture(empty, ("doc_id", "text")).count() == 0
    assert quality.judged(quality.text_statistics(empty)).count() == 0


def test_word_length_statistic(documents):
    row = quality.text_statistics(documents([(1, "abcd " * 60, "en", "s")])).first()
    assert row["word_length"] == round(log1p(4) / 8 * quality.GRID)


def test_quality_pairs_no_partitions_with_each_other(documents, monkeypatch):
    plans, cut = [], quality.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(quality, "cut", seen)
    text = " ".join(f"word{i}" for i in range(60))
    rows = documents([(i, f"{text} {i}", "en", f"s{i % 2}") for i in range(8)])
    assert quality.judged(quality.text_statistics(rows)).where("kept").count() == 8
    assert plans and not any("CartesianProduct" in p for p in plans)
