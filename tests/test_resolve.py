"""Entity resolution: the known cases, brute force, skew and order independence."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from outlay.functions import names, similarity
from outlay.operators import resolve


def mentions(spark, rows):
    schema = "id string, name_raw string, city string, state string, zip string"
    full = [(str(i), *(list(r) + [None] * 4)[:4]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, schema)
    return df.withColumn("norm", names.vendor_key(F.col("name_raw")))


def vendors(spark, *rows):
    return resolve.resolve_vendors(mentions(spark, rows)).vendors.collect()


def test_exact_variants_merge_with_full_confidence(spark):
    found = vendors(spark, ["ABC Inc"], ["A.B.C. Incorporated"], ["ABC INC."], [""])
    assert [(v.confidence, v.mention_count, v.variant_count) for v in found] == [(1.0, 3, 3)]


def test_typo_merges_and_other_names_do_not(spark):
    typo = vendors(spark, ["Acme Construction Co"], ["Acme Constructon Co"])
    assert len(typo) == 1 and 0.93 <= typo[0].confidence < 1
    assert len(vendors(spark, ["Acme Construction Co"], ["Acme Consulting Co"])) == 2


def test_state_conflict_blocks_a_merge(spark):
    a = ["Acme Construction Co", None, "CA"]
    b = ["Acme Constructon Co", None, "TX"]
    assert len(vendors(spark, a, b)) == 2
    # A stateless spelling bridges the two; the report names the component.
    result = resolve.resolve_vendors(mentions(spark, [a, b, ["Acme Constructin Co"]]))
    assert result.vendors.count() == 1
    assert resolve.mixed_state_components(result.labels).count() == 1


def test_ids_do_not_depend_on_order(spark):
    rows = [["ABC Inc"], ["A.B.C. Incorporated"], ["Acme Construction Co"], ["Acme Constructon Co"]]
    first = {v.vendor_id for v in vendors(spark, *rows)}
    again = {v.vendor_id for v in vendors(spark, *rows[::-1])}
    assert first == again and len(first) == 2


def _random_clusters(spark, n=260):
    rng = random.Random(3)
    words = ["CITY", "CITI", "OF", "NORTH", "NORT", "WATER", "WATR", "CO", "INC", "A", "AB", "ABC", "12"]
    rows = set()
    while len(rows) < n:
        base = " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
        rows.add(base)
        for _ in range(3):  # near copies: one character replaced or lost
            at = rng.randrange(len(base))
            typo = base[:at] + rng.choice(["", "X"]) + base[at + 1 :]
            rows.add(" ".join(typo.split()) or base)
    data = [
        (r, 1, rng.choice([None, "X", "Y"]), rng.choice([None, "CA", "TX"]), rng.choice([None, "1", "2"]))
        for r in sorted(rows)
    ]
    return spark.createDataFrame(
        data, "norm string, mentions long, city string, state string, zip string"
    )


def _brute_force(clusters):
    rows = clusters.collect()
    pairs = []
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            a, b = sorted((x, y), key=lambda r: r.norm)
            block = a.norm.split()[0] == b.norm.split()[0] or a.norm[:4] == b.norm[:4]
            if not block or (a.state and b.state and a.state != b.state):
                continue
            weights = ((0.05, "zip"), (0.03, "state"), (0.02, "city"))
            boost = sum((w for w, f in weights if a[f] and a[f] == b[f]), 0.0)
            pairs.append((a.norm, b.norm, boost))
    return pairs


def test_candidates_lose_nothing_against_brute_force(spark):
    clusters = _random_clusters(spark).cache()
    pairs = _brute_force(clusters)
    df = spark.createDataFrame(pairs, "a string, b string, boost double")
    ratio = similarity.token_sort_ratio(F.col("a"), F.col("b"))
    expected = {
        (r.a, r.b): r.score
        for r in resolve.score_pairs(df.withColumn("token_sort_ratio", ratio))
        .where(F.col("score") >= resolve.REVIEW)
        .collect()
    }
    # A tiny cell size cuts every signature group into a grid.
    for hot in (resolve.HOT_SIGNATURE, 3):
        scored = resolve.score_pairs(resolve.candidate_pairs(clusters, hot=hot)).collect()
        keys = [(r.a, r.b) for r in scored]
        assert len(keys) == len(set(keys))
        got = {(r.a, r.b): r.score for r in scored if r.score >= resolve.REVIEW}
        assert got.keys() == expected.keys() and len(got) > 50
        assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_components_of_chains_stars_and_rings(spark):
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    edges += [("hub", f"leaf{i:03d}") for i in range(80)]
    edges += [("r1", "r2"), ("r2", "r3"), ("r1", "r3")]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "a string, b string")
    labels = {r.norm: r.component for r in resolve.component_labels(df).collect()}
    assert {labels[f"c{i:03d}"] for i in range(1, 61)} == {"c000"}
    assert {labels[f"leaf{i:03d}"] for i in range(80)} == {"hub"}
    assert labels["r2"] == labels["r3"] == "r1" and "r1" not in labels


def test_a_payee_with_a_third_of_all_mentions(spark):
    rows = spark.range(6000).select(
        F.col("id").cast("string"),
        F.when(F.col("id") % 3 == 0, "Big Payee Inc")
        .otherwise(F.concat(F.lit("Payee "), F.md5(F.col("id").cast("string"))))
        .alias("name_raw"),
        F.lit(None).cast("string").alias("city"),
        F.lit("CA").alias("state"),
        F.lit(None).cast("string").alias("zip"),
    )
    counts = resolve.value_counts(rows.withColumn("norm", names.vendor_key(F.col("name_raw"))))
    clusters = resolve.clusters_of(counts)
    assert clusters.agg(F.sum("mentions"), F.count("*")).first() == (6000, 4001)
    assert clusters.orderBy(F.desc("mentions")).first().mentions == 2000


def test_reason_rounds_the_binary_value(spark):
    """0.9125 lies just below the tie and 0.0625 on it, which goes to the even digit."""
    schema = "a string, b string, score double, name_similarity double"
    rows = [("A", str(i), 0.9, x) for i, x in enumerate([0.9125, 0.0625, 0.8754999, 0.9, 1.0])]
    found = resolve.review_pairs(spark.createDataFrame(rows, schema)).orderBy("normalized_b").collect()
    assert [r.reason for r in found] == [f"name {x:.3f}" for *_, x in rows]
