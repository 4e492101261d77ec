"""Resolution in steps against resolving everything at once."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from outlay.operators import incremental, resolve

MENTION = "name_raw string, norm string, city string, state string, zip string"
NAMES = [
    "NORTH HARBOR PAVING",
    "NORTH HARBOR PAVINGS",
    "NORTH HARBUR PAVING",
    "NORTHERN LIGHTS ELECTRIC",
    "NORTHERN LIGHT ELECTRIC",
    "MAPLE STREET CLEANERS",
    "MAPLE STREET CLEANER",
    "MAPLE STREET CLEANERSS",
    "QUARRY ROCK SUPPLY",
]
PLACES = [("DOVER", "DE", "19901"), ("SALEM", "OR", "97301"), (None, None, None)]


def mentions(spark, rows):
    return spark.createDataFrame([(n, n, *p) for n, p in rows], MENTION)


def shown(vendors):
    columns = [c for c in vendors.columns if c != "vendor_id"]
    return sorted(map(str, vendors.withColumn("confidence", F.round("confidence", 9)).select(columns).collect()))


def parts(clusters, label):
    found = {}
    for r in clusters.select("norm", label).collect():
        found.setdefault(r[label], set()).add(r["norm"])
    return sorted(map(sorted, found.values()))


def settled(state):
    """The same state without its lineage."""
    return incremental.State(*[incremental.cut(getattr(state, f)) for f in ("counts", "clusters", "pairs", "founders")])


def test_steps_end_where_resolving_at_once_does(spark):
    pick = random.Random(2)
    state, present, vendors = incremental.empty_state(spark), [], {}
    for run in range(1, 4):
        new = [(pick.choice(NAMES), pick.choice(PLACES)) for _ in range(7)]
        out = pick.sample(present, len(present) // 3)
        step = incremental.advance(state, mentions(spark, new), run, mentions(spark, out) if out else None)
        for row in out:
            present.remove(row)
        present += new
        gone = {r[0] for r in step.affected.collect()}
        vendors = {k: v for k, v in vendors.items() if k not in gone}
        fresh = step.vendors.collect()
        vendors |= {r["vendor_id"]: r for r in fresh}
        state = settled(incremental.stepped(state, step))
        once = resolve.resolve_vendors(mentions(spark, present))
        assert parts(state.clusters, "component") == parts(once.labels, "component")
        assert parts(state.clusters, "vendor_id") == parts(state.clusters, "component")
        assert shown(spark.createDataFrame(list(vendors.values()), step.vendors.schema)) == shown(once.vendors)
        scored = once.scored.where(F.col("score") >= resolve.REVIEW)
        key = ["a", "b", F.round("score", 9).alias("score")]
        assert sorted(state.pairs.select(key).collect()) == sorted(scored.select(key).collect())
        assert state.founders.groupBy("vendor_id").count().where("count > 1").count() == 0


def test_ids_stay_when_spellings_join_and_merges_are_listed(spark):
    dover, salem = PLACES[0], PLACES[1]
    one = incremental.advance(
        incremental.empty_state(spark), mentions(spark, [(NAMES[0], dover), (NAMES[8], salem)]), 1
    )
    first = {r["norm"]: r["vendor_id"] for r in one.clusters.collect()}
    assert first == {
        r["vendor_name_normalized"]: r["vendor_id"]
        for r in resolve.resolve_vendors(mentions(spark, [(NAMES[0], dover), (NAMES[8], salem)])).assignment.collect()
    }
    state = settled(incremental.stepped(incremental.empty_state(spark), one))
    two = incremental.advance(state, mentions(spark, [(NAMES[1], dover)]), 2)
    ids = {r["norm"]: r["vendor_id"] for r in two.clusters.collect()}
    assert ids == {NAMES[0]: first[NAMES[0]], NAMES[1]: first[NAMES[0]]}
    assert two.lineage.count() == 0


def test_vendors_that_merge_and_part_again(spark):
    a, b, c = "ACME TRADING COMPANY", "ACME TRADING COMPANYXXX", "ACME TRADING COMPANYX"
    state = incremental.empty_state(spark)
    seen = []
    for run, (new, out) in enumerate([([a], []), ([b], []), ([c], []), ([], [c])], 1):
        rows = lambda names: mentions(spark, [(n, PLACES[2]) for n in names])
        step = incremental.advance(state, rows(new), run, rows(out) if out else None)
        state = settled(incremental.stepped(state, step))
        ids = {r["norm"]: r["vendor_id"] for r in state.clusters.collect()}
        seen.append((ids, [tuple(r) for r in step.lineage.collect()]))
    (one, _), (two, none), (three, merged), (four, split) = seen
    assert two[a] != two[b] and none == [] and set(three.values()) == {one[a]}
    assert merged == [(3, two[b], one[a], "merged")]
    assert four == two and split == [(4, one[a], two[b], "split")]


def test_a_founder_that_goes_leaves_its_id(spark):
    rows = mentions(spark, [(n, PLACES[0]) for n in NAMES[:2]])
    one = incremental.advance(incremental.empty_state(spark), rows, 1)
    state = settled(incremental.stepped(incremental.empty_state(spark), one))
    old = state.clusters.first()["vendor_id"]
    two = incremental.advance(state, rows.limit(0), 2, mentions(spark, [(NAMES[0], PLACES[0])]))
    state = settled(incremental.stepped(state, two))
    assert [(r["norm"], r["vendor_id"]) for r in state.clusters.collect()] == [(NAMES[1], old)]
    assert [tuple(r) for r in state.founders.collect()] == [(old, NAMES[1], 1)]


def test_hot_signatures_are_cut_into_cells(spark):
    rows = mentions(spark, [(f"HARBOR STREET UNIT {i:03d}", PLACES[0]) for i in range(60)])
    clusters = resolve.clusters_of(resolve.value_counts(rows))
    changed = clusters.where(F.col("norm") < "HARBOR STREET UNIT 020")
    new = changed.select(F.col("norm").alias("x"))
    every = resolve.candidate_pairs(clusters).join(new, (F.col("a") == F.col("x")) | (F.col("b") == F.col("x")), "left_semi")
    for hot in (4, 2000):
        assert sorted(resolve.candidates_of(changed, clusters, hot=hot).collect()) == sorted(every.collect())
