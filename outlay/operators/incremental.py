"""Entity resolution kept up to date: a batch of mentions is matched against what is stored.

The state holds what resolving everything at once would have computed: the counts of all
values, the clusters with their component and vendor id, the scored pairs, and the founders.
A step takes mentions in and mentions out (the earlier versions of rows a batch replaces):

1. the counts of the touched clusters are added up anew;
2. clusters that are new, gone, or have another majority place have changed: scores depend on
   nothing else, so only their pairs are scored again, against the clusters in their blocks;
3. components with a touched cluster, or at the other end of a new merge edge, are taken
   apart and built again from their merge edges; no other component can differ;
4. the rebuilt components get their vendors.

So components and all a vendor shows equal those of resolving everything at once, however the
mentions are dealt to steps, while a step only reads names, not payments, and only scores pairs
of changed clusters.

**Vendor ids stay.** Each vendor has a founder: the cluster whose name was least when the vendor
came up. A component takes the id of the oldest vendor founded in it, so a vendor keeps its id
when spellings join or leave it. A vendor that is merged into an older one keeps its
founder, and has its id again if they part. A component without a founder is a new vendor. Every
cluster that passes from one id to another is listed in the lineage of the step. If the
founder's last mention goes, the least cluster that still has the id becomes the founder.

Payments are assigned by name, so a stored payment's vendor is the one its name has now.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.operators import resolve
from outlay.operators.resolve import Thresholds
from outlay.schema import TABLES
from outlay.session import cut

#: Tables of the state, by the column that says where a row is stored.
STATE = {
    "resolution_counts": "norm",
    "resolution_clusters": "norm",
    "resolution_pairs": "a",
    "resolution_founders": "vendor_id",
}
PLACE = ("city", "state", "zip")


@dataclass(frozen=True)
class State:
    """What is known before a step."""

    counts: DataFrame
    clusters: DataFrame
    pairs: DataFrame
    founders: DataFrame


@dataclass(frozen=True)
class Step:
    """What a step changes.

    ``counts``, ``clusters`` and ``pairs`` replace the stored rows of ``touched`` clusters, of
    ``rebuilt`` clusters, and of pairs with a ``changed`` cluster. ``vendors`` and ``variants``
    replace those of the ids ``affected``. ``lineage`` lists ``run, old_id, new_id, change``.
    """

    touched: DataFrame
    changed: DataFrame
    rebuilt: DataFrame
    counts: DataFrame
    clusters: DataFrame
    pairs: DataFrame
    founders: DataFrame
    lost_founders: DataFrame
    vendors: DataFrame
    variants: DataFrame
    affected: DataFrame
    lineage: DataFrame


def empty_state(spark: SparkSession) -> State:
    return State(*[spark.createDataFrame([], TABLES[name]).drop("bucket") for name in STATE])


def signed_counts(added: DataFrame, removed: DataFrame | None) -> DataFrame:
    """Counts of the values of a batch; what is removed counts below zero. A row is as many
    mentions as its column ``n`` says, or one."""

    def signed(rows: DataFrame, sign: int) -> DataFrame:
        number = F.col("n") if "n" in rows.columns else F.lit(1)
        return rows.select("name_raw", "norm", *PLACE, (sign * number).cast("long").alias("sign"))

    rows = signed(added, 1)
    if removed is not None:
        rows = rows.unionByName(signed(removed, -1))
    return resolve.value_counts(rows, F.sum("sign"))


def advance(
    state: State,
    added: DataFrame,
    run: int,
    removed: DataFrame | None = None,
    t: Thresholds = Thresholds(),
) -> Step:
    """Match the mentions of a batch against ``state``; ``run`` numbers grow from step to step."""
    batch = cut(signed_counts(added, removed))
    touched = batch.select("norm").distinct()
    known = state.counts.join(touched, "norm", "left_semi")
    # The filter also keeps constraints of the checkpointed plan on foreign columns out of the union,
    # on which Spark 4.1 fails.
    delta = batch.where("n <> 0")
    counts = known.unionByName(delta).groupBy("norm", "field", "value").agg(F.sum("n").alias("n"))
    counts = cut(counts.where("n > 0"))
    fresh = cut(resolve.clusters_of(counts))

    old = state.clusters.join(touched, "norm", "left_semi")
    old = old.select(*[F.col(c).alias(f"old_{c}") for c in ("norm", "mentions", *PLACE)])
    both = fresh.join(old, F.col("norm") == F.col("old_norm"), "full")
    gone = F.col("mentions").isNull()
    moved = [~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in PLACE]
    changed = both.where(gone | F.col("old_mentions").isNull() | moved[0] | moved[1] | moved[2])
    changed = changed.select(F.coalesce("norm", "old_norm").alias("norm"), gone.alias("gone"))
    changed = cut(changed)
    alive = changed.where("not gone").select("norm")

    kept = state.clusters.join(touched, "norm", "left_anti").select("norm", "mentions", *PLACE)
    clusters = kept.unionByName(fresh.select(kept.columns))
    candidates = resolve.candidates_of(fresh.join(alive, "norm", "left_semi"), clusters, t)
    pairs = cut(resolve.score_pairs(candidates).where(F.col("score") >= t.review))

    ends = resolve.merge_edges(pairs, t)
    met = touched.union(ends.select("a")).union(ends.select("b")).distinct()
    old = state.clusters.select("norm", "component", "vendor_id")
    parts = old.join(met, "norm", "left_semi").select("component").distinct()
    before = cut(old.join(parts, "component", "left_semi"))
    members = before.select("norm").union(alive).distinct()
    members = cut(clusters.join(members, "norm", "left_semi"))

    stale = changed.select("norm")
    standing = state.pairs.join(stale.withColumnRenamed("norm", "a"), "a", "left_anti").join(
        stale.withColumnRenamed("norm", "b"), "b", "left_anti"
    )
    standing = standing.unionByName(pairs).join(members.select(F.col("norm").alias("a")), "a", "left_semi")
    edges = cut(resolve.merge_edges(standing, t))
    labelled = cut(resolve.label_clusters(members, resolve.component_labels(edges)))

    own_counts = state.counts.join(touched, "norm", "left_anti").unionByName(counts)
    own_counts = own_counts.join(members.select("norm"), "norm", "left_semi")
    attributes, summed = resolve.component_attributes(own_counts, labelled, edges)
    attributes = cut(attributes)
    founders, lost = _heirs(state.founders, before, labelled)
    named, new_founders = _identified(attributes, labelled, founders, state.founders, run)
    vendors, variants, assignment = resolve.vendor_tables(named, summed, labelled)
    assignment = cut(assignment.withColumnRenamed("vendor_name_normalized", "norm"))
    inherited = founders.join(lost, "vendor_id", "left_semi")
    return Step(
        touched=touched,
        changed=stale,
        rebuilt=before.select("norm").union(members.select("norm")).distinct(),
        counts=counts,
        clusters=cut(members.join(labelled.select("norm", "component"), "norm").join(assignment, "norm")),
        pairs=pairs,
        founders=cut(new_founders.unionByName(inherited)),
        lost_founders=lost,
        vendors=vendors,
        variants=variants,
        affected=before.select("vendor_id").union(assignment.select("vendor_id")).distinct(),
        lineage=_lineage(before, assignment, run),
    )


def _heirs(founders: DataFrame, before: DataFrame, labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The founders among the rebuilt clusters, and those that are gone. Their ids pass to the
    least cluster that had the id and is still there."""
    there = labelled.select(F.col("norm").alias("founder"))
    were = before.select(F.col("norm").alias("founder"))
    own = founders.join(were, "founder", "left_semi")
    lost = cut(own.join(there, "founder", "left_anti"))
    left = before.join(labelled.select("norm"), "norm", "left_semi").groupBy("vendor_id").agg(F.min("norm").alias("founder"))
    heirs = lost.drop("founder").join(left, "vendor_id")
    standing = own.join(there, "founder", "left_semi")
    return cut(standing.unionByName(heirs)), lost


def _identified(
    attributes: DataFrame, labelled: DataFrame, founders: DataFrame, all_founders: DataFrame, run: int
) -> tuple[DataFrame, DataFrame]:
    """Components with the id of the oldest vendor founded in them, and the founders of the
    new vendors. A new id that an earlier vendor has taken gets the run behind it."""
    member = labelled.select(F.col("norm").alias("founder"), "component")
    oldest = F.min(F.struct("run", "vendor_id"))["vendor_id"]
    claims = founders.join(member, "founder").groupBy("component").agg(oldest.alias("claimed"))
    taken = all_founders.select("vendor_id").distinct().withColumn("taken", F.lit(True))
    named = attributes.join(claims, "component", "left").join(taken, "vendor_id", "left")
    unused = F.when(F.col("taken"), F.concat_ws("-", "vendor_id", F.lit(str(run)))).otherwise(F.col("vendor_id"))
    named = cut(named.withColumn("vendor_id", F.coalesce("claimed", unused)))
    new = named.where(F.col("claimed").isNull())
    new = new.select("vendor_id", F.col("component").alias("founder"), F.lit(run).cast("long").alias("run"))
    return named.drop("claimed", "taken"), new


def _lineage(before: DataFrame, assignment: DataFrame, run: int) -> DataFrame:
    """Ids whose clusters have another id now: ``merged`` if none is left, else ``split``."""
    now = assignment.withColumnRenamed("vendor_id", "new_id")
    moved = before.withColumnRenamed("vendor_id", "old_id").join(now, "norm")
    moved = moved.where(F.col("old_id") != F.col("new_id")).select("old_id", "new_id").distinct()
    still = assignment.select(F.col("vendor_id").alias("old_id"), F.lit("split").alias("change")).distinct()
    moved = moved.join(still, "old_id", "left")
    change = F.coalesce("change", F.lit("merged")).alias("change")
    return moved.select(F.lit(run).cast("long").alias("run"), "old_id", "new_id", change)


def stepped(state: State, step: Step) -> State:
    """The state after a step."""

    def without(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
        return stored.join(gone.toDF(key), key, "left_anti")

    pairs = without(without(state.pairs, step.changed, "a"), step.changed, "b")
    return State(
        without(state.counts, step.touched, "norm").unionByName(step.counts),
        without(state.clusters, step.rebuilt, "norm").unionByName(step.clusters),
        pairs.unionByName(step.pairs),
        without(state.founders, step.lost_founders.select("vendor_id"), "vendor_id").unionByName(step.founders),
    )


def current_vendors(payments: DataFrame, clusters: DataFrame) -> DataFrame:
    """Payments with the vendor their name has now in place of the one they were stored with.
    The empty name is no vendor's and would meet in one task, so it isn't joined."""
    named = F.coalesce(F.col("vendor_name_normalized") != "", F.lit(False))
    now = clusters.select(F.col("norm").alias("vendor_name_normalized"), F.col("vendor_id").alias("_now"))
    rows = payments.where(named).join(now, "vendor_name_normalized", "left")
    rows = rows.withColumn("vendor_id", F.coalesce("_now", "vendor_id")).drop("_now")
    return rows.unionByName(payments.where(~named))
