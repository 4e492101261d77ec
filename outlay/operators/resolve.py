"""Entity resolution: many spellings of a payee become one vendor.

Stages, each a Spark job over whole tables:

1. mentions with the same key form a cluster; its spellings, cities, states and zips are
   kept as a long table of counts;
2. candidate pairs share a block (first word, or first four characters) and can still
   reach the review threshold;
3. pairs are scored, half Jaro-Winkler and half token-sorted edit distance, plus boosts
   for an equal place; pairs whose states differ are dropped;
4. strong pairs are merge edges, the others go to review;
5. connected components of the merge edges are the vendors.

Candidate pairs never come from comparing everything in a block. A pair can only reach
the review threshold when its edit distance is small, and then the rarest character
pieces of the two names must overlap (prefix filtering). The join is on such pieces, so
a block may be of any size and no block is left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.coerce import strip
from outlay.functions.keys import set_fingerprint, slug
from outlay.functions.names import sorted_tokens, tokens
from outlay.functions.similarity import jaro_winkler
from outlay.session import cut

# Thresholds, boosts for equal majority values, block prefix length, and the
# name shown where a mention has none.
MERGE = 0.93
REVIEW = 0.86
ZIP_BOOST, STATE_BOOST, CITY_BOOST = 0.05, 0.03, 0.02
BLOCK_PREFIX = 4
UNKNOWN_VENDOR = "Unknown vendor"
# Characters of a key from the most to the least frequent in English text.
# Only the speed of the candidate join depends on the order.
BY_FREQUENCY = " ETAOINSRHLDCUMFPGWYBVKXJQZ0123456789"
RARITY_CODES = "".join(chr(0x30 + len(BY_FREQUENCY) - i) for i in range(len(BY_FREQUENCY)))
SEPARATOR = "\x1f"
#: Rows of one signature that one task may pair with as many others; larger groups are
#: cut into a grid of cells of this size.
HOT_SIGNATURE = 2_000


@dataclass(frozen=True)
class Thresholds:
    """Scores at which pairs merge and at which they are worth a look."""

    merge: float = MERGE
    review: float = REVIEW

    def __post_init__(self) -> None:
        floor = 0.5 + ZIP_BOOST + STATE_BOOST + CITY_BOOST
        if not floor < self.review <= self.merge:
            raise ValueError(f"need {floor} < review <= merge")

    def least_ratio(self, boost: float) -> float:
        """Smallest token-sort ratio that can reach review: Jaro-Winkler is at most one."""
        return 2 * (self.review - boost) - 1


@dataclass(frozen=True)
class Resolution:
    """Result tables. ``assignment`` maps a vendor key to its vendor id."""

    vendors: DataFrame
    variants: DataFrame
    assignment: DataFrame
    review: DataFrame
    clusters: DataFrame
    scored: DataFrame
    labels: DataFrame


def mentions_of(txns: DataFrame) -> DataFrame:
    """One mention per payment."""
    return txns.select(
        "id",
        F.col("vendor_name_raw").alias("name_raw"),
        F.col("vendor_name_normalized").alias("norm"),
        F.col("vendor_city").alias("city"),
        F.col("vendor_state").alias("state"),
        F.col("vendor_zip").alias("zip"),
    )


def value_counts(mentions: DataFrame, number: Column | None = None) -> DataFrame:
    """Long table ``(norm, field, value, n)`` of every named cluster; ``number`` says how many
    mentions a group of rows is. By default a row is as many as its column ``n`` says, or one.

    Equal mentions are counted first, so a payee with a third of all payments is a few
    rows before its values are spread out. Field ``mentions`` counts the cluster itself.
    """
    name = F.coalesce(
        F.nullif(F.col("name_raw"), F.lit("")),
        F.nullif(F.col("norm"), F.lit("")),
        F.lit(UNKNOWN_VENDOR),
    )
    if number is None:
        number = F.sum("n") if "n" in mentions.columns else F.count(F.lit(1))
    equal = (
        mentions.where(F.coalesce("norm", F.lit("")) != "")
        .groupBy("norm", name.alias("name"), "city", "state", "zip")
        .agg(number.alias("n"))
    )
    fields = [F.struct(F.lit("mentions").alias("field"), F.col("norm").alias("value"))] + [
        F.struct(F.lit(f).alias("field"), strip(F.col(f)).alias("value"))
        for f in ("name", "city", "state", "zip")
    ]
    return (
        equal.select("norm", "n", F.inline(F.array(*fields)))
        .where(F.col("value") != "")
        .groupBy("norm", "field", "value")
        .agg(F.sum("n").alias("n"))
    )


def _most_common(field: str) -> Column:
    """Aggregate over the long table: most frequent value, ties to the smallest."""
    ranked = F.when(F.col("field") == field, F.struct(-F.col("n"), F.col("value").alias("value")))
    return F.min(ranked)["value"]


def clusters_of(counts: DataFrame) -> DataFrame:
    """One row per key: mentions, and majority city, state and zip."""
    return counts.where(F.col("field") != "name").groupBy("norm").agg(
        F.sum(F.when(F.col("field") == "mentions", F.col("n"))).alias("mentions"),
        _most_common("city").alias("city"),
        _most_common("state").alias("state"),
        _most_common("zip").alias("zip"),
    )


def blocks_of(clusters: DataFrame) -> DataFrame:
    """Every cluster with its block keys: first word and four-character prefix."""
    keys = F.array(
        F.concat(F.lit("t:"), tokens(F.col("norm"))[0]),
        F.concat(F.lit("p:"), F.substring("norm", 1, BLOCK_PREFIX)),
    )
    return clusters.withColumn("block", F.explode(keys))


def block_sizes(clusters: DataFrame) -> DataFrame:
    """Clusters per block."""
    return blocks_of(clusters).groupBy("block").agg(F.count(F.lit(1)).alias("clusters"))


def _needed_blocks(clusters: DataFrame) -> DataFrame:
    """Blocks without those another one implies: names with an equal first word of four
    or more characters have an equal prefix, so only short first words need their block."""
    short = F.length(tokens(F.col("norm"))[0]) < BLOCK_PREFIX
    return blocks_of(clusters).where(F.col("block").startswith("p:") | short)


def _grams(s: Column, q: int) -> Column:
    last = F.length(s) - (q - 1)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: s.substr(i, F.lit(q)))
    return F.when(last >= 1, pieces).otherwise(F.array().cast("array<string>"))


def _always_overlap(q: int, least: float) -> int | None:
    """Length from which two names within the distance must share a q-gram; none if the
    distance grows as fast as the name.

    A name of ``n`` has ``n - q + 1`` grams and loses ``q * floor((1 - least) * n)`` at most,
    which leaves one at any length from ``q / (1 - q * (1 - least))``.
    """
    left = 1 - q * (1 - least)
    if left <= 1e-6:
        return None
    short = 1
    for n in range(1, math.ceil(q / left) + 2):
        if n - q + 1 - q * math.floor((1 - least) * n + 1e-9) < 1:
            short = n + 1
    return short


def _prefix(s: Column, shared: Column, q: int, least: float) -> Column:
    """The rarest q-grams of a name, as many as the distance needs.

    With ``d`` edits at most ``q * d`` grams of the longer name are lost. So after sorting
    the grams of both names in one order, the first ``q * d + 1`` of each have a common
    element. Grams of the block key are in every name of the block and come last.
    """
    coded = F.transform(
        _grams(s, q),
        lambda g: F.concat(
            F.when(F.contains(shared, g), F.lit("1")).otherwise(F.lit("0")),
            F.translate(g, BY_FREQUENCY, RARITY_CODES),
        ),
    )
    keep = F.floor(F.length(s) * F.lit(q * (1 - least)) + 1e-6).cast("int") + 1
    return F.array_distinct(F.slice(F.array_sort(coded), F.lit(1), keep))


def _under(head: Column, pieces: Column) -> Column:
    """Each piece with the head in front; no pieces give an empty array."""
    joined = F.transform(pieces, lambda g: F.concat_ws(SEPARATOR, head, g))
    return F.coalesce(joined, F.array().cast("array<string>"))


def signatures_of(clusters: DataFrame, t: Thresholds) -> DataFrame:
    """Cluster rows repeated for every signature; candidates share one.

    The distance allowed depends on the boost, and larger boosts need an equal place. So
    there are three tiers: the block alone, block with city and state, block with zip.
    """
    sorted_name = F.col("sorted")
    place = F.concat_ws("/", "state", "city")
    tiers = [
        ("any", F.lit(""), F.lit(True), max(STATE_BOOST, CITY_BOOST)),
        (
            "place",
            place,
            F.col("state").isNotNull() & F.col("city").isNotNull(),
            STATE_BOOST + CITY_BOOST,
        ),
        ("zip", F.col("zip"), F.col("zip").isNotNull(), ZIP_BOOST + STATE_BOOST + CITY_BOOST),
    ]
    shared = F.substring("block", F.lit(3), F.length("block"))
    length = F.length(sorted_name)
    parts = []
    for tier, where, applies, boost in tiers:
        least = t.least_ratio(boost)
        short = _always_overlap(2, least)
        for q, fits in ((2, F.lit(True)), (1, F.lit(True) if short is None else length < short)):
            pieces = F.when(applies & fits, _prefix(sorted_name, shared, q, least))
            head = F.concat_ws(SEPARATOR, F.lit(f"{tier}{q}"), "block", where)
            parts.append(_under(head, pieces))
    return (
        _needed_blocks(clusters.withColumn("sorted", sorted_tokens(F.col("norm"))))
        .withColumn("signature", F.explode(F.concat(*parts)))
        .select("signature", "norm", "sorted", "city", "state", "zip")
    )


def _equal(field: str) -> Column:
    return F.coalesce(F.col(f"a.{field}") == F.col(f"b.{field}"), F.lit(False))


def candidate_pairs(
    clusters: DataFrame, t: Thresholds = Thresholds(), hot: int = HOT_SIGNATURE
) -> DataFrame:
    """Unordered pairs of clusters in one block that can still reach the review score.

    Columns ``a < b``, the token-sort ratio and the boost. Signatures held by more than
    ``hot`` clusters are split: the group becomes a grid, each half of a pair falls into
    a row or a column of it, and every cell is a join key of its own.
    """
    rows = signatures_of(clusters, t)
    sides = (
        rows.groupBy("signature")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > hot)
        .select("signature", F.ceil(F.col("n") / hot).cast("int").alias("side"))
    )
    slot = F.pmod(F.xxhash64("norm"), F.col("side")).cast("int")
    placed = (
        rows.join(sides, "signature", "left")
        .withColumn("side", F.coalesce("side", F.lit(1)))
        .withColumn("slot", slot)
    )
    # A pair in slots i <= j meets in cell (i, j) only.
    lower = placed.withColumn("i", F.col("slot")).withColumn(
        "j", F.explode(F.sequence(F.col("slot"), F.col("side") - 1))
    )
    upper = placed.withColumn("j", F.col("slot")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("slot")))
    )
    same_cell = (
        (F.col("a.signature") == F.col("b.signature"))
        & (F.col("a.i") == F.col("b.i"))
        & (F.col("a.j") == F.col("b.j"))
    )
    once = (F.col("a.i") < F.col("a.j")) | (F.col("a.norm") < F.col("b.norm"))
    return _reaching(lower, upper, same_cell & once & (F.col("a.norm") != F.col("b.norm")), t)


def candidates_of(
    changed: DataFrame, clusters: DataFrame, t: Thresholds = Thresholds(), hot: int = HOT_SIGNATURE
) -> DataFrame:
    """The candidate pairs of ``clusters`` that have a cluster of ``changed``, which are among
    them. Only blocks of changed clusters are looked at.

    A hot signature becomes a grid here too: changed clusters fall into its rows, all
    clusters into its columns, and each is copied to the cells of its row or column.
    """
    own = signatures_of(changed, t)
    met = _needed_blocks(changed).select("block").distinct()
    near = _needed_blocks(clusters).join(met, "block", "left_semi").select("norm").distinct()
    others = signatures_of(clusters.join(near, "norm", "left_semi"), t)
    others = others.join(changed.select("norm", F.lit(True).alias("also")), "norm", "left")
    sizes = [
        rows.groupBy("signature").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias(side))
        for rows, side in ((own, "own_sides"), (others, "other_sides"))
    ]
    sides = sizes[0].join(sizes[1], "signature").where("own_sides > 1 or other_sides > 1")
    placed = []
    for rows, mine, across in ((own, "own_sides", "other_sides"), (others, "other_sides", "own_sides")):
        rows = rows.join(sides, "signature", "left").withColumn(
            "slot", F.pmod(F.xxhash64("norm"), F.coalesce(mine, F.lit(1))).cast("int")
        )
        cells = F.sequence(F.lit(0), F.coalesce(across, F.lit(1)) - 1)
        placed.append(rows.withColumn("cell", F.explode(cells)))
    same_cell = (
        (F.col("a.signature") == F.col("b.signature"))
        & (F.col("a.slot") == F.col("b.cell"))
        & (F.col("a.cell") == F.col("b.slot"))
    )
    once = F.col("b.also").isNull() | (F.col("a.norm") < F.col("b.norm"))
    return _reaching(*placed, same_cell & once & (F.col("a.norm") != F.col("b.norm")), t)


def _reaching(left: DataFrame, right: DataFrame, met: Column, t: Thresholds) -> DataFrame:
    """Pairs of rows that meet and can reach the review score: ``a < b``, ratio and boost."""
    boost = (
        F.when(_equal("zip"), ZIP_BOOST).otherwise(0.0)
        + F.when(_equal("state"), STATE_BOOST).otherwise(0.0)
        + F.when(_equal("city"), CITY_BOOST).otherwise(0.0)
    )
    longest = F.greatest(F.length("a.sorted"), F.length("b.sorted"))
    shortest = F.least(F.length("a.sorted"), F.length("b.sorted"))
    allowed = F.floor((2 - 2 * (F.lit(t.review) - boost)) * longest + 1e-6).cast("int")
    no_conflict = F.coalesce(F.col("a.state") == F.col("b.state"), F.lit(True))
    # With a bound the distance is only followed within it; beyond it is -1.
    distance = F.call_function("levenshtein", F.col("a.sorted"), F.col("b.sorted"), allowed)
    near = (longest - shortest <= allowed) & (distance >= 0)
    pairs = left.alias("a").join(right.alias("b"), met & no_conflict & near)
    ratio = 1 - distance / longest
    # Jaro is at most (2 + shortest / longest) / 3, which bounds Jaro-Winkler in turn.
    best_jaro = (2 + shortest / longest) / 3
    best = 0.5 * (0.4 + 0.6 * best_jaro) + 0.5 * ratio + boost
    return (
        pairs.where(best >= t.review - 1e-9)
        .select(
            F.least("a.norm", "b.norm").alias("a"),
            F.greatest("a.norm", "b.norm").alias("b"),
            ratio.alias("token_sort_ratio"),
            boost.alias("boost"),
        )
        .dropDuplicates(["a", "b"])
    )


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Name similarity and final score of candidate pairs."""
    similarity = 0.5 * F.col("jaro_winkler") + 0.5 * F.col("token_sort_ratio")
    return (
        pairs.withColumn("jaro_winkler", jaro_winkler("a", "b"))
        .withColumn("name_similarity", similarity)
        .withColumn("score", F.least(F.lit(1.0), F.col("name_similarity") + F.col("boost")))
    )


def merge_edges(scored: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return scored.where(F.col("score") >= t.merge).select("a", "b", "score")


def review_pairs(scored: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Pairs too weak to merge and too close to ignore, best first."""
    band = (F.col("score") >= t.review) & (F.col("score") < t.merge)
    # Rounds the exact binary value; format_string rounds its shortest decimal form, in which
    # 0.9125 looks like a tie.
    reason = F.concat(F.lit("name "), F.format_number("name_similarity", 3))
    return scored.where(band).select(
        F.col("a").alias("normalized_a"), F.col("b").alias("normalized_b"), "score", reason.alias("reason")
    ).orderBy(F.desc("score"), "normalized_a", "normalized_b")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a vertex to the least one around it."""
    both = edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    )
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    linked = both.where(F.col("b") > F.col("a")).join(least, "a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a vertex and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return linked.unionByName(own).where(F.col("a") != F.col("b")).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every vertex points once, and only at vertices that point nowhere."""
    parents = edges.select(F.col("b").alias("a")).distinct()
    chained = edges.join(parents, "a", "left_semi").select("a")
    forked = edges.groupBy("a").count().where("count > 1").select("a")
    return chained.unionByName(forked).limit(1).count() == 0


def component_labels(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list: ``(norm, component)`` for every vertex but
    the least of each component, which is the label.

    Alternating large and small stars need a number of rounds logarithmic in the size of
    the component, however long its chains. Each round is written to the checkpoint
    folder; the driver only learns whether another one is needed.
    """
    current = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while not _is_star_forest(current):
        current = cut(_small_star(_large_star(current)))
    return current.select(F.col("a").alias("norm"), F.col("b").alias("component"))


def label_clusters(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """Every cluster with its component; clusters without merge edges are their own."""
    return (
        clusters.select("norm", "state")
        .join(labels, "norm", "left")
        .withColumn("component", F.coalesce("component", "norm"))
    )


def assemble(
    counts: DataFrame, labelled: DataFrame, edges: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vendors, their spellings, and the assignment of keys to vendors.

    The confidence of a vendor is its weakest merge edge, one when there is none.
    Spellings stay a long table: a vendor may have any number of them.
    """
    attributes, summed = component_attributes(counts, labelled, edges)
    return vendor_tables(attributes, summed, labelled)


def component_attributes(
    counts: DataFrame, labelled: DataFrame, edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """A row per component with all a vendor shows, and the summed counts of its values. The
    vendor id is the one the component gets if it has none yet."""
    member = labelled.select("norm", "component")
    summed = (
        counts.join(member, "norm")
        .groupBy("component", "field", "value")
        .agg(F.sum("n").alias("n"))
    )
    weakest = (
        edges.join(member.withColumnRenamed("norm", "a"), "a")
        .groupBy("component")
        .agg(F.min("score").alias("confidence"))
    )
    is_member = F.col("field") == "mentions"
    attributes = (
        summed.groupBy("component")
        .agg(
            _most_common("name").alias("canonical_name"),
            _most_common("mentions").alias("normalized_name"),
            _most_common("city").alias("city"),
            _most_common("state").alias("state"),
            _most_common("zip").alias("zip"),
            F.sum(F.when(is_member, F.col("n"))).alias("mention_count"),
            F.count_if(F.col("field") == "name").alias("variant_count"),
            F.count_if(is_member).alias("member_count"),
            set_fingerprint(F.when(is_member, F.col("value"))).alias("_print"),
        )
        .join(weakest, "component", "left")
        .withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
        .withColumn("canonical_name", F.coalesce("canonical_name", F.lit(UNKNOWN_VENDOR)))
        .withColumn("vendor_id", F.concat_ws("-", slug(F.col("normalized_name")), "_print"))
    )
    return attributes, summed


def vendor_tables(
    attributes: DataFrame, summed: DataFrame, labelled: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vendors, spellings and assignment, with the vendor ids that ``attributes`` has."""
    ids = attributes.select("component", "vendor_id")
    vendors = attributes.select(
        "vendor_id",
        "canonical_name",
        "normalized_name",
        "city",
        "state",
        "zip",
        "confidence",
        "mention_count",
        "variant_count",
        "member_count",
    )
    variants = (
        summed.where(F.col("field") == "name")
        .join(ids, "component")
        .select("vendor_id", F.col("value").alias("variant"), F.col("n").alias("mentions"))
    )
    assignment = labelled.select("norm", "component").join(ids, "component").select(
        F.col("norm").alias("vendor_name_normalized"), "vendor_id"
    )
    return vendors, variants, assignment


def resolve_vendors(mentions: DataFrame, t: Thresholds = Thresholds()) -> Resolution:
    """Run all stages. Shared intermediate tables are checkpointed once. Clusters are few bytes
    but much work to compare, so they are dealt to all tasks whatever their size."""
    counts = cut(value_counts(mentions))
    tasks = max(mentions.sparkSession.sparkContext.defaultParallelism, counts.rdd.getNumPartitions())
    clusters = cut(clusters_of(counts).repartition(tasks, "norm"))
    scored = cut(score_pairs(candidate_pairs(clusters, t)))
    edges = merge_edges(scored, t)
    labels = component_labels(edges)
    labelled = label_clusters(clusters, labels)
    vendors, variants, assignment = assemble(counts, labelled, edges)
    return Resolution(
        vendors, variants, assignment, review_pairs(scored, t), clusters, scored, labelled
    )


def most_mentioned_first(vendors: DataFrame) -> DataFrame:
    return vendors.orderBy(F.desc("mention_count"), F.asc("vendor_id"))


def mixed_state_components(labelled: DataFrame) -> DataFrame:
    """Components joined through a stateless cluster although their states differ."""
    return (
        labelled.where(F.col("state").isNotNull())
        .groupBy("component")
        .agg(F.count_distinct("state").alias("states"))
        .where(F.col("states") > 1)
    )
