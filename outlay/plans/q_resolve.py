"""Entity resolution over payee mentions built from the driver tables.

Every line item mentions the payee of its part. The SQL side compares all pairs of a block
and follows merge edges with a recursive query, so it checks that the signature join and
the star rounds lose nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from outlay.functions import names, similarity
from outlay.operators import explore, incremental, resolve
from outlay.plans.catalog import CTES, query, sql
from outlay.plans.q_normalize import payees
from outlay.plans.txn import table
from outlay.session import stored

# Jaro by its definition. The built-in function of the SQL side rounds half transpositions
# down. Walks over the characters of a, marking the characters of b that are taken.
_HIT = """list_min(list_filter(
           range(greatest(0, e.i - reach), least(e.i + reach + 1, length(b))),
           lambda j: substr(b, j + 1, 1) = substr(a, e.i + 1, 1) AND (s.used >> j) % 2 = 0))"""
JARO = f"""
  SELECT * EXCLUDE (reach, walked, other), CASE WHEN a = b THEN 1e0 WHEN length(other) = 0 THEN 0e0
           ELSE (length(other) / CAST(length(a) AS DOUBLE) + length(other) / CAST(length(b) AS DOUBLE)
                 + (length(other) - len(list_filter(range(1, length(other) + 1),
                      lambda k: substr(walked.seq, k, 1) <> substr(other, k, 1))) / 2e0)
                   / length(other)) / 3 END AS jaro,
         CASE WHEN left(a, 4) = left(b, 4) AND least(length(a), length(b)) >= 4 THEN 4
              WHEN left(a, 3) = left(b, 3) THEN 3 WHEN left(a, 2) = left(b, 2) THEN 2
              WHEN left(a, 1) = left(b, 1) THEN 1 ELSE 0 END AS prefix
  FROM (SELECT *, array_to_string(list_transform(list_filter(range(length(b)),
                    lambda j: (walked.used >> j) % 2 = 1), lambda j: substr(b, j + 1, 1)), '')
                    AS other
        FROM (SELECT *, list_reduce(
                list_transform(range(length(a)),
                  lambda i: {{'i': i, 'used': CAST(0 AS BIGINT), 'seq': ''}}),
                lambda s, e: {{'i': e.i,
                  'used': s.used + coalesce(CAST(1 AS BIGINT) << {_HIT}, 0),
                  'seq': s.seq || CASE WHEN {_HIT} IS NULL THEN '' ELSE substr(a, e.i + 1, 1) END}},
                {{'i': CAST(-1 AS BIGINT), 'used': CAST(0 AS BIGINT), 'seq': ''}}) AS walked
              FROM (SELECT *, greatest(length(a), length(b)) // 2 - 1 AS reach FROM source)))"""

CTES["value_count"] = """
  SELECT norm, field, value, count(*) AS n
  FROM (SELECT norm, unnest(['mentions', 'name', 'city', 'state', 'zip']) AS field,
               unnest([norm, upper_name, city, state, zip]) AS value
        FROM lineitem JOIN payee_key ON p_partkey = l_partkey)
  WHERE value IS NOT NULL GROUP BY ALL"""
CTES["cluster"] = """
  SELECT norm, sum(n) FILTER (field = 'mentions') AS mentions,
         first(value ORDER BY n DESC, value) FILTER (field = 'city') AS city,
         first(value ORDER BY n DESC, value) FILTER (field = 'state') AS state,
         first(value ORDER BY n DESC, value) FILTER (field = 'zip') AS zip,
         array_to_string(list_sort(string_split(norm, ' ')), ' ') AS sorted
  FROM value_count GROUP BY norm"""
CTES["pair"] = """
  SELECT *, 1 - edits / CAST(longest AS DOUBLE) AS token_sort_ratio,
         0.5e0 * (0.4e0 + 0.6e0 * (2 + shortest / CAST(longest AS DOUBLE)) / 3)
           + 0.5e0 * (1 - edits / CAST(longest AS DOUBLE)) + boost AS best
  FROM (SELECT a.norm AS a, b.norm AS b, levenshtein(a.sorted, b.sorted) AS edits,
               greatest(length(a.norm), length(b.norm)) AS longest,
               least(length(a.norm), length(b.norm)) AS shortest,
               CASE WHEN a.zip = b.zip THEN 0.05e0 ELSE 0e0 END
                 + CASE WHEN a.state = b.state THEN 0.03e0 ELSE 0e0 END
                 + CASE WHEN a.city = b.city THEN 0.02e0 ELSE 0e0 END AS boost
        FROM cluster a JOIN cluster b ON a.norm < b.norm
          AND (split_part(a.norm, ' ', 1) = split_part(b.norm, ' ', 1)
               OR left(a.norm, 4) = left(b.norm, 4))
        WHERE coalesce(a.state = b.state, true))"""
CTES["jaro"] = JARO.replace("FROM source", "FROM pair WHERE best >= 0.86 - 1e-9")
CTES["scored"] = """
  SELECT a, b, boost, name_similarity, least(1e0, name_similarity + boost) AS score
  FROM (SELECT *, 0.5e0 * (jaro + prefix * 0.1e0 * (1 - jaro)) + 0.5e0 * token_sort_ratio
                    AS name_similarity FROM jaro)"""
CTES["edge"] = "\n  SELECT a, b, score FROM scored WHERE score >= 0.93"
CTES["walk"] = """
  SELECT norm, norm AS reached FROM cluster
  UNION
  SELECT w.norm, CASE WHEN e.a = w.reached THEN e.b ELSE e.a END
  FROM walk w JOIN edge e ON e.a = w.reached OR e.b = w.reached"""
CTES["label"] = "\n  SELECT norm, min(reached) AS component FROM walk GROUP BY norm"
CTES["summed"] = """
  SELECT component, field, value, sum(n) AS n
  FROM value_count JOIN label USING (norm) GROUP BY ALL"""
CTES["vendor"] = """
  SELECT *, trim(regexp_replace(lower(normalized_name), '[^a-z0-9]+', '-', 'g'), '-') || '-'
            || left(sha256(member_count || '|' || xored || '|' || added), 12) AS vendor_id
  FROM (SELECT component,
               first(value ORDER BY n DESC, value) FILTER (field = 'name') AS canonical_name,
               first(value ORDER BY n DESC, value) FILTER (field = 'mentions') AS normalized_name,
               first(value ORDER BY n DESC, value) FILTER (field = 'city') AS city,
               first(value ORDER BY n DESC, value) FILTER (field = 'state') AS state,
               first(value ORDER BY n DESC, value) FILTER (field = 'zip') AS zip,
               CAST(sum(n) FILTER (field = 'mentions') AS BIGINT) AS mention_count,
               count(*) FILTER (field = 'name') AS variant_count,
               count(*) FILTER (field = 'mentions') AS member_count,
               bit_xor(CAST('0x' || left(md5(value), 15) AS BIGINT)) FILTER (field = 'mentions')
                 AS xored,
               sum(CAST('0x' || substr(md5(value), 16, 15) AS BIGINT)) FILTER (field = 'mentions')
                 AS added
        FROM summed GROUP BY component)
  LEFT JOIN (SELECT component, min(score) AS weakest
             FROM edge JOIN label ON norm = a GROUP BY component) USING (component)"""

_CLUSTER = ("payee", "payee_key", "value_count", "cluster")
_SCORED = (*_CLUSTER, "pair", "jaro", "scored")
_LABEL = (*_SCORED, "edge", "walk", "label")
_VENDOR = (*_LABEL, "summed", "vendor")


def mentions(spark, sf):
    """Parts as payees with the number ``n`` of their mentions. Lines are counted by part before
    they meet names, since there are many more of them than parts."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"))
    lines = lines.agg(F.count(F.lit(1)).alias("n"))
    named = payees(spark, sf).withColumn("name_raw", F.upper("name_raw"))
    return lines.join(named.withColumn("norm", names.vendor_key(F.col("name_raw"))), "p_partkey")


def _clusters(spark, sf):
    return resolve.clusters_of(resolve.value_counts(mentions(spark, sf)))


@query(
    "resolve_value_counts", sql("SELECT norm, field, value, n FROM value_count", *_CLUSTER[:3])
)
def resolve_value_counts(spark, sf):
    return resolve.value_counts(mentions(spark, sf))


@query(
    "resolve_exact_clusters",
    sql("SELECT norm, CAST(mentions AS BIGINT) AS mentions, city, state, zip FROM cluster", *_CLUSTER),
)
def resolve_exact_clusters(spark, sf):
    return _clusters(spark, sf)


@query(
    "resolve_blocks",
    sql(
        """SELECT block, count(*) AS clusters
FROM (SELECT 't:' || split_part(norm, ' ', 1) AS block FROM cluster
      UNION ALL SELECT 'p:' || left(norm, 4) FROM cluster) GROUP BY block""",
        *_CLUSTER,
    ),
)
def resolve_blocks(spark, sf):
    return resolve.block_sizes(_clusters(spark, sf))


@query(
    "resolve_pairs",
    sql(
        """SELECT a, b, round(token_sort_ratio, 6) AS token_sort_ratio, round(boost, 6) AS boost
FROM pair WHERE best >= 0.86 - 1e-9""",
        *_SCORED[:-2],
    ),
)
def resolve_pairs(spark, sf):
    found = resolve.candidate_pairs(_clusters(spark, sf))
    return found.withColumn("token_sort_ratio", F.round("token_sort_ratio", 6)).withColumn(
        "boost", F.round("boost", 6)
    )


@query(
    "resolve_pair_scores",
    sql(
        """SELECT a, b, round(name_similarity, 6) AS name_similarity, round(score, 6) AS score,
       score >= 0.93 AS merges FROM scored WHERE score >= 0.86""",
        *_SCORED,
    ),
)
def resolve_pair_scores(spark, sf):
    scored = resolve.score_pairs(resolve.candidate_pairs(_clusters(spark, sf)))
    return scored.where(F.col("score") >= resolve.REVIEW).select(
        "a",
        "b",
        F.round("name_similarity", 6).alias("name_similarity"),
        F.round("score", 6).alias("score"),
        (F.col("score") >= resolve.MERGE).alias("merges"),
    )


@query(
    "review_queue",
    sql(
        """SELECT a AS normalized_a, b AS normalized_b, round(score, 6) AS score,
       'name ' || format('{:.3f}', name_similarity) AS reason
FROM scored WHERE score >= 0.86 AND score < 0.93""",
        *_SCORED,
    ),
)
def review_queue(spark, sf):
    scored = resolve.score_pairs(resolve.candidate_pairs(_clusters(spark, sf)))
    return resolve.review_pairs(scored).withColumn("score", F.round("score", 6))


@query(
    "resolve_components",
    sql("SELECT norm, component FROM label", *_LABEL, recursive=True),
)
def resolve_components(spark, sf):
    return resolve.resolve_vendors(mentions(spark, sf)).labels.select("norm", "component")


@query(
    "resolve_vendors",
    sql(
        """SELECT vendor_id, canonical_name, normalized_name, city, state, zip,
       round(coalesce(weakest, 1), 6) AS confidence, mention_count, variant_count, member_count
FROM vendor""",
        *_VENDOR,
        recursive=True,
    ),
)
def resolve_vendors(spark, sf):
    found = resolve.resolve_vendors(mentions(spark, sf)).vendors
    return resolve.most_mentioned_first(found.withColumn("confidence", F.round("confidence", 6)))


@query(
    "resolve_variants",
    sql(
        """SELECT vendor_id, value AS variant, CAST(n AS BIGINT) AS mentions
FROM summed JOIN vendor USING (component) WHERE field = 'name'""",
        *_VENDOR,
        recursive=True,
    ),
)
def resolve_variants(spark, sf):
    return resolve.resolve_vendors(mentions(spark, sf)).variants


@query(
    "resolve_assignment",
    sql(
        """SELECT vendor_id, count(*) AS mentions, count(DISTINCT p_partkey) AS parts
FROM lineitem JOIN payee_key ON p_partkey = l_partkey JOIN label USING (norm)
JOIN vendor USING (component) GROUP BY vendor_id""",
        *_VENDOR,
        recursive=True,
    ),
)
def resolve_assignment(spark, sf):
    rows = stored(mentions(spark, sf))
    assignment = resolve.resolve_vendors(rows).assignment
    assigned = rows.join(assignment.withColumnRenamed("vendor_name_normalized", "norm"), "norm")
    return assigned.groupBy("vendor_id").agg(
        F.sum("n").alias("mentions"), F.count_distinct("p_partkey").alias("parts")
    )


@query(
    "mixed_state_components",
    sql(
        """SELECT component, count(DISTINCT state) AS states
FROM label JOIN cluster USING (norm) GROUP BY component HAVING count(DISTINCT state) > 1""",
        *_LABEL,
        recursive=True,
    ),
)
def mixed_state_components(spark, sf):
    return resolve.mixed_state_components(resolve.resolve_vendors(mentions(spark, sf)).labels)


@query(
    "review_vendors",
    sql(
        """SELECT vendor_id, canonical_name, round(weakest, 6) AS confidence, state, variant_count
FROM vendor WHERE weakest < 1 ORDER BY weakest, vendor_id LIMIT 50""",
        *_VENDOR,
        recursive=True,
    ),
)
def review_vendors(spark, sf):
    vendors = resolve.resolve_vendors(mentions(spark, sf)).vendors
    return explore.review_vendors(vendors).select(
        "vendor_id",
        "canonical_name",
        F.round("confidence", 6).alias("confidence"),
        "state",
        "variant_count",
    )


# Two deliveries of the same payments: names of the second meet those of the first.
EARLY = "l_partkey % 4 <> 3"
_AT_ONCE = ("value_count", "cluster", "pair", "jaro", "scored", "edge", "walk", "label", "summed", "vendor")
for _name in _AT_ONCE:
    CTES[f"early_{_name}"] = re.sub(rf"\b({'|'.join(_AT_ONCE)})\b", r"early_\1", CTES[_name]).replace(
        "FROM lineitem JOIN", f"FROM (SELECT * FROM lineitem WHERE {EARLY}) JOIN"
    )
CTES["kept_id"] = """
  SELECT l.component, min(e.vendor_id) AS kept
  FROM early_vendor e JOIN label l ON l.norm = e.component GROUP BY l.component"""
CTES["current"] = """
  SELECT vendor.* EXCLUDE (vendor_id), coalesce(kept, vendor_id) AS vendor_id, kept IS NULL AS is_new
  FROM vendor LEFT JOIN kept_id USING (component)"""
_TWICE = (*_VENDOR, *[f"early_{n}" for n in _AT_ONCE], "kept_id", "current")


def _two_steps(spark, sf):
    rows = mentions(spark, sf).withColumnRenamed("p_partkey", "l_partkey")
    nothing = incremental.empty_state(spark)
    one = incremental.advance(nothing, rows.where(EARLY), 1)
    two = incremental.advance(incremental.stepped(nothing, one), rows.where(f"not ({EARLY})"), 2)
    return one, two


@query(
    "resolve_incremental",
    sql(
        """SELECT vendor_id, canonical_name, normalized_name, round(coalesce(weakest, 1), 6) AS confidence,
       mention_count, variant_count, member_count, is_new FROM current""",
        *_TWICE,
        recursive=True,
    ),
)
def resolve_incremental(spark, sf):
    one, two = _two_steps(spark, sf)
    left = one.vendors.join(two.affected, "vendor_id", "left_anti")
    founded = two.founders.where("run = 2").select("vendor_id", F.lit(True).alias("is_new"))
    vendors = left.unionByName(two.vendors).join(founded, "vendor_id", "left")
    return vendors.select(
        "vendor_id",
        "canonical_name",
        "normalized_name",
        F.round("confidence", 6).alias("confidence"),
        "mention_count",
        "variant_count",
        "member_count",
        F.coalesce("is_new", F.lit(False)).alias("is_new"),
    )


@query(
    "vendor_lineage",
    sql(
        """SELECT DISTINCT e.vendor_id AS old_id, c.vendor_id AS new_id,
       CASE WHEN e.vendor_id IN (SELECT vendor_id FROM current) THEN 'split' ELSE 'merged' END AS change
FROM early_vendor e JOIN early_label USING (component) JOIN label USING (norm)
JOIN current c ON c.component = label.component WHERE e.vendor_id <> c.vendor_id""",
        *_TWICE,
        recursive=True,
    ),
)
def vendor_lineage(spark, sf):
    return _two_steps(spark, sf)[1].lineage.drop("run")


CTES["worded"] = """
  SELECT p_partkey, p_name || ' ' || lower(p_type) AS a,
         split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || ' ' || lower(p_brand) AS b
  FROM part"""
CTES["worded_jaro"] = JARO.replace("FROM source", "FROM worded")


@query(
    "string_similarity",
    sql(
        """SELECT p_partkey,
       round(1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE), 6) AS ratio,
       round(1 - levenshtein(sa, sb) / CAST(greatest(length(a), length(b)) AS DOUBLE), 6)
         AS token_sort_ratio,
       round(len(list_intersect(ta, tb)) / CAST(len(list_distinct(list_concat(ta, tb))) AS DOUBLE), 6)
         AS token_jaccard,
       round(jaro + 0.1e0 * (1 - jaro) * prefix, 6) AS jaro_winkler
FROM (SELECT *, array_to_string(list_sort(ta), ' ') AS sa, array_to_string(list_sort(tb), ' ') AS sb
      FROM (SELECT *, string_split(a, ' ') AS ta, string_split(b, ' ') AS tb FROM worded_jaro))""",
        "worded",
        "worded_jaro",
    ),
)
def string_similarity(spark, sf):
    x = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    words = F.split("p_name", " ")
    y = F.concat_ws(" ", words[1], words[0], F.lower("p_brand"))
    part = table(spark, sf, "part").select("p_partkey", x.alias("x"), y.alias("y"))
    a, b = F.col("x"), F.col("y")
    return part.select(
        "p_partkey",
        F.round(similarity.ratio(a, b), 6).alias("ratio"),
        F.round(similarity.token_sort_ratio(a, b), 6).alias("token_sort_ratio"),
        F.round(similarity.token_jaccard(names.tokens(a), names.tokens(b)), 6).alias("token_jaccard"),
        F.round(similarity.jaro_winkler("x", "y"), 6).alias("jaro_winkler"),
    )
