"""Small helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and bytes (written as text) a side may have to be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000
#: Rows that watch rules may have to be broadcast; they are narrow, and beyond it all facts are
#: shuffled. The bound in bytes holds for them as well.
RULE_ROWS = 1_000_000
#: Copies of the rule side, and shares of the fact side, when it is too large to broadcast.
SALTS = 64
KEY_SEPARATOR = "\x1f"


def ranked(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group. Spark limits each group before the shuffle, so
    a hot group sends at most ``n`` rows per task."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def descending(c: str | Column) -> Column:
    """Largest first with nulls first, as the stored queries order."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def ascending(c: str | Column) -> Column:
    """Smallest first with nulls last."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def fits_broadcast(
    df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES
) -> bool:
    """Whether ``df`` has at most ``rows`` rows and about ``size`` bytes at most; looks no
    further than one row beyond."""
    text = F.octet_length(F.to_json(F.struct("*")))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(text).alias("size")).first()
    return found["n"] <= rows and (found["size"] or 0) <= size


def join_rules(
    facts: DataFrame, rules: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a large fact table with a rule table on equal columns.

    Rules are broadcast when counted to be few. Otherwise facts are spread over salts and
    the rules copied to each, so one hot key is shared by many tasks.
    """
    if fits_broadcast(rules, most):
        return facts.join(F.broadcast(rules), on, how)
    # A hash of the row itself: a task that is run again puts every row where it was.
    seed = F.pmod(F.xxhash64(*facts.columns), F.lit(SALTS)).cast("int")
    copies = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return facts.withColumn("_salt", seed).join(copies, [*on, "_salt"], how).drop("_salt")


def join_wildcards(facts: DataFrame, rules: DataFrame, on: dict[str, str]) -> DataFrame:
    """Join where a null rule column accepts every fact and any other must be equal.

    ``on`` maps fact columns to rule columns. A rule's key is the set of columns it fills
    with their values; a fact gets one key per set that occurs among the rules, at most
    ``2**len(on)``. So facts are scanned once and the join is on equal keys, with no loop
    over all pairs. Sets of columns that too many rules fill to be broadcast are joined apart, so
    that a fact is shuffled with its key of that set only.
    """
    filled = [F.col(c).isNotNull() for c in on.values()]
    pattern = F.concat_ws("", *[F.when(c, "1").otherwise("0") for c in filled])
    found = rules.groupBy(pattern.alias("pattern")).count().orderBy("count", "pattern").collect()
    few, many, total = [], [], 0
    for row in found:
        total += row["count"]
        (few if total <= RULE_ROWS else many).append(row["pattern"])
    rules = rules.withColumn("_key", F.concat_ws(KEY_SEPARATOR, pattern, *on.values()))
    own = rules.where(pattern.isin(few)) if many else rules
    if many and few and not fits_broadcast(own, RULE_ROWS):
        few, many, own = [], [*few, *many], None
    parts = []
    if few or not many:
        keys = F.array_compact(F.array(*[_pattern_key(p, list(on)) for p in few]).cast("array<string>"))
        keyed = facts.withColumn("_key", F.explode(keys))
        parts.append(join_rules(keyed, own, ["_key"], most=RULE_ROWS))
    for p in many:
        # Rules too many to broadcast: facts are shuffled once for each such set of columns, by one key.
        keyed = facts.withColumn("_key", _pattern_key(p, list(on))).where(F.col("_key").isNotNull())
        parts.append(join_rules(keyed, rules.where(pattern == p), ["_key"]))
    return reduce(DataFrame.unionByName, parts).drop("_key")


def _pattern_key(pattern: str, columns: list[str]) -> Column:
    """Key of a fact under one pattern, a digit 1 per filled column; null when it lacks a value the
    pattern fills."""
    used = [F.col(c) for c, p in zip(columns, pattern) if p == "1"]
    key = F.concat_ws(KEY_SEPARATOR, F.lit(pattern), *used)
    if not used:
        return key
    known = used[0].isNotNull()
    for c in used[1:]:
        known = known & c.isNotNull()
    return F.when(known, key)
