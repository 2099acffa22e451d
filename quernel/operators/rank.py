"""Ranking within groups: best rows, caps, quotas, near ties, sweeps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], to: str = "rank") -> DataFrame:
    group = [group] if isinstance(group, str) else list(group)
    return df.withColumn(to, F.row_number().over(W.partitionBy(*group).orderBy(*order)))


def best(df: DataFrame, group: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in a total order; the last column of the order breaks ties as input order would."""
    return top(df, group, order, 1)


def top(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return ranked(df, group, order, "\x01rank").where(F.col("\x01rank") <= k).drop("\x01rank")


def positives_then_fill(df: DataFrame, group: str, positive: str, order: Sequence[Column], k: int) -> DataFrame:
    """All positives of a group, and negatives in order until there are k."""
    r = ranked(df, group, [F.col(positive).desc(), *order], "\x01rank")
    return r.where(F.col(positive) | (F.col("\x01rank") <= k)).drop("\x01rank")


def quota_then_fill(df: DataFrame, group: str, order: Sequence[Column], quota: int, limit: int) -> DataFrame:
    """Up to `quota` rows of each group first, then others in order, `limit` in all: a top-k report."""
    r = ranked(df, group, order, "\x01rank").withColumn("tier", F.when(F.col("\x01rank") <= quota, 0).otherwise(1))
    return r.orderBy("tier", *order).limit(limit).drop("\x01rank")


def near_best_earliest(df: DataFrame, group: str, score: str, step: str, tolerance: float) -> DataFrame:
    """The earliest step whose score is within `tolerance` of its group's best."""
    w = W.partitionBy(group)
    near = df.withColumn("\x01best", F.max(score).over(w)).where(F.col(score) >= F.col("\x01best") - tolerance).drop("\x01best")
    return best(near, group, [F.col(step)])


def top_two(df: DataFrame, group: str, value: str) -> DataFrame:
    """The greatest and second-greatest value of each group, by two small aggregates and no list."""
    w = W.partitionBy(group).orderBy(F.col(value).desc())
    r = df.select(group, value).withColumn("\x01r", F.row_number().over(w)).where("`\x01r` <= 2")
    return r.groupBy(group).agg(F.max(F.when(F.col("\x01r") == 1, F.col(value))).alias("best"), F.max(F.when(F.col("\x01r") == 2, F.col(value))).alias("second"))


def sibling_features(df: DataFrame, group: str, votes: str, score: str) -> DataFrame:
    """Each row's share of its group's votes, its margin over the best other score, and log votes."""
    w = W.partitionBy(group)
    pair = top_two(df, group, score)
    out = df.withColumn("vote_share", F.col(votes) / F.sum(votes).over(w)).join(pair, group)
    other = F.when(F.col(score) == F.col("best"), F.col("second")).otherwise(F.col("best"))
    return out.withColumn("margin", F.coalesce(F.col(score) - other, F.lit(0.0))).withColumn("log_votes", F.log1p(F.col(votes).cast("double"))).drop("best", "second")


def spread_rank(df: DataFrame, group: str, order: Column, tie: Column, to: str = "rank", size_to: str | None = None) -> DataFrame:
    """df with each row's place in its group by a hash in hexadecimal, and the group's size if asked for.

    Places are counted within 4,096 ranges of the hash and shifted by the sizes
    of the ranges before, so a hot group is no single task. Null is a group.
    """
    d = df.withColumn("\x01h", order).withColumn("\x01t", tie).withColumn("\x01b", F.substring("\x01h", 1, 3))
    sizes = d.groupBy(F.col(group).alias("\x01g"), F.col("\x01b").alias("\x01c")).agg(F.count(F.lit(1)).alias("\x01n"))
    w = W.partitionBy("\x01g")
    before = sizes.select("\x01g", "\x01c", F.coalesce(F.sum("\x01n").over(w.orderBy("\x01c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("\x01s"), F.sum("\x01n").over(w).alias("\x01z"))
    d = d.withColumn("\x01i", F.row_number().over(W.partitionBy(group, "\x01b").orderBy("\x01h", "\x01t")))
    d = d.join(before, F.col(group).eqNullSafe(F.col("\x01g")) & (F.col("\x01b") == F.col("\x01c")))
    return d.select(*df.columns, (F.col("\x01i") + F.col("\x01s")).alias(to), *([F.col("\x01z").alias(size_to)] if size_to else []))


def threshold_sweep(df: DataFrame, group: str, score: str, gain: str, rows: str | None = None, parts: int = 64) -> DataFrame:
    """For each score of a group as a threshold: rows at or above it and their summed gain; ties move together.

    Rows are first summed by score (`rows` says how many each stands for). The
    scores of a group are cut at its percentiles; sums run within a part and
    are shifted by what the parts above hold, so no task sees a whole group.
    """
    n = F.sum(rows) if rows else F.count(F.lit(1))
    cells = df.groupBy(group, F.col(score).alias("threshold")).agg(n.alias("\x01n"), F.sum(gain).alias("\x01s"))
    cuts = cells.groupBy(F.col(group).alias("\x01g")).agg(F.percentile_approx("threshold", [i / parts for i in range(1, parts)]).alias("\x01cuts"))
    above = F.coalesce(F.size(F.filter("\x01cuts", lambda c: c > F.col("threshold"))), F.lit(0))
    part = F.when(F.col("threshold").isNull(), parts).otherwise(above)
    cells = cells.join(cuts, F.col(group).eqNullSafe(F.col("\x01g"))).withColumn("\x01p", part).drop("\x01g", "\x01cuts")
    sums = cells.groupBy(F.col(group).alias("\x01g"), F.col("\x01p").alias("\x01q")).agg(F.sum("\x01n").alias("\x01n"), F.sum("\x01s").alias("\x01s"))
    over = W.partitionBy("\x01g").orderBy("\x01q").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("\x01g", "\x01q", F.coalesce(F.sum("\x01n").over(over), F.lit(0)).alias("\x01bn"), F.sum("\x01s").over(over).alias("\x01bs"))
    inner = W.partitionBy(group, "\x01p").orderBy(F.col("threshold").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = cells.withColumn("\x01n", F.sum("\x01n").over(inner)).withColumn("\x01s", F.sum("\x01s").over(inner))
    cells = cells.join(before, F.col(group).eqNullSafe(F.col("\x01g")) & (F.col("\x01p") == F.col("\x01q")))
    return cells.select(group, "threshold", (F.col("\x01n") + F.col("\x01bn")).alias("n_at_or_above"), F.coalesce(F.col("\x01s") + F.col("\x01bs"), F.col("\x01s"), F.col("\x01bs")).alias("gain"))


def curriculum(df: DataFrame, tiers: Mapping[str, int], tier_column: str, within: Column) -> DataFrame:
    """Rows with their place in a curriculum: by tier, then by the given order within it; ranges of both, so no task orders a tier."""
    pairs = [F.lit(v) for kv in tiers.items() for v in kv]
    t = df.withColumn("tier", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(tier_column)), F.lit(len(tiers))))
    placed = ordinal(t.withColumn("\x01w", within), "tier", "\x01w")
    return placed.withColumn("place", F.col("ord") + 1).drop("\x01w", "ord")


#: Keys that the ranges of an order are cut by, and ranges; each is found by steps of halving.
RANGE_SAMPLE, RANGE_STEPS = 1 << 12, (128, 64, 32, 16, 8, 4, 2, 1)


def ordinal(df: DataFrame, *order) -> DataFrame:
    """df with `ord`, 0, 1, ... in the given ascending order: ranges first, then places within each, so no task orders all rows.

    Ranges are cut at distinct keys of least hash, so every reading of df deals
    its rows alike, however it is split; equal keys share a range. The cuts only
    balance the tasks: a row's number is its place in all rows.
    """
    key = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)])
    keys = df.select(key.alias("\x01k")).distinct().orderBy(F.xxhash64("\x01k"), "\x01k").limit(RANGE_SAMPLE)
    cuts = keys.agg(F.sort_array(F.collect_list("\x01k")).alias("\x01all"))
    n, parts = F.size("\x01all"), 2 * RANGE_STEPS[0]
    cuts = cuts.select(F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get("\x01all", F.floor(i * n / parts).cast("int"))).alias("\x01cuts"))
    step = lambda at, s: F.when(F.get("\x01cuts", at + s - 1) <= F.col("\x01k"), at + s).otherwise(at)
    parts = df.withColumn("\x01k", key).join(F.broadcast(cuts))  # one row
    parts = parts.withColumn("\x01p", F.aggregate(F.array(*map(F.lit, RANGE_STEPS)), F.lit(0), step)).drop("\x01cuts")
    sizes = parts.groupBy("\x01p").agg(F.count(F.lit(1)).alias("\x01n"))
    before = sizes.select("\x01p", F.coalesce(F.sum("\x01n").over(W.orderBy("\x01p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("\x01b"))
    parts = parts.withColumn("\x01i", F.row_number().over(W.partitionBy("\x01p").orderBy(*order)))
    return parts.join(F.broadcast(before), "\x01p").withColumn("ord", (F.col("\x01i") + F.col("\x01b") - 1).cast("long")).drop("\x01p", "\x01k", "\x01i", "\x01b")


def running(df: DataFrame, group: str | None, major: str, minor: str, value: str, to: str, span: int = 1 << 16) -> DataFrame:
    """df with the sum of `value` over a group's rows up to this one, in the order of major and minor, an integer.

    Sums run within ranges of `span` values of minor and are shifted by the
    sums of the ranges before, of which there is one row each; so neither a hot
    group nor all rows are one task. Rows of equal place are summed together.
    """
    groups = [group] if group else []
    d = df.withColumn("\x01part", F.floor(F.col(minor) / span))
    sums = d.groupBy(*[F.col(g).alias(f"\x01g{g}") for g in groups], F.col(major).alias("\x01major"), F.col("\x01part").alias("\x01p")).agg(F.sum(value).alias("\x01sum"))
    earlier = W.partitionBy(*[f"\x01g{g}" for g in groups]).orderBy("\x01major", "\x01p").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("\x01before", F.coalesce(F.sum("\x01sum").over(earlier), F.lit(0)))
    within = W.partitionBy(*groups, major, "\x01part").orderBy(minor)
    d = d.withColumn("\x01within", F.sum(value).over(within))
    same = F.col(major).eqNullSafe(F.col("\x01major")) & F.col("\x01part").eqNullSafe(F.col("\x01p"))
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"\x01g{g}"))
    return d.join(sums, same).select(*df.columns, (F.col("\x01within") + F.col("\x01before")).alias(to))
