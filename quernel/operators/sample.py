"""Splits, folds, caps, oversampling and mixtures, all decided by hashes and rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.functions.keys import entity_fraction, hash_order
from quernel.operators.graph import kept
from quernel.operators.rank import ranked, spread_rank


def entity_split(key: Column, shares: Sequence[tuple[str, float]], override: Column | None = None) -> Column:
    """The split of an entity by its hash; a given split wins."""
    x, out, edge = entity_fraction(key), F.lit(shares[-1][0]), 1.0
    for name, share in reversed(list(shares)[:-1]):
        edge = sum(s for n, s in shares[: [n for n, _ in shares].index(name) + 1])
        out = F.when(x < edge, F.lit(name)).otherwise(out)
    return out if override is None else F.coalesce(override, out)


def split_conflicts(df: DataFrame, key: str, split: str) -> DataFrame:
    """Entities that are in several splits."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def stratified_split(df: DataFrame, stratum: str, key: str, share: float, seed: int) -> DataFrame:
    """train or val by stratum: at least one row of val from strata of five, none from smaller, else the share rounded half to even."""
    r = spread_rank(df, stratum, hash_order(seed, key), F.col(key), "\x01rank", "\x01n")
    take = F.when(F.col("\x01n") < 5, 0).otherwise(F.greatest(F.lit(1), F.bround(F.col("\x01n") * F.lit(share)).cast("long")))
    return r.withColumn("split", F.when(F.col("\x01rank") <= take, "val").otherwise("train")).drop("\x01n", "\x01rank")


def oversampled(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as `times` says, with repeat_index from 0."""
    return df.withColumn("\x01t", times).where("`\x01t` > 0").withColumn("repeat_index", F.explode(F.sequence(F.lit(0), F.col("\x01t") - 1))).drop("\x01t")


def times_by_map(column: str, times: Mapping[str, int], default: int = 1) -> Column:
    pairs = [F.lit(v) for kv in times.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit(default))


def capped(df: DataFrame, group: str, key: str, cap: int, seed: int) -> DataFrame:
    """Up to `cap` rows of each group, in hash order: a sampling operator."""
    return spread_rank(df, group, hash_order(seed, key), F.col(key), "\x01rank").where(F.col("\x01rank") <= cap).drop("\x01rank")


def mixture(parts: Mapping[str, tuple[DataFrame, int | None]], key: str, seed: int) -> DataFrame:
    """The union of named parts, each capped in hash order if it has a cap."""
    out = None
    for name, (df, cap) in parts.items():
        p = df.withColumn("mixture", F.lit(name))
        p = p if cap is None else capped(p, "mixture", key, cap, seed)
        out = p if out is None else out.unionByName(p)
    return out


def water_filled(histogram: DataFrame, stratum: str, n: str, target: int) -> DataFrame:
    """histogram (a row a stratum) with `quota`: all strata get the same, short ones what they have, and what they lack goes to the others.

    Quotas add up to `target`, or to all rows if there are fewer. What is left
    over when the rest is shared equally goes to the strata that come first by
    size and name.
    """
    order = W.orderBy(n, stratum)
    d = histogram.withColumns({"\x01i": F.row_number().over(order) - 1, "\x01k": F.count(F.lit(1)).over(W.partitionBy())})
    d = d.withColumn("\x01before", F.coalesce(F.sum(n).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rest, others = F.lit(target) - F.col("\x01before"), F.col("\x01k") - F.col("\x01i")
    d = d.withColumns({"\x01level": F.floor(F.greatest(rest, F.lit(0)) / others), "\x01rest": rest, "\x01others": others})
    # the first stratum that has more than its share sets the level of all from there on
    first = F.min(F.when(F.col(n) > F.col("\x01level"), F.struct("\x01i", "\x01level", "\x01rest", "\x01others"))).over(W.partitionBy())
    d = d.withColumn("\x01first", first)
    at = F.col("\x01first")
    more = F.greatest(at["\x01rest"], F.lit(0)) - at["\x01level"] * at["\x01others"]
    share = at["\x01level"] + ((F.col("\x01i") - at["\x01i"]) < more).cast("long")
    quota = F.when(at.isNull() | (F.col("\x01i") < at["\x01i"]), F.col(n)).otherwise(share)
    return d.select(*histogram.columns, quota.cast("long").alias("quota"))


def balanced(df: DataFrame, stratum: str, key: str, target: int, seed: int) -> DataFrame:
    """`target` rows, as evenly from all strata as these allow, by hash within each: a sampling operator."""
    placed = spread_rank(df, stratum, hash_order(seed, key), F.col(key), "\x01place")
    quotas = water_filled(df.groupBy(stratum).agg(F.count(F.lit(1)).alias("\x01n")), stratum, "\x01n", target).select(F.col(stratum).alias("\x01s"), "quota")
    j = placed.join(quotas, F.col(stratum).eqNullSafe(F.col("\x01s")))
    return j.where(F.col("\x01place") <= F.col("quota")).select(*df.columns)


def controlled_eval(rows: DataFrame, existing: DataFrame, key: str, at: str, stratum: str, styles: Mapping[str, str], target: int, seed: int) -> DataFrame:
    """New evaluation rows: of keys that exist nowhere yet the first row each, balanced over strata, once in every style.

    styles: the difficulty that each style stands for. Rows without a key go.
    """
    fresh = rows.where(F.col(key).isNotNull()).join(existing.select(key).distinct(), key, "left_anti")
    once = ranked(fresh, key, [F.col(at)], "\x01n").where("`\x01n` = 1").select(*rows.columns)
    some = balanced(once, stratum, key, target, seed)
    each = F.array(*[F.struct(F.lit(s).alias("image_type"), F.lit(d).alias("difficulty")) for s, d in styles.items()])
    return some.withColumn("\x01s", F.explode(each)).select(*rows.columns, "\x01s.*")


def first_free(pairs: DataFrame, group: str, key: str, order: str, per_group: int) -> DataFrame:
    """(group, key, order): what each group takes if groups come in order and each takes its first per_group keys that are still free.

    Groups propose their first keys, a key stays with the earliest of its
    groups, and groups that were refused propose their next ones, until nobody
    is refused. As all keys prefer groups in one order, that ends where taking
    turns would. A round is a window by group and one by key; nothing reaches
    the driver but the number of refusals.
    """
    refused = None
    while True:
        left = pairs if refused is None else pairs.join(refused, [group, key], "left_anti")
        asked = ranked(left, group, [F.col(key)], "\x01n").where(F.col("\x01n") <= per_group).drop("\x01n")
        held = kept(ranked(asked, key, [F.col(order), F.col(group)], "\x01n"))
        new = held.where("`\x01n` > 1").select(group, key)
        if not new.limit(1).count():
            return held.select(group, key, order)
        refused = kept(new if refused is None else refused.unionByName(new))


#: Picks up to this many are broadcast.
BROADCAST_PICKS = 200_000


def group_holdout(df: DataFrame, group: str, key: str, target: int, per_group: int, least_groups: int, seed: int, ranges: int = 4096) -> DataFrame:
    """df with `split`: locked, excess or train. No group crosses, locked keys are unique.

    Groups are taken in hash order until `target` keys of at least least_groups
    groups are locked; a taken group locks up to per_group keys that aren't
    locked yet, and its other rows are excess, as are rows elsewhere with a
    locked key. Groups are cut into ranges of their hash; as many first ranges
    as could suffice are settled, and more if conflicts leave too few. Rows
    without a group or a key lock nothing.
    """
    pairs = df.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(group, key).distinct().withColumn("\x01h", hash_order(seed, group))
    pairs = pairs.withColumn("\x01r", F.floor(F.conv(F.substring("\x01h", 1, 8), 16, 10).cast("double") * ranges / 2**32).cast("int"))
    most = pairs.groupBy("\x01r", group).agg(F.least(F.count(F.lit(1)), F.lit(per_group)).alias("u")).groupBy("\x01r").agg(F.sum("u").alias("u"), F.count(F.lit(1)).alias("g")).orderBy("\x01r").collect()  # a row a range
    factor = 1.25
    while True:
        keys = groups = 0
        last = -1
        for r in most:
            keys, groups, last = keys + r["u"], groups + r["g"], r["\x01r"]
            if keys >= factor * target and groups >= factor * least_groups:
                break
        taken = kept(first_free(pairs.where(F.col("\x01r") <= last).select(group, key, "\x01h"), group, key, "\x01h", per_group))
        per = taken.groupBy(group, "\x01h").agg(F.count(F.lit(1)).alias("n")).withColumn("\x01r", F.substring("\x01h", 1, 3))
        n_keys, n_groups = taken.count(), per.count()
        if (n_keys >= target and n_groups >= least_groups) or not most or last == most[-1]["\x01r"]:
            break
        factor *= 2
    # groups up to the first at which there are enough keys and groups
    w = W.orderBy("\x01r").rowsBetween(W.unboundedPreceding, -1)
    sums = per.groupBy("\x01r").agg(F.sum("n").alias("k"), F.count(F.lit(1)).alias("g"))
    before = sums.select("\x01r", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("\x01k"), F.coalesce(F.sum("g").over(w), F.lit(0)).alias("\x01g"))
    inner = W.partitionBy("\x01r").orderBy("\x01h", group).rowsBetween(W.unboundedPreceding, -1)
    far = per.join(before, "\x01r").select(group, (F.col("\x01k") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("\x01k"), (F.col("\x01g") + F.coalesce(F.count(F.lit(1)).over(inner), F.lit(0))).alias("\x01g"))
    chosen = far.where((F.col("\x01k") < target) | (F.col("\x01g") < least_groups)).select(group, F.lit(True).alias("\x01group"))
    picks = taken.join(chosen, group, "left_semi").select(group, key, F.lit(True).alias("\x01pick"))
    locked = picks.select(key, F.lit(True).alias("\x01key"))
    small = max(target, least_groups * per_group) + per_group <= BROADCAST_PICKS  # there are no more picks than that
    side = F.broadcast if small else (lambda d: d)
    out = df.join(side(picks), [group, key], "left").join(side(chosen), group, "left").join(side(locked), key, "left")
    picked = F.col("\x01pick").isNotNull()
    # of a pick's rows one is locked; other rows needn't be ranked and are spread
    w = W.partitionBy(group, key, F.when(~picked, F.xxhash64(*df.columns))).orderBy(hash_order(seed, F.to_json(F.struct(*[F.col(c) for c in df.columns]))))
    out = out.withColumn("\x01n", F.row_number().over(w))
    split = F.when(picked & (F.col("\x01n") == 1), "locked").when(F.col("\x01group").isNotNull() | F.col("\x01key").isNotNull(), "excess").otherwise("train")
    return out.withColumn("split", split).select(*df.columns, "split")
