"""Joins and set operations with the checks that evaluation needs.

All joins are equi-joins and leave the strategy to Spark: sides are broadcast
only by its own size statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def labelled(labels: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Labels drive; a label without a prediction stays, with `missing` true."""
    return labels.join(predictions.withColumn("\x01has", F.lit(True)), key, "left").withColumn("missing", F.col("\x01has").isNull()).drop("\x01has")


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with equal keys the last."""
    w = W.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("\x01n", F.row_number().over(w)).where(F.col("\x01n") == 1).drop("\x01n")


def unique_by_key(df: DataFrame, key: str) -> DataFrame:
    """df, failing while it runs if a key is null, empty or repeated."""
    w = W.partitionBy(key)
    bad = F.col(key).isNull() | (F.col(key).cast("string") == "") | (F.count(F.lit(1)).over(w) > 1)
    return df.withColumn("\x01ok", F.when(bad, F.raise_error(F.concat(F.lit(f"empty or repeated {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.lit(True))).where("`\x01ok`").drop("\x01ok")


def id_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in one side only, with the side; no rows if the sides match."""
    left = a.select(key).distinct().withColumn("\x01a", F.lit(1))
    right = b.select(key).distinct().withColumn("\x01b", F.lit(1))
    side = F.when(F.col("\x01b").isNull(), "left").when(F.col("\x01a").isNull(), "right")
    return left.join(right, key, "full_outer").select(key, side.alias("side")).where(F.col("side").isNotNull())


def unseen(df: DataFrame, held_out: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows whose key isn't held out."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.join(held_out.select(*keys).distinct(), keys, "left_anti")


def seen(df: DataFrame, other: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.join(other.select(*keys).distinct(), keys, "left_semi")


def seen_by_any(df: DataFrame, other: DataFrame, left_keys: Sequence[str], right_key: str) -> DataFrame:
    """Rows of df one of whose keys is in other: a semi join on the exploded keys, so never an OR in a join."""
    each = df.withColumn("\x01row", F.struct(*df.columns)).withColumn("\x01k", F.explode(F.array_distinct(F.array(*left_keys))))
    hit = each.join(other.select(F.col(right_key).alias("\x01k")).distinct(), "\x01k", "left_semi")
    return hit.select("\x01row").distinct().select("\x01row.*")


def first_union(parts: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """All parts; of rows with equal keys that of the earliest part, then of the least order."""
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        every = p if every is None else every.unionByName(p, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy("part", order)
    return every.withColumn("\x01n", F.row_number().over(w)).where(F.col("\x01n") == 1).drop("\x01n")


def with_policy(rows: DataFrame, policy: DataFrame, group: str, value: str, fallback) -> DataFrame:
    """Each row with the value of its group, or the fallback."""
    return rows.join(policy.select(group, value), group, "left").withColumn(value, F.coalesce(value, F.lit(fallback)))


def reused(parts: DataFrame, key: str, part: str) -> DataFrame:
    """Keys that are in more than one part."""
    return parts.groupBy(key).agg(F.count_distinct(part).alias("n_parts"), F.count(F.lit(1)).alias("n_rows")).where("n_parts > 1")


def merged_shards(shards: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """What is wrong with shards of a result: key and `repeated`, `missing` or `extra`; no rows if nothing."""
    repeated = shards.groupBy(key).count().where("count > 1").select(key, F.lit("repeated").alias("problem"))
    diff = id_differences(expected, shards, key).select(key, F.when(F.col("side") == "left", "missing").otherwise("extra").alias("problem"))
    return repeated.unionByName(diff)


#: Passages up to this many are looked for inside the scan of the texts; more are joined.
SCANNED_PASSAGES = 4096


def containing(texts: DataFrame, passages: DataFrame, text: str, passage: str, words: int = 5, scanned: int = SCANNED_PASSAGES) -> DataFrame:
    """Rows of texts with each passage they contain.

    A theta join by keys: `words` words of a passage against every run of as
    many words of a text, and hits compared. The first and last word of a
    passage may be parts of words of a text, so passages of fewer than words + 2
    words have no such key. Up to `scanned` passages travel to the scan of the
    texts as one array and everything is done there; a text meets only passages
    that share a key with it, or short ones that it contains. More passages are
    joined with the runs of the texts, the short ones by characters: their
    first 16, or the power of two that they have.
    """
    split = lambda c: F.filter(F.split(F.col(c), r"\s+"), lambda w: w != "")
    p = passages.withColumn("\x01w", split(passage)).where(F.size("\x01w") > 0)
    long_p = p.where(F.size("\x01w") >= words + 2).withColumn("\x01h", F.xxhash64(F.slice("\x01w", 2, words))).drop("\x01w")
    short_p = p.where(F.size("\x01w") < words + 2).drop("\x01w")
    t = texts.withColumn("\x01w", split(text))
    starts = F.when(F.size("\x01w") >= words, F.transform(F.sequence(F.lit(1), F.size("\x01w") - words + 1), lambda i: F.xxhash64(F.slice("\x01w", i, words)))).otherwise(F.array().cast("array<long>"))
    if passages.limit(scanned + 1).count() <= scanned:
        keys = long_p.agg(F.collect_set("\x01h").alias("\x01keys"))
        met = t.withColumn("\x01runs", starts).join(F.broadcast(keys)).withColumn("\x01h", F.explode(F.array_intersect("\x01runs", "\x01keys")))  # one row of keys
        found = met.drop("\x01w", "\x01runs", "\x01keys").join(F.broadcast(long_p), "\x01h").where(F.contains(text, F.col(passage))).drop("\x01h")
        few = short_p.agg(F.collect_set(passage).alias("\x01short"))
        held = texts.join(F.broadcast(few)).withColumn("\x01p", F.explode(F.filter("\x01short", lambda s: F.contains(text, s)))).drop("\x01short")  # one row
        return found.unionByName(held.join(F.broadcast(short_p.withColumn("\x01p", F.col(passage))), "\x01p").drop("\x01p"))
    t = t.withColumn("\x01key", F.xxhash64(text))
    hits = t.select("\x01key", F.explode(F.array_distinct(starts)).alias("\x01h")).distinct().join(long_p, "\x01h").drop("\x01h")
    n = F.length(passage)
    power = F.when(n >= 16, 16).when(n >= 8, 8).when(n >= 4, 4).when(n >= 2, 2).otherwise(1)
    hashed = lambda letters, i, k: F.xxhash64(F.slice(letters, i, k))
    short_p = short_p.withColumn("\x01k", power).withColumn("\x01h", hashed(F.split(passage, ""), 1, F.col("\x01k")))
    lengths = F.broadcast(short_p.select("\x01k").distinct())
    letters = t.select("\x01key", F.split(text, "").alias("\x01c")).join(lengths, F.size("\x01c") >= F.col("\x01k"))
    runs = F.transform(F.sequence(F.lit(1), F.size("\x01c") - F.col("\x01k") + 1), lambda i: hashed(F.col("\x01c"), i, F.col("\x01k")))
    short_hits = letters.select("\x01key", "\x01k", F.explode(F.array_distinct(runs)).alias("\x01h")).distinct().join(short_p, ["\x01k", "\x01h"]).drop("\x01k", "\x01h")
    # equal texts share their hash and their hits; the comparison settles texts that share a hash by chance
    found = t.drop("\x01w").join(hits.unionByName(short_hits), "\x01key").where(F.contains(text, F.col(passage)))
    return found.drop("\x01key")
