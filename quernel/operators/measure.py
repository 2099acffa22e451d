"""Evaluation: details a row, reports over many dimensions at once, profiles and audits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.functions.numbers import f1, rate
from quernel.functions.text import bag_overlap, edit_similarity, tokens


def details(joined: DataFrame, truth: str, prediction: str, pattern: str | None = None) -> DataFrame:
    """Metrics of each labelled row; a missing prediction counts as none of anything."""
    t, p = F.coalesce(F.col(truth), F.lit("")), F.coalesce(F.col(prediction), F.lit(""))
    cut = (lambda c: tokens(c, pattern)) if pattern else tokens
    rows = joined.withColumn("\x01t", cut(t)).withColumn("\x01p", cut(p))
    rows = rows.withColumn("n_true", F.size("\x01t")).withColumn("n_pred", F.size("\x01p")).withColumn("n_both", bag_overlap("\x01t", "\x01p")).drop("\x01t", "\x01p")
    rows = rows.withColumn("exact", (t == p) & (p != "")).withColumn("precision", rate("n_both", "n_pred")).withColumn("recall", rate("n_both", "n_true"))
    return rows.withColumn("token_f1", f1("precision", "recall")).withColumn("edit_similarity", edit_similarity(t, p))


def report(rows: DataFrame, dimensions: Sequence[str], digits: int = 9) -> DataFrame:
    """Micro and macro metrics overall and by each dimension, in one pass over grouping sets.

    Rows without a prediction are in every denominator.
    """
    named = rows.select(*[F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias(d) for d in dimensions], "exact", "missing", "n_true", "n_pred", "n_both", "precision", "recall", "token_f1", "edit_similarity")
    sets = named.groupingSets([[], *[[F.col(d)] for d in dimensions]], *[F.col(d) for d in dimensions])
    n = F.count(F.lit(1))
    out = sets.agg(
        n.alias("total"), F.sum(F.col("exact").cast("long")).alias("n_exact"), F.sum(F.col("missing").cast("long")).alias("n_missing"),
        F.sum("n_both").alias("tp"), F.sum("n_pred").alias("pred"), F.sum("n_true").alias("gt"),
        F.round(F.sum("token_f1") / n, digits).alias("macro_f1"), F.round(F.sum("edit_similarity") / n, digits).alias("mean_edit_similarity"),
        *[F.grouping(d).alias(f"\x01{d}") for d in dimensions],
    )
    dimension, value = F.lit("all"), F.lit("all")
    for d in dimensions:
        dimension = F.when(F.col(f"\x01{d}") == 0, F.lit(d)).otherwise(dimension)
        value = F.when(F.col(f"\x01{d}") == 0, F.col(d)).otherwise(value)
    out = out.select(dimension.alias("dimension"), value.alias("value"), "total", "n_exact", "n_missing", "tp", "pred", "gt", "macro_f1", "mean_edit_similarity")
    p, r = rate("tp", "pred"), rate("tp", "gt")
    return out.withColumns({"exact_rate": F.round(rate("n_exact", "total"), digits), "micro_precision": F.round(p, digits), "micro_recall": F.round(r, digits), "micro_f1": F.round(f1(p, r), digits)})


def literal(joined: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Raw and white-space-normalised exact match; a missing prediction is the empty text."""
    t, p = F.coalesce(F.col(truth), F.lit("")), F.coalesce(F.col(prediction), F.lit(""))
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    return joined.withColumns({"raw_exact": t == p, "normal_exact": bare(t) == bare(p), "non_empty": bare(p) != ""})


def histogram(df: DataFrame, *columns: str) -> DataFrame:
    """Counts by column, each as (column, value, n); nothing is `unknown`."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")).alias("value")) for c in columns])).alias("x"))
    return each.groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, column: str, digits: int = 4) -> DataFrame:
    counts = df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.round(100.0 * F.col("n") / F.col("total"), digits).alias("percent"))


def coverage(df: DataFrame, *columns: str) -> DataFrame:
    """(column, present, total, coverage): how many rows have something in each column, from one pass."""
    n = F.count(F.lit(1))
    sums = df.agg(n.alias("total"), *[F.sum((F.col(c).isNotNull() & (F.col(c).cast("string") != "")).cast("long")).alias(c) for c in columns])
    return sums.unpivot(["total"], list(columns), "column", "present").select("column", F.coalesce("present", F.lit(0)).alias("present"), "total", rate("present", "total").alias("coverage"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, surplus rows, repeated keys and the greatest repeat."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), (F.sum("n") - F.count(F.lit(1))).alias("n_surplus"), F.sum((F.col("n") > 1).cast("long")).alias("n_repeated"), F.max("n").alias("max_repeat"))


def profile(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Count, least, greatest, p50, p90, p95 and p99 (linear) and the mean."""
    v = F.col(value).cast("double")
    aggs = [F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"), *[F.round(F.percentile(v, p / 100), 6).alias(f"p{p}") for p in (50, 90, 95, 99)], F.round(F.avg(v), 6).alias("mean")]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def transitions(joined: DataFrame, before: str, after: str) -> DataFrame:
    """Counts of 0->0, 0->1, 1->0 and 1->1."""
    flag = lambda c: F.col(c).cast("int").cast("string")
    return joined.groupBy(F.concat_ws("->", flag(before), flag(after)).alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def normalizer(df: DataFrame, *columns: str, sample: bool = True, floor: float = 1e-8) -> DataFrame:
    """(feature, mean, sd): a spread below the floor counts as one."""
    sd = F.stddev_samp if sample else F.stddev_pop
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    stats = long.groupBy("feature").agg(F.avg("v").alias("mean"), F.coalesce(sd("v"), F.lit(0.0)).alias("sd"))
    return stats.select("feature", F.round("mean", 6).alias("mean"), F.round(F.when(F.col("sd") < floor, 1.0).otherwise(F.col("sd")), 6).alias("sd"))


def examples(df: DataFrame, group: str, item: Column, k: int) -> DataFrame:
    """The true count of each group and its first k items: a top-k report."""
    from quernel.operators.rank import ranked

    r = ranked(df.withColumn("\x01item", item), group, [F.col("\x01item")], "\x01rank")
    kept = F.array_sort(F.collect_list(F.when(F.col("\x01rank") <= k, F.col("\x01item"))))
    return r.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", kept).alias("examples"))


def blockers(checks: DataFrame, limits: dict[str, float]) -> DataFrame:
    """One row of figures with `blockers`: names of those beyond their limits, sorted, and ready if there are none."""
    names = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c) > F.lit(limit), F.lit(c)) for c, limit in limits.items()])))
    return checks.withColumn("blockers", F.concat_ws(",", names)).withColumn("ready", F.size(names) == 0)


def ranks(df: DataFrame, value: str, by: str, **places: Callable[[Column], Column]) -> DataFrame:
    """For each group the values at places (from 0) that are functions of its number of values, null where it has none.

    Equal values are counted first, so a task holds the distinct values of a group at most.
    """
    g = W.partitionBy(by)
    counts = df.groupBy(by, value).agg(F.count(value).alias("\x01n"))
    counts = counts.withColumn("\x01upto", F.sum("\x01n").over(g.orderBy(value))).withColumn("\x01all", F.sum("\x01n").over(g))
    return counts.groupBy(by).agg(*[F.min(F.when(F.col("\x01upto") > place(F.col("\x01all")), F.col(value))).alias(name) for name, place in places.items()])
