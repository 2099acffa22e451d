"""Routing between runs by group or by threshold, with cross-validation by folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.operators.rank import best, threshold_sweep


def group_rates(outcomes: DataFrame, group: str, run: str = "run", right: str = "right") -> DataFrame:
    """(group, run, n, k): rows and right ones. Outcomes hold one row for each sample and run."""
    return outcomes.groupBy(group, run).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(right).cast("long")).alias("k"))


def best_runs(rates: DataFrame, group: str, least: int, fallback: str, run: str = "run") -> DataFrame:
    """The run of greatest rate of each group, ties by name; groups below `least` rows take the fallback."""
    one = best(rates.withColumn("rate", F.col("k") / F.col("n")), group, [F.col("rate").desc(), F.col(run)])
    return one.select(group, F.when(F.col("n") >= least, F.col(run)).otherwise(F.lit(fallback)).alias("choice"), "n")


def cv_choices(outcomes: DataFrame, group: str, fold: str, shrink: float, least: int, fallback: str, run: str = "run", right: str = "right") -> DataFrame:
    """(group, fold, choice): the best run of each group by the other folds, its rate drawn to the run's overall rate.

    Training counts are totals less the fold's own, so the data are read once.
    """
    cells = outcomes.groupBy(group, fold, run).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(right).cast("long")).alias("k"))
    by_fold = cells.groupBy(fold, run).agg(F.sum("n").alias("fn"), F.sum("k").alias("fk"))
    total = by_fold.groupBy(run).agg(F.sum("fn").alias("tn"), F.sum("fk").alias("tk"))
    g_total = cells.groupBy(group, run).agg(F.sum("n").alias("gn"), F.sum("k").alias("gk"))
    folds = by_fold.select(fold).distinct()
    grid = g_total.crossJoin(F.broadcast(folds)).join(cells, [group, fold, run], "left").join(F.broadcast(by_fold), [fold, run], "left").join(F.broadcast(total), run)
    z = lambda c: F.coalesce(c, F.lit(0))
    n, k = F.col("gn") - z("n"), F.col("gk") - z("k")
    on, ok = F.col("tn") - z("fn"), F.col("tk") - z("fk")
    overall = F.coalesce(F.try_divide(ok.cast("double"), on.cast("double")), F.lit(0.0))
    scored = grid.select(group, fold, run, n.alias("train_n"), F.round(F.coalesce(F.try_divide(k + shrink * overall, n + shrink), F.lit(0.0)), 9).alias("rate"))
    one = best(scored, [group, fold], [F.col("rate").desc(), F.col(run)])
    return one.select(group, fold, F.when(F.col("train_n") >= least, F.col(run)).otherwise(F.lit(fallback)).alias("choice"))


def routed(outcomes: DataFrame, choices: DataFrame, keys: list[str], fallback: str, run: str = "run") -> DataFrame:
    """The outcome of the chosen run for each sample; groups without a choice take the fallback."""
    j = outcomes.join(choices.select(*keys, "choice"), keys, "left")
    return j.where(F.col(run) == F.coalesce("choice", F.lit(fallback))).drop("choice")


def best_threshold(paired: DataFrame, group: str, score: str, gain: str, rows: str | None = None) -> DataFrame:
    """(group, threshold, gain): the threshold of greatest summed gain at or above it; above all scores (infinity) if none gains.

    gain is what a sample wins by leaving the fallback. Among equal gains the
    greatest threshold, so the fewest changes.
    """
    sweep = threshold_sweep(paired, group, score, gain, rows)
    nothing = paired.select(group).distinct().select(group, F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("n_at_or_above"), F.lit(0).cast("long").alias("gain"))
    most = sweep.unionByName(nothing).groupBy(group).agg(F.max(F.struct("gain", "threshold", "n_at_or_above")).alias("\x01m"))
    return most.select(group, "\x01m.threshold", "\x01m.n_at_or_above", "\x01m.gain")


def cv_threshold(paired: DataFrame, fold: str, score: str, gain: str, n_folds: int) -> DataFrame:
    """(fold, threshold, train_gain, test_n, test_gain): thresholds by the other folds, tried on the fold. Rows are summed by score before they meet the folds."""
    cells = paired.groupBy(fold, score).agg(F.count(F.lit(1)).alias("\x01rows"), F.sum(gain).alias(gain))
    others = cells.withColumn("held", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda f: f != F.col(fold))))
    chosen = best_threshold(others, "held", score, gain, "\x01rows").select(F.col("held").alias(fold), "threshold", F.col("gain").alias("train_gain"))
    hit = F.col(score) >= F.col("threshold")
    tried = paired.join(F.broadcast(chosen), fold).groupBy(fold).agg(F.first("threshold").alias("threshold"), F.first("train_gain").alias("train_gain"), F.sum(hit.cast("long")).alias("test_n"), F.sum(F.when(hit, F.col(gain)).otherwise(0)).alias("test_gain"))
    return tried


def margin_grid(rows: DataFrame, margins: list[float], margin: str, win: Column, group: str) -> DataFrame:
    """(group, margin, n_override, net): each margin of a grid tried in every group.

    Rows are first summed by the greatest margin of the grid that they reach,
    so only sums meet the grid.
    """
    grid = sorted(margins)
    reach = F.lit(-1)
    for i, m in enumerate(grid):
        reach = F.when(F.col(margin) >= m, F.lit(i)).otherwise(reach)
    cells = rows.withColumn("\x01i", reach).groupBy(group, "\x01i").agg(F.count(F.lit(1)).alias("n"), F.sum(win).alias("w"))
    w = W.partitionBy(group).orderBy(F.col("i").desc())
    every = cells.select(group).distinct().withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(len(grid))])))
    full = every.join(cells.withColumnRenamed("\x01i", "i"), [group, "i"], "left").na.fill(0, ["n", "w"])
    out = full.withColumn("n_override", F.sum("n").over(w)).withColumn("net", F.sum("w").over(w))
    return out.select(group, F.element_at(F.array(*[F.lit(float(m)) for m in grid]), F.col("i") + 1).alias("margin"), "n_override", "net")
