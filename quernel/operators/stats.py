"""Statistics of paired runs: cluster means, bootstrap, McNemar, factorial effects, gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.draws import TOGETHER, hash_numbers
from quernel.functions.keys import hash_number


def cluster_means(paired: DataFrame, cluster: str, a: str = "a", b: str = "b") -> DataFrame:
    """(cluster, n, mean_a, mean_b, delta): rows made into clusters before they are resampled."""
    return paired.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(a).cast("double")).alias("mean_a"), F.avg(F.col(b).cast("double")).alias("mean_b")).withColumn("delta", F.col("mean_b") - F.col("mean_a"))


#: Units up to this many travel as one array; 8 MiB of doubles.
BROADCAST_UNITS = 1 << 20

#: Draws of a task: so many for each unit that travels to it, and at least so many; and those that are in memory at once.
DRAWS_A_UNIT, LEAST_DRAWS, DRAWS_AT_ONCE = 16, 50 * TOGETHER, 25 * TOGETHER


def bootstrap(units: DataFrame, value: str, index: str, n_units: int, iterations: int, seed: int = 17, broadcast_units: int = BROADCAST_UNITS) -> DataFrame:
    """(iteration, mean): means of resamples of units numbered 0 .. n_units-1 by `index`; see `bootstraps`."""
    return bootstraps([(units, index, n_units, {value: seed})], iterations, broadcast_units).select("iteration", "mean")


def bootstraps(samples: Sequence[tuple[DataFrame, str, int, Mapping[str, int]]], iterations: int, broadcast_units: int = BROADCAST_UNITS) -> DataFrame:
    """(sample, value, iteration, mean): means of resamples of several tables in one pass over the draws.

    A sample is its units, numbered 0 .. n-1 by a column, that column, n, and
    the seed of each value. The draw of place j of iteration i is a hash of the
    seed and i * n + j, so any engine can repeat it; samples with a seed in
    common share the hashes. Draws are made and summed where they arise: up to
    broadcast_units units, there is one array of all values beside them; beyond
    that draws are joined with the units, of which there is one row a cluster.
    """
    spark = samples[0][0].sparkSession
    near = {k: s for k, s in enumerate(samples) if s[2] <= broadcast_units}
    means = []
    if near:
        most = max(n for _, _, n, _ in near.values())
        total, size = iterations * most, max(LEAST_DRAWS, -(-DRAWS_A_UNIT * most // TOGETHER) * TOGETHER)
        tasks = -(-total // size)
        ranges = spark.range(0, tasks, 1, max(tasks, 1))
        for k, (units, index, _, seeds) in near.items():
            rows = units.agg(F.sort_array(F.collect_list(F.struct(index, *seeds))).alias("\x01rows"))
            ranges = ranges.join(F.broadcast(rows.select(*[F.col("\x01rows")[v].cast("array<double>").alias(f"{k} {v}") for v in seeds])))  # one row
        sums = ranges.mapInArrow(_summing([(k, v, n, s) for k, (_, _, n, seeds) in near.items() for v, s in seeds.items()], size, iterations), "sample int, value string, iteration long, sum double, n long")
        means.append(sums.groupBy("sample", "value", "iteration").agg(F.try_divide(F.sum("sum"), F.sum("n")).alias("mean")))
    for k, (units, index, n, seeds) in enumerate(samples):
        for v, s in seeds.items() if k not in near else ():
            draws = spark.range(iterations * n).select(F.floor(F.col("id") / n).alias("iteration"), F.pmod(hash_number(s, F.col("id")), F.lit(n)).alias(index))
            drawn = draws.join(units.select(index, F.col(v).alias("\x01v")), index).groupBy("iteration").agg(F.avg("\x01v").alias("mean"))
            means.append(drawn.select(F.lit(k).alias("sample"), F.lit(v).alias("value"), "iteration", "mean"))
    return reduce(DataFrame.unionByName, means)


def _summing(values: Sequence[tuple[int, str, int, int]], size: int, iterations: int):
    """Sums and counts by iteration of what each range of draws finds in the arrays beside it; values are (sample, value, units, seed)."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                arrays = {}
                for k, v, _, _ in values:
                    array = batch.column(f"{k} {v}")[row].values
                    arrays[k, v] = array.fill_null(0).to_numpy(zero_copy_only=False), None if not array.null_count else array.is_valid().to_numpy(zero_copy_only=False)
                first = batch.column("id")[row].as_py() * size
                for at in range(first, first + size, DRAWS_AT_ONCE):
                    for seed in sorted({s for _, _, _, s in values}):
                        asked = [(k, v, n, min(at + DRAWS_AT_ONCE, first + size, iterations * n)) for k, v, n, s in values if s == seed]
                        hashed = hash_numbers(seed, at, max(end for *_, end in asked))
                        for k, v, n, end in asked:
                            if at < end:
                                drawn = hashed[: end - at]
                                drawn = (drawn - drawn // np.uint64(n) * np.uint64(n)).astype(np.int64)
                                place = np.arange(at, end) // n - at // n
                                array, there = arrays[k, v]
                                sums = np.bincount(place, array[drawn])
                                counts = np.bincount(place, None if there is None else there[drawn]).astype(np.int64)
                                columns = [pa.array([k] * len(sums), pa.int32()), pa.array([v] * len(sums)), pa.array(np.arange(len(sums)) + at // n), pa.array(sums), pa.array(counts)]
                                yield pa.RecordBatch.from_arrays(columns, ["sample", "value", "iteration", "sum", "n"])

    return run


def interval(means: DataFrame, digits: int = 9) -> DataFrame:
    """(low, high, n): the central 95 % of resampled means, linear percentiles."""
    return means.agg(F.round(F.percentile("mean", 0.025), digits).alias("low"), F.round(F.percentile("mean", 0.975), digits).alias("high"), F.count(F.lit(1)).alias("n"))


def discordance(paired: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: rows, right in both, in either alone, in none."""
    x, y = F.col(a) == 1, F.col(b) == 1
    n = lambda c: F.sum(c.cast("long"))
    return paired.agg(F.count(F.lit(1)).alias("n"), n(x & y).alias("both"), n(~x & y).alias("wins"), n(x & ~y).alias("losses"), n(~x & ~y).alias("neither"))


def mcnemar_exact(wins: int, losses: int) -> float:
    """Two-sided exact binomial p of discordant pairs."""
    n = wins + losses
    if not n:
        return 1.0
    tail = sum(comb(n, k) for k in range(min(wins, losses) + 1))
    return float(min(Fraction(1), Fraction(2 * tail, 2**n)))


def factorial(df: DataFrame, x: str, y: str, value: str, digits: int = 9) -> DataFrame:
    """One row: means of the four cells of a 2 x 2 design, both main effects and the interaction."""
    cell = lambda i, j: F.avg(F.when((F.col(x) == i) & (F.col(y) == j), F.col(value)))
    m = df.agg(cell(0, 0).alias("m00"), cell(1, 0).alias("m10"), cell(0, 1).alias("m01"), cell(1, 1).alias("m11"))
    r = lambda c: F.round(c, digits)
    a, b, c, d = (F.col(n) for n in ("m00", "m10", "m01", "m11"))
    return m.select(*[r(F.col(n)).alias(n) for n in ("m00", "m10", "m01", "m11")], r((b + d - a - c) / 2).alias("effect_x"), r((c + d - a - b) / 2).alias("effect_y"), r(d - b - c + a).alias("interaction"))


def gate(low: Column, validity_delta: Column, wins: Column, losses: Column, slack: float = 0.005) -> Column:
    """Whether a candidate may be adopted: no clear loss, validity kept, as many wins as losses."""
    return (low >= -slack) & (validity_delta >= -slack) & (wins >= losses)


def winner(scores: DataFrame, baseline: str, candidate: str, tolerance: float, least_gain: float) -> DataFrame:
    """One row: the candidate wins if no panel regresses beyond the tolerance and the mean gain is enough."""
    delta = F.col(candidate) - F.col(baseline)
    out = scores.agg(F.avg(delta).alias("gain"), F.every(delta >= -tolerance).alias("holds"))
    return out.select(F.round("gain", 9).alias("gain"), "holds", F.when(F.col("holds") & (F.col("gain") >= least_gain), "candidate").otherwise("baseline").alias("winner"))


def seeds(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and sample spread over seeds; 0 where there is one."""
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("n"))
