"""Two runs over the same samples: one report, what changed, and reports rolled up."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.operators.build import correct_by, mcnemar_p
from quernel.operators.graph import kept
from quernel.operators.rank import ordinal
from quernel.operators.relate import unique_by_key
from quernel.operators.stats import bootstraps

#: The resamples, and what the gate allows to be lost.
ITERATIONS, SLACK = 10_000, 0.005


def paired(baseline: DataFrame, candidate: DataFrame, key: str, exact: str, valid: str, fields: Sequence[str] = (), cluster: str | None = None) -> DataFrame:
    """key, cluster, a and b (exact in the baseline and in the candidate, 0 or 1), va and vb (valid), and the baseline's fields.

    The query fails if an id is empty or repeated in a run, if an id is in one
    run only, or if the runs put a sample into different clusters. A sample
    without a cluster is one of its own.
    """
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("int")
    own = F.coalesce(F.nullif(F.col(cluster).cast("string"), F.lit("")), F.col(key).cast("string")) if cluster else F.col(key).cast("string")
    a = unique_by_key(baseline, key).select(key, own.alias("cluster"), flag(exact).alias("a"), flag(valid).alias("va"), *fields)
    b = unique_by_key(candidate, key).select(key, own.alias("\x01cluster"), flag(exact).alias("b"), flag(valid).alias("vb"))
    j = a.join(b, key, "full_outer")
    wrong = F.when(F.col("a").isNull(), F.lit("only the candidate has id ")).when(F.col("b").isNull(), F.lit("only the baseline has id ")).when(F.col("cluster") != F.col("\x01cluster"), F.lit("clusters differ for id "))
    sound = F.when(wrong.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(wrong, F.col(key).cast("string"))).cast("boolean"))
    return j.where(sound).select(key, "cluster", "a", "b", "va", "vb", *fields)


def units_of(pairs: DataFrame, clustered: bool) -> DataFrame:
    """What is resampled, a row each, kept: the means of both runs, their changes, and counts of rows and transitions; pairs are read once."""
    n = lambda c: F.sum(c.cast("long"))
    a, b = F.col("a") == 1, F.col("b") == 1
    counts = [F.count(F.lit(1)).alias("n"), n(~a & b).alias("wins"), n(a & ~b).alias("losses"), n(a & b).alias("both"), n(~a & ~b).alias("neither")]
    units = pairs.groupBy(F.col("cluster" if clustered else pairs.columns[0]).alias("unit")).agg(*[F.avg(c).alias(f"mean_{c}") for c in ("a", "b", "va", "vb")], *counts)
    return kept(units.withColumns({"exact": F.col("mean_b") - F.col("mean_a"), "valid": F.col("mean_vb") - F.col("mean_va")}))


def reports(runs: Sequence[tuple[DataFrame, bool]], iterations: int = ITERATIONS, seed: int = 17, slack: float = SLACK, digits: int = 6) -> DataFrame:
    """The rows of `report` on several pairs of runs, each with whether it has clusters, and `run`, its number; draws are made once for all of them."""
    samples, facts = [], []
    for k, (pairs, clustered) in enumerate(runs):
        units = units_of(pairs, clustered)
        size = units.count()
        if not size:
            raise ValueError("there are no pairs")
        samples.append((ordinal(units.select("unit", "exact", "valid"), "unit"), "ord", size, {"exact": seed, "valid": seed + 1}))
        means = {"mean_a": "exact_baseline", "mean_b": "exact_candidate", "exact": "exact_delta", "mean_va": "valid_baseline", "mean_vb": "valid_candidate", "valid": "valid_delta"}
        counts = [F.sum(c).alias(c) for c in ("n", "wins", "losses", "both", "neither")]
        facts.append(units.agg(F.lit(k).alias("run"), F.lit(clustered).alias("clustered"), F.count(F.lit(1)).alias("independent_units"), *counts, *[F.avg(c).alias(to) for c, to in means.items()]))
    spread = []
    for m in ("exact", "valid"):
        mean = F.when(F.col("value") == m, F.col("mean"))
        spread += [F.percentile(mean, 0.025).alias(f"{m}_low"), F.percentile(mean, 0.975).alias(f"{m}_high"), F.avg((mean > 0).cast("double")).alias(f"{m}_gain")]
    both = reduce(DataFrame.unionByName, facts).join(bootstraps(samples, iterations).groupBy(F.col("sample").alias("run")).agg(*spread), "run")
    passed = (F.col("exact_low") >= -slack) & (F.col("valid_delta") >= -slack) & (F.col("wins") >= F.col("losses"))
    p = F.when(~F.col("clustered"), F.round(mcnemar_p("wins", "losses"), 9))
    rounded = [F.round(f"{m}_{c}", digits).alias(f"{m}_{c}") for m in ("exact", "valid") for c in ("baseline", "candidate", "delta", "low", "high", "gain")]
    return both.select("run", "n", "independent_units", "wins", "losses", "both", "neither", *rounded, p.alias("mcnemar_p"), passed.alias("passed"))


def report(pairs: DataFrame, clustered: bool = False, iterations: int = ITERATIONS, seed: int = 17, slack: float = SLACK, digits: int = 6) -> DataFrame:
    """One row about runs that `paired` has joined: n, both metrics with their intervals, transitions, McNemar's p (null with clusters), and the gate.

    Pairs, intervals and counts are all of the same rows; with clusters, these
    are resampled whole. The gate: the exact interval's low end and the change
    of validity no worse than -slack, and as many wins as losses.
    """
    return reports([(pairs, clustered)], iterations, seed, slack, digits).drop("run")


def changed(pairs: DataFrame) -> DataFrame:
    """The samples that got better or worse: key and `change`, improvement or regression."""
    return pairs.where("a <> b").select(pairs.columns[0], F.when(F.col("b") == 1, "improvement").otherwise("regression").alias("change"))


def groups(pairs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value, n, baseline_correct, candidate_correct) of every value of the fields."""
    return correct_by(pairs, fields)


def as_json(row: DataFrame, **names: Column) -> DataFrame:
    """A report as it is kept in a file: the names, and all of it as JSON."""
    nested = F.struct("n", F.struct(F.col("exact_delta").alias("delta"), F.col("exact_low").alias("ci95_low"), F.col("exact_high").alias("ci95_high")).alias("exact"), F.struct(F.col("valid_delta").alias("delta")).alias("valid"), F.struct("passed").alias("gate"))
    return row.select(*[c.alias(k) for k, c in names.items()], F.to_json(nested).alias("report"))
