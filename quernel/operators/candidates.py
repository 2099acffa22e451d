"""Candidates of a sample: votes, reranking, fusion of runs, headroom, preference pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.operators.rank import best, ranked

#: What stands in for a missing score and a missing index.
NO_SCORE, NO_INDEX = -1e6, 99


def exploded(predictions: DataFrame, column: str = "candidates") -> DataFrame:
    """A row for each candidate with its place; a sample without candidates has none."""
    return predictions.select("*", F.posexplode(column).alias("candidate_index", "candidate")).select(*[c for c in predictions.columns if c != column], "candidate_index", "candidate.*")


def aggregate(cands: DataFrame, sample: str = "id", key: str = "canonical", score: str = "score", index: str = "candidate_index", runs: str | None = None) -> DataFrame:
    """One row for each key of a sample: votes, greatest and mean score, least index, and distinct runs if named.

    Candidates without a key are left out.
    """
    s, i = F.coalesce(F.col(score), F.lit(NO_SCORE)), F.coalesce(F.col(index), F.lit(NO_INDEX))
    extra = [F.count_distinct(runs).alias("n_runs")] if runs else []
    return cands.where(F.col(key).isNotNull()).groupBy(sample, key).agg(F.count(F.lit(1)).alias("votes"), F.max(s).alias("max_score"), F.avg(s).alias("mean_score"), F.min(i).alias("min_index"), *extra)


#: Orders of aggregates by strategy; the key comes last, so that no tie is left.
STRATEGIES: dict[str, Sequence[Column] | None] = {}


def order_of(strategy: str, key: str = "canonical") -> list[Column]:
    """The order in which a strategy prefers aggregates."""
    votes, top, mean, low = F.col("votes").desc(), F.col("max_score").desc(), F.col("mean_score").desc(), F.col("min_index").asc()
    orders = {
        "current": [votes, top, low],
        "vote": [votes, mean],
        "score": [top, votes],
        "mean": [mean, votes],
        "runs": [F.col("n_runs").desc() if strategy == "runs" else votes, votes, top],
        "penalty": [F.col("penalty").asc(), top] if strategy == "penalty" else [],
        "weighted": [F.col("weight").desc(), top] if strategy == "weighted" else [],
    }
    if strategy not in orders:
        raise ValueError(f"unknown strategy {strategy}")
    return [*orders[strategy], F.col(key).asc()]


def rerank(aggregates: DataFrame, strategy: str = "current", sample: str = "id", key: str = "canonical") -> DataFrame:
    """The aggregate that a strategy selects for each sample."""
    return best(aggregates, sample, order_of(strategy, key))


def fused(cands: DataFrame, strategy: str, weights: Mapping[str, float] | None = None, run: str = "run", penalty: str = "penalty", sample: str = "id", key: str = "canonical") -> DataFrame:
    """Selections from the pooled candidates of several runs by one strategy."""
    agg = aggregate(cands, sample, key, runs=run)
    known = cands.where(F.col(key).isNotNull())
    if strategy == "penalty":
        agg = agg.join(known.groupBy(sample, key).agg(F.min(penalty).alias("penalty")), [sample, key])
    if strategy == "weighted":
        pairs = [F.lit(v) for kv in (weights or {}).items() for v in kv]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(run)), F.lit(1.0)) if pairs else F.lit(1.0)
        agg = agg.join(known.groupBy(sample, key).agg(F.round(F.sum(weight), 9).alias("weight")), [sample, key])
    return rerank(agg, strategy, sample, key)


def pooled(runs: Mapping[str, DataFrame]) -> DataFrame:
    """The candidates of all runs, each with its run."""
    out = None
    for name, df in runs.items():
        part = df.withColumn("run", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def headroom(cands: DataFrame, selected: DataFrame, truth: DataFrame, sample: str = "id", key: str = "canonical") -> DataFrame:
    """For each labelled sample: whether the selection is right, and whether any candidate is."""
    t = truth.select(sample, F.col("truth"))
    hits = cands.join(t, sample).groupBy(sample).agg(F.max((F.col(key) == F.col("truth")).cast("int")).alias("oracle"))
    return t.join(selected.select(sample, F.col(key).alias("selected")), sample, "left").join(hits, sample, "left").select(
        sample, "truth", F.coalesce((F.col("selected") == F.col("truth")).cast("int"), F.lit(0)).alias("right"), F.coalesce("oracle", F.lit(0)).alias("oracle")
    )


def changes(before: DataFrame, after: DataFrame, truth: DataFrame, sample: str = "id", key: str = "canonical") -> DataFrame:
    """One row: how many selections changed, for the better and for the worse."""
    j = truth.select(sample, "truth").join(before.select(sample, F.col(key).alias("b")), sample, "left").join(after.select(sample, F.col(key).alias("a")), sample, "left")
    was, now = F.coalesce(F.col("b") == F.col("truth"), F.lit(False)), F.coalesce(F.col("a") == F.col("truth"), F.lit(False))
    n = lambda c: F.sum(c.cast("long"))
    return j.agg(F.count(F.lit(1)).alias("n"), n(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), n(~was & now).alias("good"), n(was & ~now).alias("bad"), n(was).alias("right_before"), n(now).alias("right_after"))


def with_variants(cands: DataFrame, variant: Column, sample: str = "id", key: str = "canonical") -> DataFrame:
    """The candidates and a variant of each, unless it is null, its original or a key that the sample has."""
    new = cands.withColumn("\x01v", variant).where(F.col("\x01v").isNotNull() & (F.col("\x01v") != F.col(key)))
    new = new.withColumn(key, F.col("\x01v")).drop("\x01v").join(cands.select(sample, key).distinct(), [sample, key], "left_anti")
    w = W.partitionBy(sample, key).orderBy(F.col("candidate_index"), F.col("score").desc())
    new = new.withColumn("\x01n", F.row_number().over(w)).where("`\x01n` = 1").drop("\x01n").select(*cands.columns)
    return cands.withColumn("is_variant", F.lit(False)).unionByName(new.withColumn("is_variant", F.lit(True)))


# Preference pairs


def mined_pairs(aggregates: DataFrame, truth: DataFrame, most_negatives: int, sample: str = "id", key: str = "canonical") -> DataFrame:
    """(id, pair_type, chosen, rejected): the right candidate against wrong ones.

    Types by priority: the voted winner where wrong, the best scored where
    wrong, then other hard negatives in order of votes. A pair is kept once,
    under its first type. The wrong side is ranked and cut to most_negatives
    before it meets the right one, so no sample gives more pairs than that.
    """
    known = aggregates.join(truth.select(sample, "truth"), sample)
    right = known.where(F.col(key) == F.col("truth")).select(sample, F.col(key).alias("chosen"))
    by_votes = ranked(known, sample, order_of("current", key), "vote_rank")
    both = ranked(by_votes, sample, order_of("score", key), "score_rank")
    wrong = both.where(F.col(key) != F.col("truth"))
    kind = F.when(F.col("vote_rank") == 1, 1).when(F.col("score_rank") == 1, 2).otherwise(3)
    wrong = ranked(wrong.withColumn("priority", kind), sample, [F.col("priority"), F.col("votes").desc(), F.col("max_score").desc(), F.col(key)], "\x01n").where(F.col("\x01n") <= most_negatives)
    names = F.element_at(F.array(F.lit("voted_wrong"), F.lit("scored_wrong"), F.lit("hard_negative")), F.col("priority"))
    pairs = right.join(wrong.select(sample, F.col(key).alias("rejected"), names.alias("pair_type"), "priority"), sample)
    return pairs.select(sample, "pair_type", "priority", "chosen", "rejected")


def merged_pairs(*pairs: DataFrame, keys: Sequence[str] = ("id", "chosen", "rejected")) -> DataFrame:
    """Pairs of several sources; of equal ones that of least priority, then of the earliest source."""
    every = None
    for i, p in enumerate(pairs):
        p = p.withColumn("source_index", F.lit(i))
        every = p if every is None else every.unionByName(p)
    return best(every, list(keys), [F.col("priority"), F.col("source_index"), F.col("pair_type")])


def as_sft(pairs: DataFrame, prompt: Column) -> DataFrame:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return pairs.select("id", F.array(turn("user", prompt), turn("assistant", F.col("chosen"))).alias("messages"))


def as_dpo(pairs: DataFrame, prompt: Column) -> DataFrame:
    return pairs.select("id", prompt.alias("prompt"), "chosen", "rejected")
