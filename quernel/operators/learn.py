"""Small learned scorers: Spark makes the sums or examples, the driver solves tiny systems."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.functions.numbers import dot
from quernel.operators.rank import best


def gram(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(i, j, value): sums of products of features, the target at j = -1; one aggregate, features squared numbers of sums."""
    sums = [F.sum(F.col(a).cast("double") * F.col(b)).alias(f"{i}:{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
    sums += [F.sum(F.col(a).cast("double") * F.col(target)).alias(f"{i}:-1") for i, a in enumerate(features)]
    row = df.agg(*sums)
    long = row.unpivot([], row.columns, "at", "value")
    return long.select(F.split("at", ":")[0].cast("int").alias("i"), F.split("at", ":")[1].cast("int").alias("j"), F.coalesce("value", F.lit(0.0)).alias("value"))


def ridge(grams: DataFrame, n_features: int, strength: float) -> list[float]:
    """Weights of a ridge regression from its Gram matrix."""
    a, b = np.zeros((n_features, n_features)), np.zeros(n_features)
    for i, j, v in grams.collect():  # features squared rows
        if j < 0:
            b[i] = v
        else:
            a[i, j] = a[j, i] = v
    return np.linalg.solve(a + strength * np.eye(n_features), b).tolist()


def pair_differences(rows: DataFrame, sample: str, positive: str, features: Sequence[str], most: int) -> DataFrame:
    """Features of a sample's positives less those of its negatives, `most` negatives of a sample."""
    from quernel.operators.rank import top

    neg = top(rows.where(~F.col(positive)), sample, [F.col("votes").desc(), F.col("canonical")], most)
    p = rows.where(positive).select(sample, *[F.col(f).cast("double").alias(f"p_{f}") for f in features])
    return p.join(neg.select(sample, *features), sample).select(sample, *[(F.col(f"p_{f}") - F.col(f)).alias(f) for f in features])


def fit_pairwise(differences: DataFrame, features: Sequence[str], rows: int = 20_000, epochs: int = 20, rate: float = 0.1) -> list[float]:
    """Logistic regression without intercept on differences, from at most about `rows` of them."""
    from pyspark.sql.functions import hash as h

    n = max(1, differences.count())
    some = differences if n <= rows else differences.where(F.pmod(h(*differences.columns), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    x = np.array([[r[f] for f in features] for r in some.select(*features).collect()], float).reshape(-1, len(features))
    w = np.zeros(len(features))
    for _ in range(epochs * 10):
        w += rate * (x * (1 / (1 + np.exp(np.clip(x @ w, -40, 40))))[:, None]).mean(0) if len(x) else 0
    return w.tolist()


def policy_score(features: Sequence[str], weights: Sequence[float], digits: int = 9) -> Column:
    return F.round(dot(F.array(*[F.col(f).cast("double") for f in features]), F.array(*[F.lit(float(w)) for w in weights])), digits)


def policy_ranked(rows: DataFrame, sample: str, features: Sequence[str], weights: Sequence[float], key: str) -> DataFrame:
    """The candidate of greatest policy score in each sample."""
    return best(rows.withColumn("policy_score", policy_score(features, weights)), sample, [F.col("policy_score").desc(), F.col(key)])


def fallback_or_policy(chosen: DataFrame, fallback: DataFrame, margin: float, sample: str = "id", key: str = "canonical") -> DataFrame:
    """The policy's choice if it agrees with the fallback or beats it by `margin`; else the fallback, with the reason."""
    p = chosen.select(sample, F.col(key).alias("p"), F.col("policy_score").alias("ps"))
    f = fallback.select(sample, F.col(key).alias("f"), F.col("policy_score").alias("fs"))
    j = f.join(p, sample, "left")
    reason = F.when(F.col("p").isNull(), "fallback").when(F.col("p") == F.col("f"), "agreement").when(F.col("ps") - F.col("fs") >= margin, "override").otherwise("fallback")
    return j.withColumn("reason", reason).select(sample, F.when(F.col("reason") == "override", F.col("p")).otherwise(F.col("f")).alias("selected"), "reason")


def ensemble(scored: DataFrame, sample: str, key: str, model: str, score: str) -> DataFrame:
    """Mean score over the models that scored a candidate."""
    return scored.groupBy(sample, key).agg(F.avg(score).alias("mean_score"), F.count_distinct(model).alias("n_models"))


def mlp_scores(df: DataFrame, features: Sequence[str], layers: Sequence[tuple[Sequence[Sequence[float]], Sequence[float]]], to: str = "score") -> DataFrame:
    """Scores of a multilayer perceptron with ReLU between layers, given its weights: expressions, no Python rows."""
    x = [F.col(f).cast("double") for f in features]
    for k, (weights, bias) in enumerate(layers):
        x = [sum((F.lit(float(w)) * v for w, v in zip(row, x)), F.lit(float(b))) for row, b in zip(weights, bias)]
        if k < len(layers) - 1:
            x = [F.greatest(v, F.lit(0.0)) for v in x]
    return df.withColumn(to, x[0])


# Listwise choice


def choice_examples(rows: DataFrame, sample: str, positive: str, weight: str, order: Sequence[Column], most: int) -> tuple[DataFrame, DataFrame]:
    """The samples that a listwise choice can learn from, and how many samples each reason left out.

    A sample without a positive candidate, with one candidate, or of no weight
    teaches nothing; of the others all positives stay, and negatives in order
    until there are `most`.
    """
    sizes = rows.groupBy(sample).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(positive)).alias("p"), F.max(weight).alias("w"))
    reason = F.when(F.col("p") == 0, "no_oracle_positive").when(F.col("n") <= 1, "single_candidate").when(F.coalesce(F.col("w"), F.lit(0.0)) <= 0, "zero_weight").otherwise("accepted")
    marked = sizes.select(sample, reason.alias("reason"))
    stats = marked.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    some = rows.join(marked.where("reason = 'accepted'").select(sample), sample, "left_semi")
    r = some.withColumn("\x01n", F.row_number().over(W.partitionBy(sample).orderBy(F.col(positive).desc(), *order)))
    return r.where(F.col(positive) | (F.col("\x01n") <= most)).drop("\x01n"), stats


def choice_gradient(rows: DataFrame, sample: str, positive: str, weight: str, features: Sequence[str], weights: Sequence[float], hard_negative: float = 0.0) -> DataFrame:
    """One row: the weighted mean loss of a linear listwise choice, and its gradient by feature.

    A sample's loss is the log of all candidates' summed exponentials less that
    of its positives', plus `hard_negative` times the softplus of the best
    negative's lead over the best positive. Greatest scores are taken off before
    anything is exponentiated. Every candidate adds its coefficient times its
    features, so samples are windows of one shuffle and the rest is sums.
    """
    score = F.lit(0.0)
    for f, w in zip(features, weights):
        score = score + F.col(f).cast("double") * F.lit(float(w))
    d = rows.withColumns({"\x01s": score, "\x01p": F.col(positive)})
    w, s, pos = W.partitionBy(sample), F.col("\x01s"), F.col("\x01p")
    mine = lambda side: F.max(F.when(side, s)).over(w)
    d = d.withColumns({"\x01m": F.max(s).over(w), "\x01mp": mine(pos), "\x01mn": mine(~pos)})
    e, ep = F.exp(s - F.col("\x01m")), F.when(pos, F.exp(s - F.col("\x01mp"))).otherwise(0.0)
    top_p, top_n = pos & (s == F.col("\x01mp")), ~pos & (s == F.col("\x01mn"))
    d = d.withColumns({
        "\x01e": e, "\x01ep": ep, "\x01z": F.sum(e).over(w), "\x01zp": F.sum(ep).over(w), "\x01size": F.count(F.lit(1)).over(w),
        "\x01tp": F.sum(top_p.cast("double")).over(w), "\x01tn": F.sum(top_n.cast("double")).over(w), "\x01tops": top_p.cast("double"), "\x01topn": top_n.cast("double"),
    })
    lead = F.col("\x01mn") - F.col("\x01mp")
    softplus = F.when(lead > 30, lead).otherwise(F.log1p(F.exp(lead)))
    hard = F.coalesce(F.lit(float(hard_negative)) * softplus, F.lit(0.0))
    slope = F.coalesce(F.lit(float(hard_negative)) / (1 + F.exp(-lead)), F.lit(0.0))
    coefficient = F.col("\x01e") / F.col("\x01z") - F.col("\x01ep") / F.col("\x01zp") + slope * (F.coalesce(F.try_divide("\x01topn", "\x01tn"), F.lit(0.0)) - F.coalesce(F.try_divide("\x01tops", "\x01tp"), F.lit(0.0)))
    loss = F.log("\x01z") + F.col("\x01m") - F.log("\x01zp") - F.col("\x01mp") + hard
    g = F.col(weight).cast("double")
    total = F.greatest(F.sum(g / F.col("\x01size")), F.lit(1e-8))
    return d.agg(
        (F.sum(g * loss / F.col("\x01size")) / total).alias("loss"), *[(F.sum(g * coefficient * F.col(f).cast("double")) / total).alias(f) for f in features]
    )


def fit_choice(rows: DataFrame, sample: str, positive: str, weight: str, features: Sequence[str], rounds: int = 40, rate: float = 1.0, strength: float = 0.0, hard_negative: float = 0.0) -> tuple[list[float], list[float]]:
    """Weights of a linear listwise choice and the losses on the way, by full passes over all rows.

    Each pass brings one row to the driver. A step that doesn't lessen the loss
    is taken back and halved; one that does is lengthened a little.
    """
    def at(w):
        r = choice_gradient(rows, sample, positive, weight, features, w, hard_negative).first()
        return (r["loss"] or 0.0) + strength * float(w @ w) / 2, np.array([r[f] or 0.0 for f in features]) + strength * w

    w = np.zeros(len(features))
    loss, slope = at(w)
    losses = [loss]
    for _ in range(rounds):
        tried = w - rate * slope
        new, new_slope = at(tried)
        if new < loss:
            w, loss, slope, rate = tried, new, new_slope, rate * 1.3
        else:
            rate /= 2
        losses.append(loss)
    return w.tolist(), losses


def margin_choice(scored: DataFrame, mode: str, margin: float) -> DataFrame:
    """Each sample's choice of an ensemble by a margin: id, selected, reason.

    scored: id, policy, policy_score, second_score (null if there is one
    candidate), fallback, fallback_score and spread (of the policy's score over
    the models). The policy stands by `fallback` if it leads the fallback by the
    margin, by `second` if it leads its runner-up, by `certain` if it leads the
    fallback by the margin times the spread besides.
    """
    lead = F.col("policy_score") - F.col("fallback_score")
    by = {"fallback": lead >= margin, "second": F.col("second_score").isNull() | (F.col("policy_score") - F.col("second_score") >= margin), "certain": lead >= margin * (1 + F.coalesce(F.col("spread"), F.lit(0.0)))}
    if mode not in by:
        raise ValueError(f"unknown mode {mode}")
    reason = F.when(F.col("policy").isNull(), "fallback").when(F.col("fallback").isNull(), "policy").when(F.col("policy") == F.col("fallback"), "agreement").when(by[mode], "override").otherwise("fallback")
    return scored.select("id", F.when(reason.isin("override", "policy"), F.col("policy")).otherwise(F.col("fallback")).alias("selected"), reason.alias("reason"))
