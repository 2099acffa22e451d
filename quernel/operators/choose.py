"""Choosing one candidate of a sample, and preference pairs from pools of candidates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.functions.text import filled, trimmed
from quernel.operators.rank import best, running

#: What stands in for a missing score and a missing index when votes are counted, and for a missing index in a pool.
NO_SCORE, NO_INDEX, NO_POOL_INDEX = -1e6, 99, 999
#: What marks an isomer, what joins fragments, and what names pages whose choices are soft.
ISOMER, FRAGMENT, SOFT_PAGES = "\\", ".", ("chinese_exam", "exam_q1")


def aggregates(cands: DataFrame, sample: str = "id", key: str = "canonical") -> DataFrame:
    """One row for each key of a sample: votes, scores, the least index of each kind, and the representative's fields.

    cands: sample, key, place (its place in the sample), score, prompt_index,
    tta_index, generation_index, penalty, prediction. Candidates without a key
    are left out. The representative has the greatest score, then the least
    indices, then the first place; the mean is of the scores that are there.
    """
    known = cands.where(filled(key).isNotNull())
    index = lambda c: F.coalesce(F.col(c), F.lit(NO_INDEX))
    lead = F.struct(F.coalesce(F.col("score"), F.lit(NO_SCORE)), *[-index(c) for c in ("prompt_index", "tta_index", "generation_index")], -F.col("place"))
    return known.groupBy(sample, key).agg(
        F.count(F.lit(1)).alias("votes"), F.coalesce(F.max("score"), F.lit(NO_SCORE)).alias("max_score"), F.coalesce(F.avg("score"), F.lit(NO_SCORE)).alias("mean_score"),
        *[F.min(index(c)).alias(f"min_{c}") for c in ("prompt_index", "tta_index", "generation_index")], F.min("place").alias("first_place"),
        F.max_by(F.struct("prediction", "score", "penalty"), lead).alias("representative"),
    )


def current_order() -> list[Column]:
    """By votes, greatest score, the representative's penalty and length, least indices, then the first place."""
    rep = F.col("representative")
    order = [F.col("votes").desc(), F.col("max_score").desc(), F.coalesce(rep["penalty"], F.lit(0)).asc(), F.length(F.coalesce(rep["prediction"], F.lit(""))).asc()]
    return [*order, F.col("min_prompt_index"), F.col("min_tta_index"), F.col("min_generation_index"), F.col("first_place")]


def current(aggs: DataFrame, sample: str = "id") -> DataFrame:
    """The first by current_order."""
    return best(aggs, sample, current_order())


def light_marked(aggs: DataFrame, heavy: Column, charge: Column, skeleton: Column, salt_bonus: float = 2.0, heavy_penalty: float = 0.02, isomer_ratio: float = 0.25, sample: str = "id", key: str = "canonical") -> DataFrame:
    """aggs with two flags, of which a sample has one each at most: `\x01first`, the winner before the rescue, and `\x01rescue`, the isomer that takes over."""
    score = F.col("max_score") - F.lit(heavy_penalty) * heavy
    salted = F.col("votes") + F.lit(salt_bonus) * F.contains(key, F.lit(FRAGMENT)).cast("double")
    d = aggs.withColumns({"\x01score": score, "\x01salted": salted, "\x01skeleton": skeleton, "\x01charge": charge})
    w = W.partitionBy(sample).orderBy(F.col("\x01salted").desc(), F.col("\x01score").desc(), F.col("\x01charge"), F.col("min_prompt_index"), F.col("first_place"))
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = d.withColumns({"\x01first": F.row_number().over(w) == 1, "\x01lead": F.first(F.struct("\x01skeleton", "votes")).over(whole)})
    marked = F.coalesce((F.col("\x01skeleton") == F.col("\x01lead")["\x01skeleton"]) & F.contains(key, F.lit(ISOMER)), F.lit(False))
    isomers = W.partitionBy(sample).orderBy(marked.desc(), F.col("votes").desc(), F.col("\x01score").desc(), F.col("min_generation_index"), F.col("first_place"))
    d = d.withColumn("\x01rescue", (F.row_number().over(isomers) == 1) & marked & (F.col("votes") >= F.col("\x01lead")["votes"] * isomer_ratio))
    return d.select(*aggs.columns, "\x01first", "\x01rescue")


def light(aggs: DataFrame, heavy: Column, charge: Column, skeleton: Column, salt_bonus: float = 2.0, heavy_penalty: float = 0.02, isomer_ratio: float = 0.25, sample: str = "id", key: str = "canonical") -> DataFrame:
    """Two keys, then a rescue of isomers.

    First by votes plus a bonus for several fragments, then by the greatest
    score less the penalty of size, then small charge, least prompt index and
    first place. Of the marked isomers of the winner's skeleton the best by
    votes takes over if it has isomer_ratio of the winner's votes.
    """
    d = light_marked(aggs, heavy, charge, skeleton, salt_bonus, heavy_penalty, isomer_ratio, sample, key)
    chosen = best(d.where(F.col("\x01rescue") | F.col("\x01first")), sample, [F.col("\x01rescue").desc()])
    return chosen.select(*aggs.columns)


def picked(marked: DataFrame, orders: Mapping[str, Sequence[Column]], sample: str = "id", key: str = "canonical") -> DataFrame:
    """(sample, a key for each named order, light): what several rules choose, by sample and in one pass over what `light_marked` gives."""
    d = marked.withColumns({f"\x01{name}": F.row_number().over(W.partitionBy(sample).orderBy(*order)) for name, order in orders.items()})
    of = lambda c: F.max(F.when(c, F.col(key)))
    return d.groupBy(sample).agg(*[of(F.col(f"\x01{name}") == 1).alias(name) for name in orders], F.coalesce(of(F.col("\x01rescue")), of(F.col("\x01first"))).alias("light"))


def soft(aggs: DataFrame, heavy: Column, charge: Column, fragments: Column, count_bonus: float = 0.0, heavy_penalty: float = 0.006, sample: str = "id") -> DataFrame:
    """By one score: the greatest score plus a bonus a vote less the penalty of size; then small charge, few fragments, least prompt and generation index, first place."""
    score = F.col("max_score") + F.lit(count_bonus) * F.col("votes") - F.lit(heavy_penalty) * heavy
    return best(aggs, sample, [score.desc(), charge.asc(), fragments.asc(), F.col("min_prompt_index"), F.col("min_generation_index"), F.col("first_place")])


def soft_page(*fields: Column) -> Column:
    """Whether one of the fields together names a page whose choice is soft."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))
    out = F.lit(False)
    for name in SOFT_PAGES:
        out = out | F.contains(text, F.lit(name))
    return out


def hybrid(aggs: DataFrame, gates: DataFrame, chosen_light: Callable[[DataFrame], DataFrame], chosen_soft: Callable[[DataFrame], DataFrame], sample: str = "id") -> DataFrame:
    """Softly chosen where the sample's gate (sample, gate) is open, lightly elsewhere."""
    d = aggs.join(gates.select(sample, F.coalesce(F.col("gate"), F.lit(False)).alias("\x01gate")), sample)
    pick = lambda f, side: f(d.where(side).drop("\x01gate"))
    return pick(chosen_light, ~F.col("\x01gate")).unionByName(pick(chosen_soft, F.col("\x01gate")))


# Preference pairs

PAIR_POOL = "prompt string, prediction string, canonical_prediction string, raw_text string, vote_count int, prompt_index int, tta_index int, generation_index int"
#: What a pool is made into.
POOL = "array<struct<prediction: string, canonical_prediction: string, raw_text: string, vote_count: int, prompt_index: int, tta_index: int, generation_index: int>>"


def with_rejected(rows: DataFrame, canonical: Callable[[Column], Column], allow_invalid: bool = True, to: str = "rejected") -> DataFrame:
    """rows with the wrong answer that is worth most as a rejected one, and its negative_kind; null if there is none, or no target.

    rows: prompt, target, and selected and candidates, structs like PAIR_POOL
    and an array of them. The pool is the selected answer, unless it is empty,
    and the candidates of the row's prompt, each once by prompt, prediction,
    canonical form and raw text, the first staying. Of answers that aren't the
    target the best is valid, has the most votes, the least difference in
    length, the least indices, is short, and last in alphabetical order.
    """
    nothing, selected = F.lit(""), F.col("selected")

    def made(c: Column, votes: Column | None) -> Column:
        prediction, given = F.coalesce(trimmed(c["prediction"]), nothing), filled(c["canonical_prediction"])
        count = F.coalesce(c["vote_count"], *([votes] if votes is not None else []), F.lit(0))
        index = lambda n: F.coalesce(c[n], F.lit(NO_POOL_INDEX)).alias(n)
        return F.struct(
            prediction.alias("prediction"), F.coalesce(given, F.when(prediction != "", canonical(prediction))).alias("canonical_prediction"), F.coalesce(trimmed(c["raw_text"]), nothing).alias("raw_text"),
            count.alias("vote_count"), index("prompt_index"), index("tta_index"), index("generation_index"),
        )

    # each step is a column of its own, so that nothing is evaluated again within a function of arrays
    same = F.filter("candidates", lambda c: F.coalesce(filled(c["prompt"]), F.col("prompt")) == F.col("prompt"))
    every = F.concat(F.array(made(selected, None)), F.coalesce(F.transform(same, lambda c: made(c, selected["vote_count"])), F.array().cast(POOL)))
    some = lambda c, i: (i > 0) | (c["prediction"] != "") | c["canonical_prediction"].isNotNull() | (c["raw_text"] != "")
    signature = lambda c: F.struct(c["prediction"], F.coalesce(c["canonical_prediction"], nothing), c["raw_text"])
    d = rows.withColumn("\x01every", every).withColumn("\x01pool", F.filter("\x01every", some)).withColumn("\x01signs", F.transform("\x01pool", signature))
    once = F.filter("\x01pool", lambda c, i: F.array_position(F.col("\x01signs"), signature(c)) == i + 1)
    wrong = lambda c: (c["prediction"] != "") & ~c["canonical_prediction"].eqNullSafe(F.col("target")) & (F.lit(allow_invalid) | c["canonical_prediction"].isNotNull())

    def scored(c: Column, i: Column) -> Column:
        return F.struct(
            c["canonical_prediction"].isNotNull().cast("int").alias("valid"), c["vote_count"].alias("votes"), (-F.abs(F.length(c["prediction"]) - F.length("target"))).alias("nearness"),
            (-c["prompt_index"]).alias("p"), (-c["tta_index"]).alias("t"), (-c["generation_index"]).alias("g"), (-F.length(c["prediction"])).alias("shortness"), c["prediction"].alias("prediction"), (-i).alias("place"),
        )

    d = d.withColumn("\x01once", once).withColumn("\x01wrong", F.filter("\x01once", wrong)).withColumn("\x01top", F.array_max(F.transform("\x01wrong", scored)))
    top = F.col("\x01top")
    found = F.struct(top["prediction"].alias("prediction"), top["votes"].alias("vote_count"), F.when(top["valid"] == 1, "valid_wrong").otherwise("invalid_wrong").alias("negative_kind"))
    return d.withColumn(to, F.when(top.isNotNull() & F.col("target").isNotNull(), found)).select(*[c for c in rows.columns if c != to], to)


def preference_scan(rows: DataFrame, run: str, line: str, source: str, rejected: str, per_source: int, total: int, span: int = 1 << 16) -> DataFrame:
    """Rows with `status` as a scan in the order of run and line leaves them: kept, source_cap, total_cap or no_rejected.

    A row is kept if it has a rejected answer, its source has fewer than
    per_source kept rows before it, and all sources together fewer than total (0
    is no limit). Counts run over ranges of `span` lines of a run, shifted by
    what the ranges before hold, so a hot source is many tasks.
    """
    made = F.col(rejected).isNotNull().cast("long")
    d = running(rows.withColumn("\x01made", made), source, run, line, "\x01made", "\x01of_source", span)
    before = F.col("\x01of_source") - F.col("\x01made")
    over = (before >= per_source) if per_source > 0 else F.lit(False)
    d = d.withColumn("\x01over", over).withColumn("\x01kept", F.when(F.col("\x01over"), 0).otherwise(F.col("\x01made")))
    if total > 0:
        d = running(d, None, run, line, "\x01kept", "\x01all", span)
        full = F.col("\x01all") - F.col("\x01kept") >= total
    else:
        full = F.lit(False)
    status = F.when(full, "total_cap").when(F.col("\x01over"), "source_cap").when(F.col("\x01made") == 1, "kept").otherwise("no_rejected")
    return d.withColumn("status", status).select(*rows.columns, "status")


def preference_pairs(rows: DataFrame, benchmark: DataFrame, canonical: Callable[[Column], Column], default_prompt: str, per_source: int, total: int, allow_invalid: bool = True, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """rows: id, run_index, line_no, prompt, selected (like PAIR_POOL) and candidates (an array of them); benchmark: id, source, target. Each row of a benchmark's sample with rejected and status.

    Benchmark rows without an id, of sources that aren't included or are
    excluded, and rows that aren't in the benchmark, are left out; a sample
    without a target is `missing_target` unless a cap has come first.
    """
    known = benchmark.where(F.col("id").isNotNull())
    known = known.where(F.col("source").isin(*include)) if include else known
    known = known.where(~F.col("source").isin(*exclude)) if exclude else known
    j = rows.join(known.select("id", "source", filled("target").alias("target")), "id")
    j = j.withColumn("prompt", F.coalesce(filled("prompt"), F.lit(default_prompt)))
    scanned = preference_scan(with_rejected(j, canonical, allow_invalid), "run_index", "line_no", "source", "rejected", per_source, total)
    lost = (F.col("status") == "no_rejected") & F.col("target").isNull()
    return scanned.withColumn("status", F.when(lost, "missing_target").otherwise(F.col("status")))
