"""Building data sets and grids: mixtures, hard replay, record predicates, validations, weight rules, paired reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.keys import hash_order
from quernel.functions.text import TOKEN, filled, trimmed, without_space
from quernel.operators.rank import best, ranked, spread_rank

# Mixtures


def factorial_mixtures(parts: DataFrame, part: str, recipes: Mapping[str, tuple[Sequence[str], int]], key: str) -> DataFrame:
    """Rows with `mixture` and `order_key`: each row once for every mixture whose recipe names its part, in the order of a hash by the mixture's seed.

    One pass over the parts: a row is exploded to its mixtures, no union reads it twice.
    """
    named = [F.when(F.col(part).isin(*names), F.struct(F.lit(m).alias("mixture"), F.lit(str(seed)).alias("seed"))) for m, (names, seed) in recipes.items()]
    out = parts.withColumn("\x01m", F.explode(F.filter(F.array(*named), lambda m: m.isNotNull())))
    return out.withColumn("mixture", F.col("\x01m.mixture")).withColumn("order_key", F.sha2(F.concat_ws("|", "\x01m.seed", part, F.col(key).cast("string")), 256)).drop("\x01m")


def hash_capped(df: DataFrame, cap: int, seed: int, key: str) -> DataFrame:
    """The first `cap` rows in hash order, with that order: a sampling operator."""
    return df.withColumn("order_key", hash_order(seed, key)).orderBy("order_key", key).limit(cap)


#: How often a base row of a difficulty comes, and a row of an extra bucket; others come once and 8 times.
DIFFICULTY_TIMES = {
    "handwritten": 8, "chinese_exam": 6, "photo": 6, "scan": 6, "degraded_scan": 6, "document_embed": 5, "journal_fig": 5, "multi_grid": 5, "page_level": 5, "hard": 3, "medium_hard": 2,
    "abbreviated": 2, "large": 2, "medium": 1, "easy": 1, "clean": 1,
}
BUCKET_TIMES, OTHER_BUCKETS = {"auto_photo_scan": 14, "auto_document_context": 14, "auto_exam_context": 14, "auto_handdrawn_like": 14, "auto_long_stereo": 10}, 8
#: The least and the most repeats of a source, whatever the difficulty.
SOURCE_TIMES = {"real_world": (4, None), "molgrapher_synthetic": (2, 3), "uspto": (1, 2), "uspto30k_abbreviated": (1, 2), "uspto30k_large": (1, 2), "uob": (1, 1), "uspto30k_clean": (1, 1)}


def named_times(column, times: Mapping[str, int], other: int) -> Column:
    """How often a value's rows come, by its name."""
    return F.coalesce(*[F.when(_c(column) == d, n) for d, n in times.items()], F.lit(other))


def base_times(source, difficulty, times: Mapping[str, int] = DIFFICULTY_TIMES, clamps: Mapping[str, tuple[int, int | None]] = SOURCE_TIMES) -> Column:
    """Repeats of a base row: by its difficulty, then held between its source's least and most."""
    out = n = named_times(difficulty, times, 1)
    for name, (least, most) in clamps.items():
        held = F.greatest(n, F.lit(least))
        out = F.when(_c(source) == name, F.least(held, F.lit(most)) if most else held).otherwise(out)
    return out


def hard_replay(base: DataFrame, extra: DataFrame, heldout: DataFrame, key: str, target: str, source: str, difficulty: str, bucket: str, caps: Mapping[str, int], at: str, seed: int, times: Mapping[str, int] = DIFFICULTY_TIMES, clamps: Mapping[str, tuple[int, int | None]] = SOURCE_TIMES, bucket_times: Mapping[str, int] = BUCKET_TIMES, other_buckets: int = OTHER_BUCKETS) -> DataFrame:
    """Rows with policy and repeat_index: what has a held-out target goes, the first row of a key stays, sources are capped in hash order, hard rows repeat.

    Base rows repeat by difficulty within their source's bounds; rows of `extra`
    aren't capped and repeat by their bucket, or their difficulty if they have
    none, other_buckets times where that isn't named. A missing source,
    difficulty or bucket is `unknown`.
    """
    fresh = lambda df: best(df.join(heldout.select(target).distinct(), target, "left_anti"), key, [F.col(at)])
    named = lambda *c: F.coalesce(*[F.nullif(F.col(x).cast("string"), F.lit("")) for x in c], F.lit("unknown"))
    cap = F.coalesce(*[F.when(F.col(source) == s, n) for s, n in caps.items()], F.lit(1 << 62))
    kept = spread_rank(fresh(base), source, hash_order(seed, key), F.col(key), "\x01n").where(F.col("\x01n") <= cap).drop("\x01n")

    def repeated(df: DataFrame, n: Column, name: Column) -> DataFrame:
        df = df.withColumn("\x01t", n)
        df = df.withColumn("policy", F.concat(name, F.lit(":repeat_"), F.col("\x01t").cast("string")))
        return df.withColumn("repeat_index", F.explode(F.sequence(F.lit(0), F.col("\x01t") - 1))).drop("\x01t")

    first = repeated(kept, base_times(named(source), named(difficulty), times, clamps), F.concat(F.lit("base_"), named(source), F.lit("_"), named(difficulty)))
    where = named(bucket, difficulty)
    return first.unionByName(repeated(fresh(extra), named_times(where, bucket_times, other_buckets), F.concat(F.lit("auto_"), where)))


def replay_report(built: DataFrame, base: DataFrame, extra: DataFrame, heldout: DataFrame, target: str, source: str) -> DataFrame:
    """(what, name, n) of a replay set: rows by policy and by source, and base and extra rows that a held-out target took."""
    by = lambda what, c: built.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "name", "n")
    held = heldout.select(target).distinct()
    lost = lambda name, df: df.join(held, target, "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit("skipped").alias("what"), F.lit(name).alias("name"), "n")
    return by("policy", "policy").unionByName(by("source", source)).unionByName(lost("base_heldout", base)).unionByName(lost("extra_heldout", extra))


# Predicates and records


def canonical_record(prompt, answer, fragment: str, refused_prompt: str, refused_answer: str) -> Column:
    """Whether a pair of texts is one of prompt with `fragment` and answer: none of the refused forms, no empty answer."""
    a, p = trimmed(F.coalesce(_c(answer), F.lit(""))), F.coalesce(_c(prompt), F.lit(""))
    return (a != "") & ~F.startswith(a, F.lit(refused_answer)) & ~F.contains(p, F.lit(refused_prompt)) & F.contains(p, F.lit(fragment))


def any_of(*conditions: Column) -> Column:
    """Whether one of some conditions holds; unknown ones don't."""
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def from_sources(df: DataFrame, source: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Rows of listed sources (all if none is listed) that aren't excluded."""
    s = F.coalesce(F.col(source), F.lit(""))
    df = df.where(s.isin(*include)) if include else df
    return df.where(~s.isin(*exclude)) if exclude else df


def first_domain(columns: Sequence[str], domains: Sequence[str]) -> Column:
    """The first of some domains, in sorted order, that the first of some columns to name one names; empty if none does."""
    found = [F.when(F.contains(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(d)), F.lit(d)) for c in columns for d in sorted(domains)]
    return F.coalesce(*found, F.lit(""))


def review_problems(df: DataFrame, ids: Sequence[str], consent: str, reviews: Sequence[str], repeated: str) -> DataFrame:
    """(columns of df, problem): the first thing wrong with a row of private data; rows in order are left out.

    Ids must be there and unique, consent given (yes, true, 1), each review passed.
    """
    low = lambda c: F.lower(trimmed(F.coalesce(F.col(c), F.lit(""))))
    n = df.groupBy(F.col(repeated).alias("\x01k")).agg(F.count(F.lit(1)).alias("\x01n"))
    j = df.join(n, F.col(repeated).eqNullSafe(F.col("\x01k")), "left")
    rules = [(filled(c).isNull(), f"{c} is required") for c in ids]
    rules += [(F.col("\x01n") > 1, f"duplicate {repeated}"), (~low(consent).isin("yes", "true", "1"), f"{consent} must be yes")]
    rules += [(low(c) != "pass", f"{c} must be pass") for c in reviews]
    problem = F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for c, name in rules])
    return j.withColumn("problem", problem).where("problem is not null").drop("\x01k", "\x01n")


def constant_violations(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """(column, n): how many rows differ from what every row must have; no rows if nothing does. One pass, and n counts nulls."""
    differ = [F.sum((~F.col(c).cast("string").eqNullSafe(F.lit(v))).cast("long")).alias(c) for c, v in expected.items()]
    wide = df.agg(*differ)
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("n")) for c in expected])).alias("x")).select("x.*")
    return long.where("n > 0")


def message_record(df: DataFrame, id_: str, image: Column, prompt: str, answer: Column, **meta: Column) -> DataFrame:
    """A training record: messages of two turns, images with a path from the working folder, and meta with the answer's length and whether it marks stereo."""
    path = F.replace(image, F.lit("\\"), F.lit("/"))
    path = F.when(F.startswith(path, F.lit("./")) | F.startswith(path, F.lit("http")), path).otherwise(F.concat(F.lit("./"), path))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    facts = [F.col(id_).alias("id"), *[c.alias(k) for k, c in meta.items()], F.length(answer).alias("answer_length"), F.contains(answer, F.lit("@")).alias("contains_stereo")]
    return df.select(F.array(turn("user", F.lit(f"<image>{prompt}")), turn("assistant", answer)).alias("messages"), F.array(path).alias("images"), F.struct(*facts).alias("meta"))


# Weights, settings, warnings, features


def weight_rules(text: str) -> tuple[float, list[tuple[str, str, float]]]:
    """Default weight and rules (field, value, weight) of `field:value=w,default=w`."""
    default, rules = 1.0, []
    for item in filter(None, map(str.strip, (text or "").split(","))):
        left, equals, right = item.partition("=")
        field, colon, value = left.strip().partition(":")
        if not equals or not (colon or field == "default"):
            raise ValueError(f"bad weight rule: {item!r}")
        if not colon:
            default = float(right)
        else:
            rules.append((field.strip(), value.strip(), float(right)))
    return default, rules


def rule_weight(text: str) -> Column:
    """The default times the weight of every rule that a row meets; not below 0."""
    default, rules = weight_rules(text)
    out = F.lit(default)
    for field, value, w in rules:
        out = out * F.when(F.coalesce(F.col(field).cast("string"), F.lit("")) == value, F.lit(w)).otherwise(F.lit(1.0))
    return F.greatest(F.lit(0.0), out)


def clamped(x, low: float, high: float, fallback: float | None) -> Column:
    """A number within bounds; the fallback for what is no finite number."""
    v = _c(x).try_cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(finite, F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), v))).otherwise(F.lit(fallback).cast("double"))


def image_warnings(width: Column, height: Column, brightness: Column, contrast: Column) -> Column:
    """What speaks against an image: a short side under 256, light outside 45 to 235, contrast under 18; an unknown size or value says nothing."""
    short = (width > 0) & (height > 0) & (F.least(width, height) < 256)
    found = ((short, "short_side"), ((brightness < 45) | (brightness > 235), "exposure"), (contrast < 18, "contrast"))
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in found]), lambda w: w.isNotNull())


#: The characters that a molecular string may hold.
ALLOWED = r"A-Za-z0-9\[\]()=.#+\-\\/:@*%$"


def text_features(x, canonical) -> dict[str, Column]:
    """The features of a candidate that its text alone gives; those of its atoms need a chemistry library."""
    t, c = without_space(F.coalesce(_c(x), F.lit(""))), F.coalesce(_c(canonical), F.lit(""))
    n = lambda pattern: F.length(F.regexp_replace(t, f"[^{pattern}]", ""))
    chars = F.array_distinct(F.filter(F.split(t, ""), lambda s: s != ""))
    cut = F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))
    digits = F.filter(chars, lambda s: s.rlike("[0-9]"))
    counts = {
        "valid": (c != "").cast("int"), "raw_len": F.length(t), "canonical_len": F.length(c), "raw_len_sq": F.length(t) * F.length(t),
        "token_count": F.when(F.size(cut) > 0, F.size(cut)).otherwise(F.length(t)), "token_mismatch": (F.array_join(cut, "") != t).cast("int"),
        "unique_char_count": F.size(chars), "digit_count": n("0-9"), "ring_digit_count": F.size(digits),
        "ring_digit_imbalance": F.size(F.filter(digits, lambda d: F.length(F.replace(t, d, F.lit(""))) % 2 != F.length(t) % 2)),
        "branch_count": n("()"), "bond_count": n(r"=#/\\"), "bracket_count": n(r"\[\]"), "aromatic_count": n("bcnops"),
        "upper_count": n("A-Z"), "lower_count": n("a-z"), "stereo_count": n("@"), "dot_count": n("."), "plus_count": n("+"), "hyphen_count": n(r"\-"),
        "invalid_char_count": F.length(F.regexp_replace(t, f"[{ALLOWED}]", "")),
    }
    return {k: v.cast("double").alias(k) for k, v in counts.items()}


# Preference pairs and policy grids


def typed_pairs(aggregates: DataFrame, truth: DataFrame, picks: DataFrame, order: Sequence[Column], most_negatives: int, sample: str = "id", key: str = "canonical") -> DataFrame:
    """(sample, pair_type, chosen, rejected): the right candidate against each wrong one that something picked, under the first type that fits.

    picks holds a row a sample with `selected`, `light` and `policy`. Types in
    order: the selection, the light rule's and the policy's choice where wrong,
    then the first most_negatives wrong ones. A guard pair (selection right,
    light rule or policy wrong) has the same sides as an earlier type, so it
    never gives a pair of its own. Each wrong candidate is looked at once.
    """
    known = aggregates.join(truth.select(sample, "truth"), sample)
    right = known.where(F.col(key) == F.col("truth")).select(sample, F.col(key).alias("chosen"))
    wrong = ranked(known.where(F.col(key) != F.col("truth")), sample, order, "\x01n").join(picks.select(sample, "selected", "light", "policy"), sample, "left")
    kinds = [(F.col(key) == F.col("selected"), "oracle_positive_vs_selected"), (F.col(key) == F.col("light"), "oracle_positive_vs_chem_light"), (F.col(key) == F.col("policy"), "oracle_positive_vs_reward_policy"), (F.col("\x01n") <= most_negatives, "oracle_positive_vs_hard_negative")]
    wrong = wrong.withColumn("pair_type", F.coalesce(*[F.when(c, F.lit(name)) for c, name in kinds])).where("pair_type is not null")
    return right.join(wrong.select(sample, "pair_type", F.col(key).alias("rejected")), sample).select(sample, "pair_type", "chosen", "rejected")


def policy_grid(samples: DataFrame, fallbacks: Sequence[str], margins: Sequence[float]) -> DataFrame:
    """(fallback, margin, total, policy_exact, gain_over_selected, gain_over_light, bad_changes, good_changes) of every pair.

    samples: truth, selected, light, policy, and policy_score, selected_score,
    light_score. The policy's choice stands where there is no fallback or its
    score is higher by the margin; `none` never falls back. Rows are multiplied
    by the grid inside a task and summed there.
    """
    grid = F.array(*[F.struct(F.lit(f).alias("fallback"), F.lit(float(m)).alias("margin")) for f in fallbacks for m in margins])
    g = samples.withColumn("\x01g", F.explode(grid)).select("*", "\x01g.*").drop("\x01g")
    other = F.when(F.col("fallback") == "selected", F.col("selected")).when(F.col("fallback") == "chem_light", F.col("light"))
    score = F.when(F.col("fallback") == "selected", F.col("selected_score")).when(F.col("fallback") == "chem_light", F.col("light_score"))
    made = F.when(other.isNull() | (F.col("policy_score") - score >= F.col("margin")), F.col("policy")).otherwise(other)
    hit = lambda c: F.coalesce(c == F.col("truth"), F.lit(False))
    new, was, light, moved = hit(made), hit(F.col("selected")), hit(F.col("light")), ~made.eqNullSafe(F.col("selected"))
    n = lambda c: F.sum(c.cast("long"))
    sums = g.groupBy("fallback", "margin").agg(F.count(F.lit(1)).alias("total"), n(new).alias("\x01p"), n(was).alias("\x01s"), n(light).alias("\x01l"), n(moved & was & ~new).alias("bad_changes"), n(moved & new & ~was).alias("good_changes"))
    part = lambda c: F.round(c / F.col("total"), 9)
    return sums.select("fallback", "margin", "total", part(F.col("\x01p")).alias("policy_exact"), part(F.col("\x01p") - F.col("\x01s")).alias("gain_over_selected"), part(F.col("\x01p") - F.col("\x01l")).alias("gain_over_light"), "bad_changes", "good_changes")


def margin_by_group(predictions: DataFrame, best_margins: DataFrame, group: str, default: float, sample: str = "id") -> DataFrame:
    """Each sample's prediction at its group's margin, or at the default where the group has none. predictions: sample, group, margin and more."""
    j = predictions.join(best_margins.select(group, F.col("margin").alias("\x01m")), group, "left")
    return j.where(F.col("margin") == F.coalesce("\x01m", F.lit(default))).drop("\x01m")


# Paired reports


def mcnemar_p(wins, losses) -> Column:
    """Two-sided exact binomial p of discordant pairs, as a column: terms are summed from their logarithms."""
    w, l = _c(wins), _c(losses)
    n, k = (w + l).cast("double"), F.least(w, l)
    zero = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i)
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(steps, zero, step, lambda s: s["sum"])))


def correct_by(paired: DataFrame, fields: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """(field, value, n, baseline_correct, candidate_correct) for every value of each field, in one pass over grouping sets."""
    named = paired.select(*[F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias(f) for f in fields], F.col(a).alias("\x01a"), F.col(b).alias("\x01b"))
    sets = named.groupingSets([[F.col(f)] for f in fields], *[F.col(f) for f in fields])
    out = sets.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("\x01a").cast("long")).alias("baseline_correct"), F.sum(F.col("\x01b").cast("long")).alias("candidate_correct"), *[F.grouping(f).alias(f"\x01{f}") for f in fields])
    field, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f in fields:
        here = F.col(f"\x01{f}") == 0
        field, value = F.when(here, F.lit(f)).otherwise(field), F.when(here, F.col(f)).otherwise(value)
    return out.select(field.alias("field"), value.alias("value"), "n", "baseline_correct", "candidate_correct")


def rolled_up(reports: DataFrame, text: str, schema: str) -> DataFrame:
    """Reports in JSON as rows: the fields of `schema`, nested ones by their path."""
    return reports.select(*[c for c in reports.columns if c != text], F.from_json(text, schema, {"mode": "FAILFAST"}).alias("\x01r")).select("*", "\x01r.*").drop("\x01r")


def over_panels(scores: DataFrame, by: str, exact: str, valid: str) -> DataFrame:
    """(by, n_panels, macro_exact, min_valid): the mean over panels, and the least."""
    return scores.groupBy(by).agg(F.count(F.lit(1)).alias("n_panels"), F.round(F.avg(exact), 9).alias("macro_exact"), F.round(F.min(valid), 9).alias("min_valid"))


def latest_checkpoint(paths: DataFrame, phase: str, path: str) -> DataFrame:
    """(phase, step, path) of the folder with the greatest number in each phase; other folders don't count."""
    step = F.regexp_extract(F.substring_index(path, "/", -1), r"^checkpoint-(\d+)$", 1).try_cast("long").alias("step")
    found = paths.select(phase, step, path).where("step is not null")
    return found.groupBy(phase).agg(F.max("step").alias("step"), F.max_by(path, "step").alias(path))


def greatest_weights(weights: DataFrame, name: str, value: str, k: int = 20) -> DataFrame:
    """The k weights of greatest size: a top-k report."""
    return weights.orderBy(F.abs(value).desc(), name).limit(k)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x
