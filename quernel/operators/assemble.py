"""Whole builds and reports put together from smaller operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.keys import fraction
from quernel.functions.text import filled
from quernel.operators.build import factorial_mixtures, hash_capped
from quernel.operators.graph import kept
from quernel.operators.rank import ordinal, ranked
from quernel.operators.sample import group_holdout

# Small rules


def paper_group(identifier) -> Column:
    """The paper of a figure's id: what stands before `_<number>_figure_`, else before `_figure_`, else the id."""
    x = F.col(identifier) if isinstance(identifier, str) else identifier
    numbered = F.regexp_extract(x, r"^(.*)_\d+_figure_", 1)
    plain = F.substring_index(x, "_figure_", 1)
    return F.when(F.regexp_like(x, F.lit(r"^(.*)_\d+_figure_")), numbered).otherwise(plain)


#: The least labels and atoms of each difficulty; either will do, labels that are null never do.
LADDER = (("hard", 6, 45), ("medium_hard", 3, 25), ("medium", None, 12))


def ladder(labels, atoms, steps: Sequence[tuple[str, int | None, int]] = LADDER, lowest: str = "easy") -> Column:
    """The first step that one of two measures reaches; missing measures count as 0."""
    a, b = F.coalesce(_c(labels), F.lit(0)), F.coalesce(_c(atoms), F.lit(0))
    out = F.lit(lowest)
    for name, of_a, of_b in reversed(list(steps)):
        out = F.when((a >= of_a) | (b >= of_b) if of_a is not None else b >= of_b, F.lit(name)).otherwise(out)
    return out


#: What marks a reaction or several structures.
ARROWS, PLUSES, FIGURE = ("xrightarrow", "\\rightarrow", "->"), (" + ", "+ ", " +"), "\\chemfig"


def single_structure(text) -> Column:
    """Whether a text is likely of one structure: no arrow, no sum, at most one figure."""
    t = F.coalesce(_c(text), F.lit(""))
    found = F.lit(False)
    for mark in (*ARROWS, *PLUSES):
        found = found | F.contains(t, F.lit(mark))
    figures = (F.length(t) - F.length(F.replace(t, F.lit(FIGURE), F.lit("")))) / len(FIGURE)
    return ~found & (figures <= 1)


def run_specs(values: Sequence[str]) -> dict[str, str]:
    """NAME=PATH of runs, in their order; a name is neither empty nor given twice."""
    out: dict[str, str] = {}
    for value in values:
        name, mark, path = value.partition("=")
        name = name.strip()
        if not mark or not name or name in out:
            raise ValueError(f"a run is NAME=PATH with a name of its own, not {value}")
        out[name] = path
    return out


def message_record(image, prompt: str, answer, **meta: Column) -> Column:
    """A message row with what its answer tells: its length, whether it has a stereo mark; a relative image path opens with ./, a missing difficulty is unknown."""
    path = F.replace(_c(image), F.lit("\\"), F.lit("/"))
    path = F.when(F.startswith(path, F.lit("./")) | F.startswith(path, F.lit("http")), path).otherwise(F.concat(F.lit("./"), path))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    told = {"difficulty": F.lit("unknown"), "task_type": F.lit("molecule_structure_recognition")} | {k: v for k, v in meta.items() if k not in ("difficulty", "task_type")}
    told |= {k: F.coalesce(meta[k], told[k]) for k in ("difficulty", "task_type") if k in meta}
    told |= {"canonical_smiles_length": F.length(_c(answer)), "contains_stereo": F.contains(_c(answer), F.lit("@"))}
    return F.struct(F.array(turn("user", F.lit(f"<image>{prompt}")), turn("assistant", _c(answer))).alias("messages"), F.array(path).alias("images"), F.struct(*[c.alias(k) for k, c in told.items()]).alias("meta"))


def label_record(row: DataFrame, canonical: str, dataset: str, role: str, label: str = "label", image: str = "image") -> DataFrame:
    """Evaluation rows as labels: the nested truth overwritten by the canonical form, structure_id of it, the image below the data set, the role; rows without a canonical form go."""
    d = row.where(filled(canonical).isNotNull())
    key = F.substring(F.sha2(F.col(canonical).cast("binary"), 256), 1, 20)
    return d.withColumns({label: F.col(label).withField("smiles", F.col(canonical)), "structure_id": key, image: F.concat(F.lit(f"{dataset}/"), F.coalesce(image, F.lit(""))), "benchmark_role": F.lit(role)}).drop(canonical)


# Splits, merges, evaluations


def train_dev(samples: DataFrame, sample: str, share: float, seed: int) -> DataFrame:
    """samples with split, train or dev by a hash of the sample, and neither empty if it can be helped.

    With nothing in train the first sample is put there; with nothing in dev, and
    more than one sample, the last fifth of train (one at least) goes there. Two
    counts reach the driver; only a split that must be mended is put in order.
    """
    if share >= 1:
        return samples.withColumn("split", F.lit("train"))
    d = samples.withColumn("split", F.when(fraction(seed, sample) < share, "train").otherwise("dev"))
    n, n_train = d.agg(F.count(F.lit(1)), F.count_if(F.col("split") == "train")).first()
    if n == 0 or 0 < n_train < n:
        return d
    placed = ordinal(d, sample)
    if n_train == 0:
        return placed.withColumn("split", F.when(F.col("ord") == 0, "train").otherwise("dev")).drop("ord")
    moved = max(1, n // 5) if n > 1 else 0
    return placed.withColumn("split", F.when(F.col("ord") >= n - moved, "dev").otherwise("train")).drop("ord")


def merged_runs(runs: Mapping[str, DataFrame], labels: DataFrame | None, reference: str | None = None, unlabelled: bool = False, most: int = 0, sample: str = "id") -> DataFrame:
    """One row a sample with the candidates of all runs in order, and counts of them.

    runs: name to (id, prediction, candidates: an array of structs with prediction and canonical). The
    samples are the labelled ones, or all of any run if there are no labels or
    unlabelled ones are asked for. Of each run up to `most` candidates come (0:
    all). The selected prediction is the reference run's, else the first run's
    that has the sample; a sample that no run has keeps an empty pool.
    """
    order = list(runs)
    first = reference or order[0]
    every = None

    def named(run: str):
        return lambda c, k: F.struct(F.lit(run).alias("run"), (k + 1).alias("index"), c["prediction"].alias("prediction"), c["canonical"].alias("canonical"))

    for i, (name, df) in enumerate(runs.items()):
        some = F.slice("candidates", 1, most) if most > 0 else F.col("candidates")
        part = df.where(F.col(sample).isNotNull()).select(sample, F.lit(i).alias("run_index"), F.lit(name).alias("run"), "prediction", F.transform(some, named(name)).alias("c"))
        every = part if every is None else every.unionByName(part)
    lead = F.min_by("prediction", F.struct(F.col("run") != first, F.col("run_index")))
    pool = F.flatten(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("run_index", "c"))), lambda e: e["c"]), lambda c: c.isNotNull()))
    merged = every.groupBy(sample).agg(lead.alias("prediction"), pool.alias("candidates"), F.count(F.lit(1)).alias("n_runs"))
    if labels is not None:
        merged = labels.select(sample).distinct().join(merged, sample, "full_outer" if unlabelled else "left")
    distinct = F.size(F.array_distinct(F.filter(F.transform("candidates", lambda c: c["canonical"]), lambda k: k.isNotNull())))
    return merged.select(sample, F.coalesce("prediction", F.lit("")).alias("prediction"), "candidates", F.coalesce(F.size("candidates"), F.lit(0)).alias("n_candidates"), F.coalesce("n_runs", F.lit(0)).alias("n_runs"), F.coalesce(distinct, F.lit(0)).alias("n_keys"))


STATES = ("missing_prediction", "missing_target", "selected_exact", "light_exact", "oracle_exact", "oracle_nonisomeric", "recoverable_by_rerank", "missing_from_candidates")


def oracle_states(labels: DataFrame, aggregates: DataFrame, raw: DataFrame, picks: DataFrame, skeleton, sample: str = "id", key: str = "canonical") -> DataFrame:
    """What each labelled sample's candidates could have given: the states, and how many raw and distinct candidates it has.

    labels: sample, truth and the dimensions; raw: sample, n; picks: sample and
    the keys `selected` (null without a prediction) and `light`. skeleton(key)
    is what isomers share.
    """
    t = labels.withColumn("\x01skeleton", skeleton(F.col("truth")))
    hits = aggregates.join(t.select(sample, "truth", "\x01skeleton"), sample).groupBy(sample).agg(F.count(F.lit(1)).alias("unique"), F.max(F.col(key) == F.col("truth")).alias("o"), F.max(skeleton(F.col(key)) == F.col("\x01skeleton")).alias("i"))
    j = t.join(hits, sample, "left").join(raw.select(sample, F.col("n").alias("raw")), sample, "left")
    j = j.join(picks.select(sample, F.col("selected").alias("\x01s"), F.col("selected").isNotNull().alias("\x01there"), F.col("light").alias("\x01l")), sample, "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    both = F.col("truth").isNotNull() & yes(F.col("\x01there"))
    oracle, picked = both & yes(F.col("o")), both & yes(F.col("\x01s") == F.col("truth"))
    values = ~yes(F.col("\x01there")), F.col("truth").isNull(), picked, both & yes(F.col("\x01l") == F.col("truth")), oracle, both & yes(F.col("i")), oracle & ~picked, both & ~oracle
    n = lambda c: F.when(both, F.coalesce(F.col(c), F.lit(0))).otherwise(0)
    return j.select(*labels.columns, n("raw").alias("n_raw"), n("unique").alias("n_unique"), *[v.alias(s) for s, v in zip(STATES, values)])


def oracle_report(states: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, value, n, a rate of each state, means of candidates, both headrooms) over all samples and by every value of each dimension, in one pass."""
    named = states.withColumns({d: F.coalesce(F.col(d).cast("string"), F.lit("unknown" if d == "eval_panel" else "")) for d in dimensions})
    sets = named.groupingSets([[], *[[F.col(d)] for d in dimensions]], *[F.col(d) for d in dimensions])
    rate = lambda s: F.avg(F.col(s).cast("double"))
    out = sets.agg(
        F.count(F.lit(1)).alias("n"), *[F.round(rate(s), 9).alias(s) for s in STATES], F.round(F.avg("n_raw"), 9).alias("mean_raw"), F.round(F.avg("n_unique"), 9).alias("mean_unique"),
        F.round(rate("oracle_exact") - rate("selected_exact"), 9).alias("headroom_over_selected"), F.round(rate("oracle_exact") - rate("light_exact"), 9).alias("headroom_over_light"), *[F.grouping(d).alias(f"\x01{d}") for d in dimensions],
    )
    dimension, value = F.lit("all"), F.lit("")
    for d in dimensions:
        here = F.col(f"\x01{d}") == 0
        dimension, value = F.when(here, F.lit(d)).otherwise(dimension), F.when(here, F.col(d)).otherwise(value)
    return out.select(dimension.alias("dimension"), value.alias("value"), "n", *STATES, "mean_raw", "mean_unique", "headroom_over_selected", "headroom_over_light")


def against_baselines(policy: DataFrame, baselines: Mapping[str, DataFrame], truth: DataFrame, sample: str = "id", key: str = "canonical") -> DataFrame:
    """(baseline, n, policy_right, baseline_right, changed, good, bad) of a policy's choices against each baseline's."""
    t = truth.select(sample, "truth").join(policy.select(sample, F.col(key).alias("\x01p")), sample, "left")
    for name, df in baselines.items():
        t = t.join(df.select(sample, F.col(key).alias(f"\x01{name}")), sample, "left")
    return _against(t, baselines)


def picked_against(picks: DataFrame, policy: str, baselines: Sequence[str], truth: DataFrame, sample: str = "id") -> DataFrame:
    """As against_baselines, from one frame that holds each sample's choices as columns."""
    t = truth.select(sample, "truth").join(picks.select(sample, F.col(policy).alias("\x01p"), *[F.col(n).alias(f"\x01{n}") for n in baselines]), sample, "left")
    return _against(t, baselines)


def _against(t: DataFrame, baselines: Iterable[str]) -> DataFrame:
    each = t.select("truth", "\x01p", F.explode(F.array(*[F.struct(F.lit(n).alias("baseline"), F.col(f"\x01{n}").alias("b")) for n in baselines])).alias("e"))
    yes = lambda c: F.coalesce(c == F.col("truth"), F.lit(False))
    now, was, n = yes(F.col("\x01p")), yes(F.col("e.b")), lambda c: F.count_if(c)
    return each.groupBy("e.baseline").agg(F.count(F.lit(1)).alias("n"), n(now).alias("policy_right"), n(was).alias("baseline_right"), n(~F.col("\x01p").eqNullSafe(F.col("e.b"))).alias("changed"), n(now & ~was).alias("good"), n(was & ~now).alias("bad"))


def probe_winner(runs: DataFrame, dose: DataFrame, tolerance: float, margin: float) -> DataFrame:
    """One row: the winner of a 2 x 2 probe and what speaks for the second dose.

    runs: condition (00, 10, 01, 11), exact, valid; dose: exact, valid of one run,
    or no row. A condition counts if its least validity is within tolerance of
    00's; of these the greatest mean wins, the smaller condition where equal. The
    second dose wins over it if the second factor's main effect is positive, its
    validity holds and its score beats the winner's by more than the margin.
    """
    c = runs.groupBy("condition").agg(F.avg("exact").alias("exact"), F.min("valid").alias("valid"), (F.max("exact") - F.min("exact")).alias("range"))
    mean = lambda k: F.max(F.when(F.col("condition") == k, F.col("exact")))
    effects = c.agg(
        (F.max(F.when(F.col("condition") == "00", F.col("valid"))) - tolerance).alias("floor"), ((mean("10") + mean("11") - mean("00") - mean("01")) / 2).alias("effect_first"),
        ((mean("01") + mean("11") - mean("00") - mean("10")) / 2).alias("effect_second"), (mean("11") - mean("10") - mean("01") + mean("00")).alias("interaction"),
    )
    both = c.join(effects).where(F.col("valid") >= F.col("floor"))  # one row of effects
    core = both.agg(F.max_by(F.struct("condition", "exact", "range", "valid", "floor", "effect_first", "effect_second", "interaction"), F.struct("exact", -F.col("condition").cast("int"))).alias("w")).select("w.*")
    d = core.join(dose.select(F.col("exact").alias("dose_exact"), F.col("valid").alias("dose_valid")), F.lit(True), "left")
    beats = F.coalesce((F.col("effect_second") > 0) & (F.col("dose_valid") >= F.col("floor")) & (F.col("dose_exact") > F.col("exact") + margin), F.lit(False))
    r = lambda x: F.round(x, 9)
    return d.select(
        F.col("condition").alias("core_winner"), F.when(beats, "dose2").otherwise(F.col("condition")).alias("winner"), r(F.when(beats, F.col("dose_exact")).otherwise(F.col("exact"))).alias("exact"), r(F.when(beats, None).otherwise(F.col("range"))).alias("seed_range"),
        r(F.when(beats, F.col("dose_valid")).otherwise(F.col("valid"))).alias("min_valid"), r("floor").alias("validity_floor"), r("effect_first").alias("effect_first"), r("effect_second").alias("effect_second"), r("interaction").alias("interaction"),
    )


def first_by_label(parts: Mapping[str, DataFrame], label: str, at: str) -> tuple[DataFrame, DataFrame]:
    """The union of parts in their order with `domain`, of equal labels the first row; and how many rows of each domain came and went. Rows without a label go uncounted."""
    every = None
    for i, (name, df) in enumerate(parts.items()):
        p = df.withColumn("domain", F.lit(name)).withColumn("\x01part", F.lit(i))
        every = p if every is None else every.unionByName(p, allowMissingColumns=True)
    known = ranked(every.where(filled(label).isNotNull()), label, [F.col("\x01part"), F.col(at)], "\x01n")
    stats = known.groupBy("domain").agg(F.count_if(F.col("\x01n") == 1).alias("n_kept"), F.count_if(F.col("\x01n") > 1).alias("n_repeated"))
    return known.where("`\x01n` = 1").drop("\x01n", "\x01part"), stats


#: The decisions and reasons that a review may give.
DECISIONS = ("pending", "pass", "reject", "uncertain")
REASONS = ("ok", "label_mismatch", "multi_target", "bad_crop", "unreadable", "leakage", "source_unknown", "other")


def adjudicated(items: DataFrame, decisions: DataFrame, roles: Sequence[str], key: str = "id", adjudicator: str = "adjudicator") -> DataFrame:
    """Each item with its reviewers' decisions, the final one, and its status.

    decisions: key, role, reviewer, decision, reason, at; a role's latest stands.
    The query fails on a decision or reason that isn't known, or one without a
    reviewer. The adjudicator's decision is final unless it is pending; without
    one, equal decisions of all reviewers are, if not pending. Status:
    adjudicated, agreed, disagreed or pending.
    """
    bad = F.when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), F.lit("unknown decision of ")).when(F.coalesce(F.col("reason"), F.lit("")).isin(*REASONS, "") == F.lit(False), F.lit("unknown reason of ")).when(filled("reviewer").isNull(), F.lit("no reviewer of "))
    sound = F.when(bad.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(bad, F.col(key).cast("string"))).cast("boolean"))
    last = F.max_by("decision", F.struct("at", "decision"))
    per = decisions.where(sound).groupBy(key).pivot("role", [*roles, adjudicator]).agg(last)
    j = items.join(per, key, "left").na.fill("pending", [*roles, adjudicator])
    same, done = F.lit(True), F.col(roles[0]) != "pending"
    for r in roles[1:]:
        same, done = same & (F.col(r) == F.col(roles[0])), done & (F.col(r) != "pending")
    by = F.col(adjudicator) != "pending"
    status = F.when(by, "adjudicated").when(done & same, "agreed").when(done, "disagreed").otherwise("pending")
    return j.withColumn("final", F.when(by, F.col(adjudicator)).when(done & same, F.col(roles[0])).otherwise("pending")).withColumn("status", status)


def evidence(required: Mapping[str, DataFrame], optional: Mapping[str, DataFrame | None]) -> DataFrame:
    """One row with a JSON column for each part of a final report, null for an optional part that isn't there, and the names of those.

    Each part is a frame of one row; a required part without a row, or any part
    of several, fails the query.
    """
    spark = next(iter(required.values())).sparkSession
    out, absent = spark.range(1).select(F.lit(1).alias("\x01one")), []
    for name, df in {**required, **optional}.items():
        if df is None:
            part = spark.createDataFrame([], f"`{name}` string")
        else:
            part = df.select(F.to_json(F.struct(*df.columns)).alias(name))
        n = F.count(F.lit(1))
        wrong = (n != 1) if name in required else (n > 1)
        one = part.agg(F.when(wrong, F.raise_error(F.lit(f"{name} must have one row")).cast("string")).otherwise(F.max(name)).alias(name))
        out = out.join(one)  # one row
        absent.append(F.when(F.col(name).isNull(), F.lit(name)))
    return out.select(*required, *optional, F.array_compact(F.array(*absent)).alias("absent"))


# One build of data sets


def dataset_build(base: DataFrame, wild: DataFrame, dev: DataFrame, variants: DataFrame, recipes: Mapping[str, tuple[Sequence[str], int]], replay: tuple[str, Column, int, int], target: int, per_group: int, least_groups: int, train_cap: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All outputs of one build, the manifest of its split, and its report.

    base, variants (with `piece`): row, target; wild: row, id, target; dev:
    target. Wild rows are grouped by paper; those without a target are symbolic,
    those with a development target go. Papers are held out as `group_holdout`
    does; their symbolic rows are evaluated too, apart. Base rows and variants
    with a target that is held out go, so no target is on both sides. Mixtures
    follow the recipes over base, wild and the variants, and `replay` names the
    mixture, what is hard in it, the rows and the seed of a replay set.
    """
    papers = wild.withColumn("paper", paper_group("id"))
    strict = papers.where(filled("target").isNotNull())
    free = strict.join(dev.select("target").distinct(), "target", "left_anti")
    split = kept(group_holdout(free.select("row", "paper", "target"), "paper", "target", target, per_group, least_groups, seed))
    locked = split.where("split = 'locked'")
    held = kept(dev.select("target").unionByName(locked.select("target")).where("target is not null").distinct())
    taken = locked.select("paper").distinct()
    symbolic = papers.where(filled("target").isNull()).join(taken, "paper", "left_semi")
    train = hash_capped(split.where("split = 'train'"), train_cap, seed, "row").select("row", "target", F.lit("wild").alias("piece"))
    clean = lambda df: df.where(filled("target").isNotNull()).join(held, "target", "left_anti")
    pieces = clean(base).select("row", "target", F.lit("base").alias("piece")).unionByName(train).unionByName(clean(variants).select("row", "target", "piece"))
    mixed = kept(factorial_mixtures(pieces, "piece", recipes, "row"))
    name, hard, n, replay_seed = replay
    again = hash_capped(mixed.where((F.col("mixture") == name) & hard).drop("order_key"), n, replay_seed, "row")
    side = lambda df, output: df.select(F.lit(output).alias("output"), "row", "target", F.lit("wild").alias("piece"), F.lit(None).cast("string").alias("order_key"))
    outputs = mixed.select(F.col("mixture").alias("output"), "row", "target", "piece", "order_key").unionByName(again.select(F.lit("hard_replay").alias("output"), "row", "target", "piece", "order_key"))
    outputs = outputs.unionByName(side(locked, "strict_eval")).unionByName(side(symbolic, "symbolic_eval"))
    place = F.when(F.col("split") == "locked", "locked_eval").when(F.col("split") == "train", "train").otherwise("held_back")
    manifest = split.select("row", "paper", "target", place.alias("split"))
    count = lambda what, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    report = outputs.groupBy(F.col("output").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    for what, df in (("symbolic_or_invalid", papers.where(filled("target").isNull())), ("dev_overlap", strict.join(dev.select("target").distinct(), "target", "left_semi")), ("base_heldout", base.join(held, "target", "left_semi")), ("papers_locked", taken)):
        report = report.unionByName(count(what, df))
    return outputs, manifest, report


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x
