"""Quality control of evaluation panels: rules, warnings, overlap with training, a manifest and its summary."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.keys import short_sha1

#: What a label may hold, what it may not, and what decides the reason of an accepted review.
LABEL_LETTERS = r"^[A-Za-z0-9\[\]()@+\-=#$:/\\.%,*]+$"
LABEL_BLOCKED = ("\\chemfig", "ssml", "\\xrightarrow", "\\rightarrow")
REGION_TASKS = ("document_embed", "journal_fig", "multi_grid", "page_level")
LEAST_SIDE = 96
RULES = (
    "id_present", "unique_id_within_panel", "image_path_resolved", "image_openable", "label_nonempty", "label_looks_like_smiles", "eval_target_is_canonical_smiles", "source_present",
    "difficulty_present", "qc_status_pass_in_label", "no_train_id_overlap", "no_train_image_name_overlap", "no_train_smiles_overlap",
)
WARNINGS = ("duplicate_smiles_within_panel", "min_side_under_96")


def likely_label(label: Column) -> Column:
    """Whether a text may be a label: not empty, its letters all allowed, none of the blocked words in it."""
    out = F.regexp_like(label, F.lit(LABEL_LETTERS))
    for word in LABEL_BLOCKED:
        out = out & ~F.contains(label, F.lit(word))
    return F.coalesce(out, F.lit(False))


def overlaps(rows: DataFrame, row: str, kinds: Mapping[str, str], index: DataFrame, bits: int = 1 << 22) -> DataFrame:
    """rows with a flag for each kind of key: whether the index (kind, value) has the row's value of that kind.

    All kinds go through one join. Before it, values that a bitmap of the
    index's hashes rules out are dropped where they arise: of `bits` bits, sent
    to every task as rows of 4 KiB, so its size doesn't depend on the index. A
    null value is in no index.
    """
    flag = lambda k: f"in_{k}"
    place = F.pmod(F.xxhash64("kind", "value"), F.lit(bits)) + 1
    index = index.where("value is not null").select("kind", F.col("value").cast("string").alias("value"))
    marks = index.groupBy(F.bitmap_bucket_number(place).alias("\x01bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("\x01bits"))
    each = rows.select(row, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in kinds.items()])).alias("k")).select(row, "k.*").where("value is not null")
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substr("\x01bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    likely = each.withColumn("\x01bucket", F.bitmap_bucket_number(place)).join(F.broadcast(marks), "\x01bucket").where(F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(bit, F.lit(8)).cast("double"))), F.lit(2)) == 1)
    hits = likely.select(row, "kind", "value").join(index.distinct(), ["kind", "value"], "left_semi")
    found = hits.groupBy(row).agg(*[F.max(F.col("kind") == k).alias(flag(k)) for k in kinds])
    j = rows.join(found, row, "left")
    return j.select(*rows.columns, *[F.coalesce(flag(k), F.lit(False)).alias(flag(k)) for k in kinds])


def manifest(rows: DataFrame, index: DataFrame) -> DataFrame:
    """The 13 rules and two warnings of each row of the panels, and what follows from them.

    rows: row (a number, each once), panel, id, label, image, image_name,
    resolved, openable, width, height, eval_target, source, difficulty,
    task_type and qc_status. index: kind (id, image_name or label) and value, of
    what is trained on. A missing id or label is the empty text.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    d = rows.withColumn("id", text("id")).withColumn("label", F.trim(text("label")))
    ids = d.groupBy("panel", "id").agg(F.count(F.lit(1)).alias("\x01ids"))
    labels = d.groupBy("panel", "label").agg(F.count(F.lit(1)).alias("\x01labels"))
    d = overlaps(d, "row", {"id": "id", "image_name": "image_name", "label": "label"}, index).join(ids, ["panel", "id"]).join(labels, ["panel", "label"])
    there = lambda c: text(c) != ""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    checks = (
        there("id"), F.col("\x01ids") == 1, yes("resolved"), yes("resolved") & yes("openable"), there("label"), likely_label(F.col("label")), text("eval_target") == "canonical_smiles", there("source"), there("difficulty"),
        text("qc_status") == "pass", ~F.col("in_id"), ~F.col("in_image_name"), ~F.col("in_label"),
    )
    side = F.least("width", "height")
    warned = F.col("\x01labels") > 1, F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & (side < LEAST_SIDE), F.lit(False))
    d = d.withColumns(dict(zip(RULES, checks)) | dict(zip(WARNINGS, warned)))
    every = F.lit(True)
    for r in RULES:
        every = every & F.col(r)
    task, difficulty = text("task_type"), text("difficulty")
    accepted = F.when(task.isin(*REGION_TASKS), "region_target_clear_enough_for_eval").when(F.contains(text("source"), F.lit("edu")) | (difficulty == "chinese_exam"), "edu_single_molecule_case_accepted")
    accepted = accepted.when(F.contains(difficulty, F.lit("photo")) | F.contains(difficulty, F.lit("scan")), "visual_degradation_accepted").otherwise("single_target_image_label_accepted")
    d = d.withColumn("rule_status", F.when(every, "pass").otherwise("fail"))
    passed = F.col("rule_status") == "pass"
    return d.select(
        "row", "panel", F.concat("panel", F.lit("::"), "id").alias("panel_sample_id"), "id", "source", "difficulty", "task_type", "image", "width", "height", "label", short_sha1("label").alias("label_hash"), *RULES, *WARNINGS, "rule_status",
        F.when(passed, "pass").otherwise("needs_review").alias("human_review_status"), F.when(passed, accepted).otherwise("rule_failed_needs_manual_check").alias("human_review_reason"), F.col("rule_status").alias("qc_status"),
    )


def panel_summary(made: DataFrame) -> DataFrame:
    """One row a panel: rows, passes and fails, distinct ids and labels and their surplus, and the range of image sizes, of images that have one."""
    n = lambda c: F.sum(c.cast("long"))
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    return made.groupBy("panel").agg(
        F.count(F.lit(1)).alias("n"), n(F.col("rule_status") == "pass").alias("passed"), n(F.col("rule_status") != "pass").alias("failed"), F.count_distinct("id").alias("unique_ids"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("duplicate_ids"),
        F.count_distinct("label_hash").alias("unique_labels"), (F.count(F.lit(1)) - F.count_distinct("label_hash")).alias("duplicate_labels"),
        *[f(F.when(sized, F.col(c))).alias(f"{name}_{c}") for name, f in (("min", F.min), ("max", F.max)) for c in ("width", "height")],
    )


def panel_reasons(made: DataFrame) -> DataFrame:
    """(panel, reason, n): failed rules and warnings of each panel, where there are any."""
    sums = made.groupBy("panel").agg(*[F.count_if(~F.col(r)).alias(r) for r in RULES], *[F.count_if(w).alias(w) for w in WARNINGS])
    return sums.unpivot(["panel"], [*RULES, *WARNINGS], "reason", "n").where("n > 0")
