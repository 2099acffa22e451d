"""One export of labelled records to training, validation and evaluation, in which no entity is in two outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quernel.functions.keys import hash_order
from quernel.operators.graph import entity_closure, kept
from quernel.operators.rank import spread_rank

#: The outputs; held and skipped rows go nowhere, with a reason.
OUTPUTS = ("train", "val", "competition_eval", "auxiliary_eval", "held", "skipped")


@dataclass(frozen=True)
class Repeats:
    """How often rows of training come: those of real_world, long keys, keys with a stereo mark; at least as their hint says."""

    real_world: int = 1
    long_key: int = 1
    stereo: int = 1
    long_from: int = 80

    def times(self, source: str, key: str, hint: str) -> Column:
        by = lambda condition, n: F.when(condition, F.lit(n)).otherwise(1)
        return F.greatest(
            F.lit(1), F.coalesce(F.col(hint), F.lit(1)), by(F.col(source) == "real_world", self.real_world), by(F.length(key) >= self.long_from, self.long_key), by(F.contains(key, F.lit("@")), self.stereo)
        )


def validation_count(n: Column, share: float) -> Column:
    """How many of n units are for validation: of up to ten one if there are five, else the share, rounded half to even, one at least."""
    return F.when(n <= 10, (n >= 5).cast("long")).otherwise(F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("long")))


def planned(records: DataFrame, share: float, seed: int) -> DataFrame:
    """records with closure, output and reason.

    records: row (a number, each once), origin (public, manifest or eval), id,
    image, key, source, split (of manifest rows: train, val or test; anything
    else is train) and `problem`, which is null for sound records. Unsound
    records are skipped and join nothing. Records are joined to entities by id,
    image and key. Evaluation records and test rows of manifests are evaluated;
    whatever else belongs to an entity of theirs is held. Of the other entities
    those with a row that a manifest puts into val are validation, those with
    one that it puts into train training, and of those with public records alone
    a share of each source (that of their first record), in hash order.
    """
    split = F.when(F.lower(F.trim("split")).isin("train", "val", "test"), F.lower(F.trim("split"))).otherwise("train")
    sound = F.col("problem").isNull()
    d = records.withColumn("\x01split", split)
    d = d.withColumn("\x01eval", F.when(F.col("origin") == "eval", "competition_eval").when((F.col("origin") == "manifest") & (F.col("\x01split") == "test"), "auxiliary_eval"))
    closed = kept(entity_closure(d.where(sound), "row", ["id", "image", "key"]))
    manifest = lambda s: F.max((F.col("origin") == "manifest") & (F.col("\x01split") == s))
    units = closed.groupBy("closure").agg(F.max(F.col("\x01eval").isNotNull()).alias("e"), manifest("val").alias("v"), manifest("train").alias("t"), F.min_by("source", "row").alias("\x01source"))
    free = spread_rank(units.where(~(F.col("e") | F.col("v") | F.col("t"))), "\x01source", hash_order(seed, "closure"), F.col("closure"), "\x01place", "\x01n")
    drawn = free.select("closure", F.when(F.col("\x01place") <= validation_count(F.col("\x01n"), share), "val").otherwise("train").alias("to"))
    settled = units.where(F.col("e") | F.col("v") | F.col("t")).select("closure", F.when(F.col("e"), "held").when(F.col("v"), "val").otherwise("train").alias("to"))
    out = closed.join(drawn.unionByName(settled), "closure").withColumn("output", F.coalesce("\x01eval", "to"))
    out = out.withColumn("reason", F.when(F.col("output") == "held", "entity_is_evaluated")).select(*records.columns, "closure", "output", "reason")
    return out.unionByName(records.where(~sound).withColumns({"closure": F.lit(None).cast("long"), "output": F.lit("skipped"), "reason": F.col("problem")}))


def expanded(plan: DataFrame, repeats: Repeats) -> DataFrame:
    """The plan with training rows repeated: repeat_group and repeat_index, and an id for each copy; other rows stay."""
    times = F.when(F.col("output") == "train", repeats.times("source", "key", "repeat_hint")).otherwise(1)
    d = plan.withColumn("\x01t", times).withColumn("repeat_index", F.explode(F.sequence(F.lit(0), F.col("\x01t") - 1)))
    many = F.col("\x01t") > 1
    copy = F.concat(F.col("id"), F.lit("__rep"), F.col("repeat_index").cast("string"))
    d = d.withColumn("repeat_group", F.when(many, F.col("id"))).withColumn("id", F.when(many, copy).otherwise(F.col("id")))
    return d.withColumn("repeat_index", F.when(many, F.col("repeat_index"))).drop("\x01t")


def masked_record(image: Column, prompt: Column, answer: Column) -> Column:
    """A training row whose prompt is masked: image_info and text_info."""
    part = lambda text, tag: F.struct(text.alias("text"), F.lit(tag).alias("tag"))
    return F.struct(F.array(F.struct(F.lit(0).alias("matched_text_index"), image.alias("image_url"))).alias("image_info"), F.array(part(prompt, "mask"), part(answer, "no_mask")).alias("text_info"))


def write_export(rows: DataFrame, path: str, prompt: str) -> dict[str, int]:
    """All outputs in one pass: JSON lines in a folder each, and the rows of each as counted while they were written."""
    seen = Observation()
    record = masked_record(F.col("image"), F.lit(prompt), F.col("key"))
    ready = rows.select("output", "id", "source", "image", "key", "reason", F.when(F.col("output").isin("train", "val"), record).alias("record"))
    counted = ready.observe(seen, *[F.count_if(F.col("output") == o).alias(o) for o in OUTPUTS])
    counted.write.mode("overwrite").partitionBy("output").json(path)
    return dict(seen.get)


def export_report(rows: DataFrame) -> DataFrame:
    """(output, source, reason, n, n_entities) of an export, as its summary has them."""
    return rows.groupBy("output", "source", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("closure").alias("n_entities"))
