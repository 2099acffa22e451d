"""Projections and filters: reshaping, bins, buckets, rules and reasons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.text import filled, trimmed


def coalesced(*columns) -> Column:
    """The first column with text."""
    return F.coalesce(*[filled(c) for c in columns])


def first_filled(columns: Sequence[str]) -> Column:
    """struct(text, field) of the first column with text."""
    out = F.lit(None).cast("struct<text:string,field:string>")
    for c in reversed(columns):
        out = F.when(filled(c).isNotNull(), F.struct(filled(c).alias("text"), F.lit(c).alias("field"))).otherwise(out)
    return out


def message_of(df: DataFrame, key: str, order: str, role: str = "assistant", last: bool = True, role_column: str = "role", text_column: str = "text") -> DataFrame:
    """The last (or first) message of a role in each conversation, trimmed."""
    pick = F.max_by if last else F.min_by
    own = df.where(F.col(role_column) == role)
    return own.groupBy(key).agg(pick(F.struct(trimmed(text_column).alias("text"), F.col(order).alias("at")), F.struct(order, text_column)).alias("m")).select(key, F.col("m.at").alias("turn"), F.col("m.text").alias("text"))


def binned(x, edges: Sequence[float], names: Sequence[str]) -> Column:
    """The name of the first edge that x doesn't exceed; the last name beyond all."""
    x = F.col(x) if isinstance(x, str) else x
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names))):
        out = F.when(x <= edge, F.lit(name)).otherwise(out)
    return F.when(x.isNotNull(), out)


def bucketed(rules: Sequence[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds; null, so dropped, if none does."""
    out = F.lit(None).cast("string")
    for rule, name in reversed(list(rules)):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return out


def multi_bucketed(df: DataFrame, rules: Sequence[tuple[Column, str]], to: str = "bucket") -> DataFrame:
    """A row for each rule that holds."""
    return df.withColumn(to, F.explode(F.array_compact(F.array(*[F.when(r, F.lit(n)) for r, n in rules]))))


def with_reason(df: DataFrame, rules: Sequence[tuple[Column, str]], to: str = "reason") -> DataFrame:
    """The first failing rule of each row, or `accepted`."""
    return df.withColumn(to, F.coalesce(bucketed(rules), F.lit("accepted")))


def accepted(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    return with_reason(df, rules, "\x01reason").where(F.col("\x01reason") == "accepted").drop("\x01reason")


def rule_matrix(df: DataFrame, rules: Mapping[str, Column], warnings: Mapping[str, Column] | None = None) -> DataFrame:
    """df with a column for each rule and warning, and rule_status: pass if all rules hold."""
    flags = {n: F.coalesce(c, F.lit(False)) for n, c in {**rules, **(warnings or {})}.items()}
    out = df.withColumns(flags)
    every = F.lit(True)
    for n in rules:
        every = every & F.col(n)
    return out.withColumn("rule_status", F.when(every, "pass").otherwise("fail"))


def failures_by_rule(checked: DataFrame, rules: Sequence[str]) -> DataFrame:
    """rule, n_failed: the failing rows of each rule, from one pass over a rule matrix."""
    sums = checked.agg(*[F.sum((~F.col(r)).cast("long")).alias(r) for r in rules])
    return sums.unpivot([], list(rules), "rule", "n_failed")


def renamed_source(x, names: Mapping[str, str]) -> Column:
    """A source by its new name; one that isn't in the map keeps its own."""
    x = F.col(x) if isinstance(x, str) else x
    pairs = [F.lit(v) for kv in names.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), x), x)


def composite(*columns) -> Column:
    """a|b of several columns, `unknown` for what is missing."""
    return F.concat_ws("|", *[F.coalesce(filled(F.col(c).cast("string")), F.lit("unknown")) for c in columns])


def as_messages(prompt: Column, answer: Column, image: Column, **meta: Column) -> Column:
    """A training row: images, messages and meta."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.struct(F.array(image).alias("images"), F.array(turn("user", prompt), turn("assistant", answer)).alias("messages"), F.struct(*[c.alias(n) for n, c in meta.items()]).alias("meta"))


def parsed_box(x) -> Column:
    """Four numbers from a JSON list or comma list; null unless x2 > x1 and y2 > y1."""
    x = F.col(x) if isinstance(x, str) else x
    parts = F.transform(F.split(F.regexp_replace(x, r"[\[\]\s]", ""), ","), lambda s: s.try_cast("double"))
    good = (F.size(parts) == 4) & F.forall(parts, lambda v: v.isNotNull())
    return F.when(good & (F.try_element_at(parts, F.lit(3)) > F.try_element_at(parts, F.lit(1))) & (F.try_element_at(parts, F.lit(4)) > F.try_element_at(parts, F.lit(2))), parts)


#: Image modes that harm inference, by name and by how they begin; RGB alone is sound, all others want a look.
DELETED_MODES, DELETED_PREFIXES = ("P", "PA", "1", "I", "F"), ("I;16",)


def image_mode_class(mode) -> Column:
    """ok for RGB, default_delete for palettes, bits and other depths, review for all else, a missing mode too."""
    mode = F.coalesce(trimmed(mode), F.lit(""))
    bad = mode.isin(*DELETED_MODES)
    for p in DELETED_PREFIXES:
        bad = bad | F.startswith(mode, F.lit(p))
    return F.when(mode == "RGB", "ok").when(bad, "default_delete").otherwise("review")


def unwanted_images(rows: DataFrame, modes: DataFrame, image: str, path: str = "path", mode: str = "mode") -> tuple[DataFrame, DataFrame]:
    """Rows without those whose image is to be deleted, and the plan: each image that goes, its class, and how many rows name it.

    An image of rows that `modes` doesn't know is missing and goes too; the plan
    is what an anti join takes off the rows.
    """
    known = modes.select(F.col(path).alias(image), image_mode_class(mode).alias("\x01class")).groupBy(image).agg(F.max(F.struct(F.col("\x01class") == "default_delete", "\x01class")).getField("\x01class").alias("\x01class"))
    named = rows.groupBy(image).agg(F.count(F.lit(1)).alias("n_rows")).join(known, image, "left")
    plan = named.select(image, F.coalesce("\x01class", F.lit("missing")).alias("action"), "n_rows").where(F.col("action").isin("missing", "default_delete"))
    return rows.join(plan.select(image), image, "left_anti").where(F.col(image).isNotNull()).select(*rows.columns), plan
