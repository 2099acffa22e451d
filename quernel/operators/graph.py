"""Components of links between rows, and what they are for: entities that must not be torn apart."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df computed once and read back from a table in the folder of spark.checkpoint.dir, which all executors must share; on one machine a temporary one will do."""
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quernel-")
        spark.conf.set("spark.checkpoint.dir", path)
    folder = f"{path.rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of links (a, b), two longs; a component is named by its least node.

    Each round hangs every node's greater neighbours, and then every node and
    its lesser neighbours, below the least of them, until a count and a checksum
    stay as they are. Only these two numbers reach the driver.
    """
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # greater neighbours below the least one
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # a node and its lesser neighbours below the least one
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        hung = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = kept(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        before = now


def entity_closure(rows: DataFrame, row: str, keys: Sequence[str], to: str = "closure") -> DataFrame:
    """rows with the least row number of all rows that are joined to them by equal keys of a kind, over any number of steps.

    `row` numbers the rows, each once. A null or empty key joins nothing. Every
    row of a key is linked with the key's least row, so a key that many rows
    share costs one link a row.
    """
    each = rows.select(F.col(row).cast("long").alias("a"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys])).alias("k")).select("a", "k.*")
    each = each.where(F.col("value").isNotNull() & (F.col("value") != ""))
    hubs = each.groupBy("kind", "value").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = components(each.join(hubs, ["kind", "value"]).select("a", "b").where("a <> b"))
    j = rows.join(found.select(F.col("node").alias(row), F.col("component").alias("\x01c")), row, "left")
    return j.select(*rows.columns, F.coalesce("\x01c", F.col(row).cast("long")).alias(to))


def dependency_conflicts(df: DataFrame, left: str, right: str, witness: str) -> DataFrame:
    """Where `left` doesn't settle `right`: left, how many values, the two least values, and the least witness of each. Nulls on the right are a value."""
    cells = df.where(F.col(left).isNotNull()).groupBy(left, right).agg(F.min(witness).alias("w"))
    found = cells.groupBy(left).agg(F.count(F.lit(1)).alias("n_values"), F.min(F.struct(F.col(right).isNull().alias("missing"), F.col(right).alias("v"), "w")).alias("one"), F.max(F.struct(F.col(right).isNull().alias("missing"), F.col(right).alias("v"), "w")).alias("other")).where("n_values > 1")
    return found.select(left, "n_values", F.col("one.v").alias("value"), F.col("one.w").alias("witness"), F.col("other.v").alias("other_value"), F.col("other.w").alias("other_witness"))


def torn_entities(df: DataFrame, closure: str, split: str, witness: str) -> DataFrame:
    """Entities that are in several splits: closure, the splits sorted, and the least witness in each."""
    cells = df.groupBy(closure, split).agg(F.min(witness).alias("w"))
    found = cells.groupBy(closure).agg(F.sort_array(F.collect_list(F.struct(F.col(split).alias("split"), "w"))).alias("\x01s")).where(F.size("\x01s") > 1)
    return found.select(closure, F.col("\x01s.split").alias("splits"), F.col("\x01s.w").alias("witnesses"))


def checked_splits(rows: DataFrame, row: str, keys: Sequence[str], requested: str, proposed: Column) -> DataFrame:
    """rows with closure and split: the requested split of a row, or else `proposed`, a column of the closure; the query fails if an entity is then torn apart."""
    d = entity_closure(rows, row, keys)
    d = d.withColumn("split", F.coalesce(F.nullif(F.lower(F.trim(requested)), F.lit("")), proposed))
    sides = d.groupBy("closure").agg(F.min("split").alias("\x01least"), F.max("split").alias("\x01most"))
    j = d.join(sides, "closure")
    sound = F.when(F.col("\x01least") == F.col("\x01most"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("entity of row "), F.col("closure").cast("string"), F.lit(" is in several splits"))).cast("boolean"))
    return j.where(sound).select(*rows.columns, "closure", "split")
