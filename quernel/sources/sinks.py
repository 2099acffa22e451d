"""Writers: JSON lines, CSV, reports, appends and rewrites that can be run again."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.sources.readers import there
from quernel.sources.versions import VersionedTable


def write_jsonl(df: DataFrame, path: str) -> int:
    """Rows as JSON lines; the number of rows, counted while they are written."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def write_csv(df: DataFrame, path: str, columns: Sequence[str], bom: bool = True) -> None:
    """The named columns with a header, which a byte-order mark opens; quotes within a field are doubled."""
    out = df.select(*columns)
    if bom:
        out = out.withColumnRenamed(columns[0], "﻿" + columns[0])
    out.write.mode("overwrite").csv(path, header=True, escape='"')


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str] | None = None) -> DataFrame:
    """Counts of row x column, columns sorted, 0 where there is none."""
    return df.groupBy(row).pivot(column, list(values) if values else None).agg(F.count(F.lit(1))).na.fill(0)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """A folder for each bucket; rows are dealt by the buckets and a hash, so a hot bucket has several files."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(8))
    df.repartition(*by, salt).write.mode("overwrite").partitionBy(*by).parquet(path)


def small(df: DataFrame, most_rows: int) -> list:
    """The rows of a report on the driver; an error if there are more than most_rows."""
    rows = df.take(most_rows + 1)
    if len(rows) > most_rows:
        raise ValueError(f"a report of more than {most_rows} rows belongs in a file")
    return rows


def json_report(df: DataFrame, most_rows: int = 10_000) -> str:
    """The rows of a small report as a JSON list."""
    return json.dumps([r.asDict(recursive=True) for r in small(df, most_rows)], default=str, ensure_ascii=False, indent=1)


def markdown(df: DataFrame, most_rows: int = 10_000) -> str:
    """The rows of a small report as a Markdown table."""
    head = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join(head + [f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in small(df, most_rows)])


def new_rows(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose id isn't there, each id once."""
    from quernel.operators.rank import best

    once = best(incoming.withColumn("\x01o", F.xxhash64(*incoming.columns)), key, [F.col("\x01o")]).drop("\x01o")
    return once.join(existing.select(key), key, "left_anti").select(*incoming.columns)


def append_new(spark: SparkSession, incoming: DataFrame, path: str, key: str) -> None:
    """Insert-only merge into a Parquet folder; running it again adds nothing."""
    seen = spark.read.parquet(path) if there(spark, path) else spark.createDataFrame([], incoming.schema)
    rows = new_rows(seen, incoming, key)
    rows.write.mode("append").parquet(path)


def without_bad(table: VersionedTable, bad: DataFrame, keys: Sequence[str], dry_run: bool = False) -> Mapping[str, int]:
    """The next version of a table, without the rows that `bad` names; rows before, removed and after. Nulls in the keys match nothing."""
    version = table.current()
    rows = table.read(version)
    kept = rows.join(bad.select(*keys).distinct(), list(keys), "left_anti").select(*rows.columns)
    before, after = rows.count(), kept.count()
    if not dry_run and after < before:
        table.write(kept, version)
    return {"before": before, "removed": before - after, "after": after}


def upserted(rows: DataFrame, updates: DataFrame, key: str, columns: Sequence[str], order: Column | None = None) -> DataFrame:
    """Rows with columns replaced by what the last update of the same key has that isn't null.

    Of several updates of a key the last by `order` stands, equal ones and
    those without an order by the values themselves; an update of a key that no
    row has does nothing.
    """
    from quernel.operators.rank import best

    values = [F.col(c).desc_nulls_last() for c in columns]
    u = best(updates, key, [order.desc_nulls_last(), *values] if order is not None else values).select(key, *[F.col(c).alias(f"\x01{c}") for c in columns])
    j = rows.join(u, key, "left")
    return j.select(*[F.coalesce(F.col(f"\x01{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def decided(decisions: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Decisions (key, role, decision, at) with updates put in: a role's latest decision on an item stands, an update where times are equal."""
    both = decisions.withColumn("\x01new", F.lit(0)).unionByName(updates.withColumn("\x01new", F.lit(1)))
    last = both.groupBy(key, "role").agg(F.max_by(F.struct("decision", "at"), F.struct("at", "\x01new", "decision")).alias("\x01d"))
    return last.select(key, "role", "\x01d.*").select(*decisions.columns)


def review_sheet(rows: DataFrame, decisions: DataFrame, key: str, roles: Sequence[str]) -> DataFrame:
    """A row for each item with each role's decision, `pending` if it has none, and whether all roles agree."""
    per = decisions.groupBy(key).pivot("role", list(roles)).agg(F.max_by("decision", "at"))
    j = rows.join(per, key, "left").na.fill("pending", list(roles))
    agree: Column = F.lit(True)
    for r in roles[1:]:
        agree = agree & (F.col(r) == F.col(roles[0]))
    return j.withColumn("agreed", agree & (F.col(roles[0]) != "pending"))
