"""Tables written and read again: numbered scans, versions, layered upserts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.plans.base import Tables, query
from quernel.plans.selection import _stream_folder
from quernel.sources import readers, sinks
from quernel.sources.versions import VersionedTable

#: Documents that one task sorts and writes to one file.
FILE_ROWS = 10_000


@query("numbered_scan", "select doc_id, n_chars, true as in_order from documents")
def numbered_scan(spark, sf):
    """Documents as JSON lines, numbered by file split: in each file the lines ascend one by one with the ids."""
    folder, d = _stream_folder(spark, sf), Tables(spark, sf).documents.select("doc_id", "n_chars", "text")
    files = max(4, -(-d.count() // FILE_ROWS))
    d.select(F.to_json(F.struct("doc_id", "n_chars", "text")).alias("value"), "doc_id").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(folder)
    rows = readers.jsonl_enumerated(spark, f"{folder}/*.txt", d.select("doc_id", "n_chars").schema)
    place = F.row_number().over(W.partitionBy("path").orderBy("doc_id"))
    return rows.select("doc_id", "n_chars", (F.col("line_no") == place).alias("in_order"))


@query("versioned_rewrite", "select doc_id, quality from labels where doc_id not in (select doc_id from labels where toxic = 1)")
def versioned_rewrite(spark, sf):
    labels = Tables(spark, sf).labels
    table = VersionedTable(spark, _stream_folder(spark, sf))
    table.write(labels, None)
    sinks.without_bad(table, labels.where("toxic = 1"), ["doc_id"])
    table.expire(1)
    return table.read().select("doc_id", "quality")


@query("fanned_out", "select source, lang, count(*) as n from documents group by 1, 2")
def fanned_out(spark, sf):
    """A folder for each source and language, read back by its path."""
    folder, d = _stream_folder(spark, sf), Tables(spark, sf).documents
    sinks.write_partitioned(d.select("doc_id", "source", "lang"), folder, "source", "lang")
    return spark.read.schema("doc_id long, source string, lang string").parquet(folder).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("csv_round_trip", "select doc_id, source, lang, doc_id + 0 as line_ok from documents")
def csv_round_trip(spark, sf):
    """Quoted line feeds and marks survive a CSV with a byte-order mark."""
    folder, d = _stream_folder(spark, sf), Tables(spark, sf).documents
    named = d.select("doc_id", "source", "lang", F.concat(F.lit('"a"\n, '), F.col("doc_id").cast("string")).alias("note"))
    sinks.write_csv(named, folder, ["doc_id", "source", "lang", "note"])
    back = readers.csv_checked(spark, folder, ["doc_id", "note"])
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.regexp_extract("note", r'^"a"\n, (\d+)$', 1).cast("long").alias("line_ok"))
