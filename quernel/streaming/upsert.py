"""Results that arrive as files: last-wins upserts, insert-only appends, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.operators.rank import best
from quernel.sources.versions import Conflict, VersionedTable

BUCKET = "key_bucket"


def stream_of(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def upsert(stream: DataFrame, target: str, checkpoint: str, key: str, order: str, buckets: int = 64, most_deltas: int = 16, keep: int = 2):
    """Keep in `target` the last row of each key by `order`; one version of the table for each batch.

    Keys are dealt into buckets, and a batch writes only its own rows, as one
    more layer of the buckets it touches. A bucket whose layers have grown
    beyond its base in bytes, or are more than most_deltas, is written anew, so
    what is written follows the batches. All but the last `keep` versions are
    dropped. A batch that is run again after its version was put does nothing.
    """

    def batch(rows: DataFrame, n: int) -> None:
        table = VersionedTable(rows.sparkSession, target)
        now = table.current()
        if now and now.note.get("stream") == checkpoint and now.note["batch"] >= n:
            return
        parts = {p: list(f) for p, f in now.parts.items()} if now else {}
        mine = rows.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [str(r[0]) for r in mine.select(BUCKET).distinct().collect()]
        grown = [p for p in touched if len(parts.get(p, ())) > most_deltas or sum(b for _, b in parts.get(p, ())[1:]) > parts.get(p, [(None, 0)])[0][1]]
        if grown:
            old = table.read(now, grown)
            mine = mine.unionByName(old.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        last = best(mine, key, [F.col(order).desc(), F.xxhash64(*rows.columns)])
        new = table.stage(last.repartition(BUCKET), BUCKET) if touched else {}
        for p, f in new.items():
            parts[p] = [f] if p in grown else [*parts.get(p, []), f]
        try:
            table.put(parts, rows.schema, now, {"stream": checkpoint, "batch": n, "key": key, "order": order})
        except Conflict:
            table.drop(f for f, _ in new.values())
            raise
        table.expire(keep)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The last row of each key, from the newest version."""
    table = VersionedTable(spark, target)
    now = table.current()
    rows = table.read(now)
    return best(rows, now.note["key"], [F.col(now.note["order"]).desc(), F.xxhash64(*rows.columns)])


def append_new(stream: DataFrame, target: str, checkpoint: str, key: str, time: str, delay: str = "1 day"):
    """Each id once, as first seen within the watermark."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def tumbling(events: DataFrame, time: str, width: str, *by: str, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by window; for streams and for tables alike."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, *by: str, delay: str = "10 minutes") -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")
