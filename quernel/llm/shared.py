"""Small helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the session names none and runs on one machine, as in tests, a
    temporary folder is chosen and set for the session; elsewhere that is an
    error, for executors wouldn't see such a folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quernel-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, what: str) -> DataFrame:
    """df, computed once and read back from Parquet below the shared folder."""
    folder = new_folder(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def id_crc32(column: str = "doc_id"):
    """crc32 of an id written as decimal text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def hashed_sample(df: DataFrame, rows: int, *columns: str, text: str | None = None, most_bytes: int = 128 << 20) -> DataFrame:
    """About `rows` rows of df, all of it if it has fewer, chosen by a hash of `columns`.

    A threshold on the hash, so neither a sort nor a shuffle of the rows. With
    `text` named, its texts are no more than about most_bytes together, and it
    belongs among the columns: an id that many rows bear is then no unit.
    """
    size = F.sum(F.octet_length(text)) if text else F.lit(0)
    n, total = df.agg(F.count(F.lit(1)), size).first()
    share = min(rows / max(n, 1), most_bytes / max(total or 0, 1))
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < int((1 << 30) * share))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of UTF-8 in a column."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def split_count(nbytes: int, each: int) -> int:
    """How many parts of about `each` bytes there are in nbytes; from the data alone."""
    return max(1, -(-nbytes // each))
