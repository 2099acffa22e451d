"""A training corpus from `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.bpe import bpe_digest
from quernel.llm.decontaminate import decontaminated
from quernel.llm.jaccard_join import jaccard_components
from quernel.llm.language_id import fit_language_model, identify
from quernel.llm.shared import new_folder
from quernel.llm.substring_dedup import repeated_words

#: SQL can't express a trained model, byte-level BPE or components.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty; null texts and texts without letters go."""
    model = fit_language_model(docs, F.col("doc_id").isNotNull())
    found = identify(docs, model, lang_to="\x01lang", score_to="\x01score", rejected_to="\x01rejected")
    return found.where(~F.col("\x01rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links (five-word shingles, Jaccard 0.8 or more): that with the least id.

    Of rows with equal ids one stays; documents without an id stay.
    """
    found = jaccard_components(docs, n=5, percent=80)
    stay = found.where(F.col("component_id") == F.col("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("\x01rows"))
    kept = docs.join(stay, "doc_id", "left_semi").select(*docs.columns)
    if stay.where(F.col("\x01rows") > 1).limit(1).count():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 13 words that an earlier document holds; those with nothing left go, those that lose nothing are unchanged."""
    found = repeated_words(docs, 13, kept_to="\x01kept", group_bytes=4 << 20)
    text = F.when(F.col("n_removed") > 0, F.col("\x01kept")).otherwise(F.col("text"))
    found = found.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_removed") == 0))
    found = found.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10, remove="documents")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids counted, and digests of them and of what they decode to."""
    return bpe_digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, most_kept=120_000)


STAGES = [
    ("language_id", languages),
    ("jaccard_near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each kept in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
