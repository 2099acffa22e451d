"""Benchmark decontamination with DataFrame functions only.

The windows of all benchmark items become a set of hashes; every window of
every document is looked up in it, what is found is compared word by word, and
the words, spans or documents that are hit are reported or removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.shared import saved

#: The characters of a word.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text.cast("string"), UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _windows(words: Column, n) -> Column:
    """Hashes of the windows of n words, in order."""
    n = F.lit(n)
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, n: int, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Each distinct window of each item: item, n_window, window (its words), hash. Items without words have none."""
    items = benchmark.select(F.col(id_column).cast("string").alias("item"), words_of(F.col(text_column)).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("n_window", F.least(F.lit(n), F.size("words")))
    each = items.select("item", "n_window", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n_window") + 1), lambda i: F.slice("words", i, F.col("n_window")))).alias("window"))
    return each.distinct().withColumn("hash", F.xxhash64("window"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_rows: int = 200_000, broadcast_hits: int = 200_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with n_words, hits (places of the hit words, from 1, ascending) and items (ids as strings, sorted).

    A null text has no words; repeated rows are each reported; null item ids
    and items without words are left out; an empty benchmark hits nothing.
    Columns of docs stay unless they bear the names of the results.

    The lengths of windows are few (n, and those of shorter items), so each
    document is scanned once a length. Windows of the benchmark are broadcast
    if there are at most broadcast_rows of them, and so are the hits if at
    most broadcast_hits windows were found; beyond that Spark joins by shuffle.
    A hot passage adds rows to many documents, never many to one task: hits
    are gathered by document.
    """
    windows = saved(benchmark_windows(benchmark.where(F.col("item_id").isNotNull()), n))
    lengths = sorted(r[0] for r in windows.select("n_window").distinct().collect())
    wanted = windows.select("hash", "n_window").distinct()
    if wanted.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    key = [F.col(id_column).alias("\x01id"), F.xxhash64(text_column).alias("\x01text")]
    scanned = docs.select(*key, words_of(F.col(text_column)).alias("words"))
    found = None
    for length in lengths:
        part = scanned.select("\x01id", "\x01text", F.posexplode(_windows(F.col("words"), length)).alias("at", "hash")).join(wanted.where(F.col("n_window") == length), "hash", "left_semi")
        part = part.withColumn("n_window", F.lit(length))
        found = part if found is None else found.unionByName(part)
    words = words_of(F.col(text_column))
    keep = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    if found is None:
        empty = F.array()
        return docs.select(*keep, F.size(words).alias("n_words"), empty.cast("array<int>").alias("hits"), empty.cast("array<string>").alias("items"))
    matched = found.join(F.broadcast(windows) if windows.count() <= broadcast_rows else windows, ["hash", "n_window"])
    by_doc = matched.groupBy("\x01id", "\x01text").agg(F.collect_set(F.struct((F.col("at") + 1).alias("at"), "n_window", "window", "item")).alias("\x01found"))
    by_doc = saved(by_doc)
    total = by_doc.agg(F.sum(F.size("\x01found"))).first()[0] or 0
    marked = docs.withColumns({"\x01k": F.col(id_column), "\x01t": F.xxhash64(text_column)})
    joined = marked.join(F.broadcast(by_doc) if total <= broadcast_hits else by_doc, F.col("\x01k").eqNullSafe(F.col("\x01id")) & (F.col("\x01t") == F.col("\x01text")), "left")
    checked = F.filter(F.coalesce("\x01found", F.array().cast(by_doc.schema["\x01found"].dataType)), lambda x: F.slice("\x01w", x["at"], x["n_window"]) == x["window"])
    joined = joined.withColumn("\x01w", words).withColumn("\x01ok", F.when(F.col("\x01found").isNotNull(), checked))
    hits = F.array_sort(F.array_distinct(F.flatten(F.transform("\x01ok", lambda x: F.sequence(x["at"], x["at"] + x["n_window"] - 1)))))
    items = F.array_sort(F.array_distinct(F.transform("\x01ok", lambda x: x["item"])))
    return joined.select(*keep, F.size("\x01w").alias("n_words"), F.coalesce(hits, F.array().cast("array<int>")).alias("hits"), F.coalesce(items, F.array().cast("array<string>")).alias("items"))


def contamination_digest(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of all docs."""
    found = contamination(docs.select("doc_id", "text"), benchmark, n)
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", text_column: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark window, or ("spans") without their hit words.

    A removed word goes with the characters before it. Only the text changes.
    """
    found = contamination(docs, benchmark, n, text_column=text_column)
    if remove == "documents":
        return found.where(F.size("hits") == 0).select(*docs.columns)
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    pieces = F.regexp_extract_all(F.col(text_column), F.lit(f"{BETWEEN_ANY}*{_any_case(WORD)}|{BETWEEN_ANY}+$"), F.lit(0))
    kept = F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains("hits", i + 1)), "")
    return found.withColumn(text_column, F.when(F.size("hits") > 0, kept).otherwise(F.col(text_column))).select(*docs.columns)


def _any_case(pattern: str) -> str:
    """The word pattern before lower-casing: A-Z belong to words too."""
    return pattern.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")


BETWEEN_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
