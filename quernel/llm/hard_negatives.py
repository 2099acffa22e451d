"""Hard negatives by a two-dimensional block product.

Rows are dealt into blocks and their components into chunks, and so are the
anchors. Every block of anchors meets every block of rows, chunk by chunk: a
task multiplies one panel of anchors with one panel of rows into a tile of
partial integer scores, and the tiles of the same blocks are added in a
shuffle. An added tile gives the best rows of an anchor's own label, and the
rows of other labels that may still lie in a window; when all tiles have told
the anchors' positives, each tile gives its best rows of each window, and the
best of all tiles stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.llm.centroid_clustering import finite, norm_below, scaled
from quernel.llm.shared import written

ROWS, ANCHORS, CHUNK = 4096, 256, 32
#: Positives of all anchors up to this size are broadcast; beyond it they are joined tile by tile.
BROADCAST_BYTES = 32 << 20
#: Integers of up to this many bits are exact in doubles.
EXACT_BITS = 53


def narrow(m: np.ndarray) -> bytes:
    """An integer matrix in the least of 1, 2, 4 or 8 bytes a value that holds it; the first byte tells which."""
    most = int(np.abs(m).max(initial=0))
    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if most <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + np.ascontiguousarray(m.astype(kind)).tobytes()


def widened(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(-1, columns).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, in exact integers; by doubles where these hold every sum."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << EXACT_BITS:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best_in_rows(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first `most` allowed columns of each row by falling score; equal scores by the smaller column."""
    rows, columns = [], []
    for i in range(len(scores)):
        may = np.nonzero(allowed[i])[0]
        s = scores[i, may]
        if len(may) > 4 * most:  # leave out what lies below the last that can be chosen, keeping its equals
            least = np.partition(s, len(s) - most)[len(s) - most]
            may, s = may[s >= least], s[s >= least]
        chosen = may[np.argsort(-s, kind="stable")[:most]]
        rows.append(np.full(len(chosen), i))
        columns.append(chosen)
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def panels(ready: DataFrame, blocks: int, chunks: int, chunk: int, name: str) -> DataFrame:
    """(name, chunk, ids, labels, m): the rows of each block by ascending id, cut into chunks of components; ids and labels come with the first chunk."""
    dealt = ready.withColumn(name, F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(blocks)).cast("int"))

    def cut(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n, lists = len(table), table.column("x").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        offsets, values = np.asarray(lists.offsets), lists.flatten().to_numpy(zero_copy_only=False)
        offsets = offsets - offsets[0]
        m = np.zeros((n, chunks * chunk), np.int64)
        m[np.repeat(np.arange(n), np.diff(offsets)), np.arange(len(values)) - np.repeat(offsets[:-1], np.diff(offsets))] = values
        ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        order = np.lexsort([*m.T[::-1], labels, ids])
        ids, labels, m = ids[order].astype("<i8"), labels[order].astype("<i8"), m[order]
        return pa.table({
            name: pa.array([table.column(name)[0].as_py()] * chunks, pa.int32()), "chunk": pa.array(range(chunks), pa.int32()),
            "ids": pa.array([ids.tobytes()] + [None] * (chunks - 1), pa.binary()), "labels": pa.array([labels.tobytes()] + [None] * (chunks - 1), pa.binary()),
            "m": pa.array([narrow(m[:, c * chunk : (c + 1) * chunk]) for c in range(chunks)], pa.binary()),
        })

    return dealt.groupBy(name).applyInArrow(cut, f"{name} int, chunk int, ids binary, labels binary, m binary")


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding", rows_per_block: int = ROWS, anchors_per_block: int = ANCHORS, chunk: int = CHUNK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of all anchors.

    Components become floor(scale * x); a score is the integer inner product
    with the anchor, over the components that both have. Higher scores come
    first, ties by smaller id. An anchor's positives are its first rows of equal
    label and another id; for each, the negatives are the first rows of other
    labels with low * positive <= 100 * negative <= high * positive.

    Rows with a null id, label or vector, or a component that is null or not
    finite take no part, nor do rows whose squared norm in those units is 2^60
    or more, as scores don't fit a long then. Rows equal in id, label and vector
    count once; rows of equal id that differ count each, and several such
    anchors give rows each. No anchors, no rows.
    """
    spark = vectors.sparkSession
    if not 0 <= low <= high:
        raise ValueError("low and high must ascend from 0")
    named = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    kept = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("v")).where(norm_below("v", scale, float(1 << 60)))
    ready = written(kept.select("vec_id", "label", scaled("v", scale).alias("x"), "anchor").distinct(), "vectors")
    n, n_anchors, dim = ready.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("x"))).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return spark.createDataFrame([], out)
    blocks, anchor_blocks, chunks = -(-n // rows_per_block), -(-n_anchors // anchors_per_block), max(1, -(-dim // chunk))

    left = panels(ready.where("anchor").drop("anchor"), anchor_blocks, chunks, chunk, "i").select("i", "chunk", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("m").alias("a"))
    right = panels(ready.drop("anchor"), blocks, chunks, chunk, "j")
    met = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(right.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1)))), ["i", "j", "chunk"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                r = batch.slice(k, 1)
                tile = product(widened(r.column("a")[0].as_py(), chunk), widened(r.column("m")[0].as_py(), chunk))
                yield pa.RecordBatch.from_arrays([*(r.column(c) for c in ("i", "j", "a_ids", "a_labels", "ids", "labels")), pa.array([narrow(tile)], pa.binary())], names=["i", "j", "a_ids", "a_labels", "ids", "labels", "tile"])

    partial = met.select("i", "j", "a_ids", "a_labels", "ids", "labels", "a", "m").mapInArrow(multiply, "i int, j int, a_ids binary, a_labels binary, ids binary, labels binary, tile binary")

    def add(table: pa.Table) -> pa.Table:
        first = table.filter(pa.compute.is_valid(table.column("ids")))
        a_ids, a_labels, ids, labels = (np.frombuffer(first.column(c)[0].as_py(), "<i8") for c in ("a_ids", "a_labels", "ids", "labels"))
        scores = np.zeros((len(a_ids), len(ids)), np.int64)
        for tile in table.column("tile"):
            scores += widened(tile.as_py(), len(ids))
        same = a_labels[:, None] == labels[None, :]
        rows, columns = best_in_rows(scores, same & (a_ids[:, None] != ids[None, :]), positives)
        told = np.bincount(rows, minlength=len(a_ids))
        least = np.full(len(a_ids), np.iinfo(np.int64).min)
        np.minimum.at(low_of := np.full(len(a_ids), np.iinfo(np.int64).max), rows, scores[rows, columns])
        # a later positive of the anchor scores no less than the last of a full list here
        least[told == positives] = low_of[told == positives]
        may = ~same
        for i in np.nonzero(told == positives)[0]:
            may[i] &= over(scores[i], int(least[i]), low)
        na, nr = np.nonzero(may)
        pos = [{"a": int(a), "anchor_id": int(a_ids[a]), "score": int(scores[a, c]), "id": int(ids[c])} for a, c in zip(rows, columns)]
        return pa.table({
            "i": table.column("i")[:1], "j": table.column("j")[:1], "pos": pa.array([pos], pa.list_(pa.struct([("a", pa.int32()), ("anchor_id", pa.int64()), ("score", pa.int64()), ("id", pa.int64())]))),
            "ids": pa.array([ids.tobytes()], pa.binary()), "counts": pa.array([np.bincount(na, minlength=len(a_ids)).astype("<i4").tobytes()], pa.binary()),
            "at": pa.array([nr.astype("<i4").tobytes()], pa.binary()), "scores": pa.array([narrow(scores[na, nr])], pa.binary()),
        })

    summed = partial.groupBy("i", "j").applyInArrow(add, "i int, j int, pos array<struct<a: int, anchor_id: long, score: long, id: long>>, ids binary, counts binary, at binary, scores binary")
    tiles = written(summed, "tiles")

    by_anchor = W.partitionBy("i", "a").orderBy(F.col("score").desc(), "id")
    told = tiles.select("i", F.explode("pos").alias("p")).select("i", "p.*").withColumn("place", F.row_number().over(by_anchor)).where(F.col("place") <= positives)
    per_block = told.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("a", "place", "anchor_id", "score", "id"))).alias("positives"))
    candidates = tiles.select("i", "j", "ids", "counts", "at", "scores")
    if n_anchors * positives * 48 <= broadcast_bytes:
        asked = candidates.join(F.broadcast(per_block), "i")
    else:
        asked = candidates.join(per_block.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), ["i", "j"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                r = batch.slice(k, 1)
                i, ids = r.column("i")[0].as_py(), np.frombuffer(r.column("ids")[0].as_py(), "<i8")
                ends = np.concatenate([[0], np.cumsum(np.frombuffer(r.column("counts")[0].as_py(), "<i4"), dtype=np.int64)])
                at, scores = np.frombuffer(r.column("at")[0].as_py(), "<i4"), widened(r.column("scores")[0].as_py(), 1)[:, 0]
                found = []
                for p in r.column("positives")[0].as_py():
                    part = slice(ends[p["a"]], ends[p["a"] + 1])
                    s = scores[part]
                    inside = over(s, p["score"], low) & under(s, p["score"], high)
                    _, best = best_in_rows(s[None, :], inside[None, :], negatives)
                    found += [(i, p["a"], p["place"], p["anchor_id"], p["id"], p["score"], int(ids[at[part][b]]), int(s[b])) for b in best]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found) if found else [()] * 8, _FOUND.values())], names=list(_FOUND))

    chosen = asked.select("i", "ids", "counts", "at", "scores", "positives").mapInArrow(choose, ", ".join(f"{c} {'int' if t == pa.int32() else 'long'}" for c, t in _FOUND.items()))
    by_window = W.partitionBy("i", "a", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    best = chosen.withColumn("rank", F.row_number().over(by_window)).where(F.col("rank") <= negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


_FOUND = {"i": pa.int32(), "a": pa.int32(), "place": pa.int32(), "anchor_id": pa.int64(), "positive_id": pa.int64(), "positive_score": pa.int64(), "negative_id": pa.int64(), "negative_score": pa.int64()}


def over(scores: np.ndarray, positive: int, low: int) -> np.ndarray:
    """Whether low * positive <= 100 * score, without leaving 64 bits."""
    return scores >= -(-low * positive // 100)


def under(scores: np.ndarray, positive: int, high: int) -> np.ndarray:
    """Whether 100 * score <= high * positive."""
    return scores <= high * positive // 100


def negatives_digest(vectors: DataFrame) -> DataFrame:
    """Five negatives for each of the five positives of the vectors whose id is divisible by 100; ids divisible by 7 bear the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
