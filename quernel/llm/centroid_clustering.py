"""K-means in exact integers, with Elkan's bounds.

A vector keeps an upper bound of its distance to its centroid and a lower bound
of its distance to every centroid. When centroids move, the bounds move with
them; a distance is computed only where the upper bound doesn't lie strictly
below the lower bound, and strictly below half the distance of the two
centroids. Bounds are rounded away from the truth and compared strictly, so no
tie is ever pruned, and whatever is decided is decided by exact integers.

Vectors and bounds travel as blocks through a chain of narrow stages, each kept
by Spark in memory or on disk; nothing is shuffled but the sums of each block.
A block that is lost with its executor is made again from the table by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.shared import written

BLOCK_ROWS = 8192
#: Squared norms below this, in scaled units: distances fit a long then.
LARGEST = float(1 << 60)
ROUNDING = 2.0**-49


def up(x: np.ndarray) -> np.ndarray:
    """A little more than x, whatever rounding took off it."""
    return np.nextafter(x * (1 + ROUNDING), np.inf)


def down(x: np.ndarray) -> np.ndarray:
    """A little less than x, not below 0."""
    return np.maximum(0, np.nextafter(x * (1 - ROUNDING), -np.inf))


def scaled(column: str, by: int) -> Column:
    """floor(by * x) of each component as a long; x as double."""
    return F.transform(F.col(column), lambda x: F.floor(x.cast("double") * F.lit(float(by))).cast("long"))


def finite(column: str) -> Column:
    """Whether a vector is there, with no component that is null, NaN or infinite."""
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & ~bad, F.lit(False))


def norm_below(column: str, by: int, most: float) -> Column:
    """Whether the squared norm of the scaled vector is below `most`."""
    return F.aggregate(F.col(column), F.lit(0.0), lambda a, x: a + F.pow(F.floor(F.greatest(F.least(x.cast("double") * float(by), F.lit(3e9)), F.lit(-3e9))).cast("double"), F.lit(2.0))) < most


class Centroids:
    """Centroids as integers, half the distances between them, and how far each moved since the last round."""

    def __init__(self, values: np.ndarray, before: np.ndarray | None = None):
        self.values = values
        gaps = ((values[:, None, :] - values[None, :, :]) ** 2).sum(2)
        self.half = down(np.sqrt(gaps.astype(np.float64)) / 2)
        others = self.half + np.where(np.eye(len(values), dtype=bool), np.inf, 0)
        self.nearest = others.min(1) if len(values) else np.zeros(0)
        moved = np.zeros(len(values)) if before is None else np.sqrt(((values - before) ** 2).sum(1).astype(np.float64))
        self.moved = np.where(moved > 0, up(moved), 0.0)


class Bounds:
    """Assignment, upper and lower bounds of a block of vectors; `computed` counts distances."""

    def __init__(self, x: np.ndarray, k: int):
        self.x, self.at = x, np.zeros(len(x), np.int32)
        self.upper, self.lower = np.full(len(x), np.inf), np.zeros((len(x), k))
        self.computed = 0

    def squared(self, rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows to a centroid each."""
        self.computed += len(rows)
        d = self.x[rows] - centroids
        return np.einsum("ij,ij->i", d, d)

    def step(self, c: Centroids) -> None:
        """Move the bounds with the centroids, then settle the nearest centroid of every vector; ties go to the smaller number."""
        self.upper = up(self.upper + c.moved[self.at])
        self.lower = down(self.lower - c.moved)
        rows = np.nonzero(self.upper >= c.nearest[self.at])[0]
        if not len(rows):
            return
        may = (self.upper[rows, None] >= self.lower[rows]) & (self.upper[rows, None] >= c.half[self.at[rows]])
        may[np.arange(len(rows)), self.at[rows]] = False
        rows = rows[may.any(1)]
        if not len(rows):
            return
        at = self.at[rows]
        best = self.squared(rows, c.values[at])
        self._tighten(rows, at, best)
        for j in range(len(c.values)):
            upper = self.upper[rows]
            near = (at != j) & (upper >= self.lower[rows, j]) & (upper >= c.half[at, j])
            some = np.nonzero(near)[0]
            if not len(some):
                continue
            d = self.squared(rows[some], c.values[j])
            self.lower[rows[some], j] = down(np.sqrt(d.astype(np.float64)))
            better = (d < best[some]) | ((d == best[some]) & (j < at[some]))
            won = some[better]
            at[won], best[won] = j, d[better]
            self.upper[rows[won]] = up(np.sqrt(d[better].astype(np.float64)))
        self.at[rows] = at

    def _tighten(self, rows: np.ndarray, at: np.ndarray, squared: np.ndarray) -> None:
        d = np.sqrt(squared.astype(np.float64))
        self.upper[rows] = up(d)
        self.lower[rows, at] = down(d)

    def sums(self, k: int) -> list[tuple[int, int, list[int]]]:
        """(cluster, number of vectors, sum by component) of the block."""
        out = []
        for j in range(k):
            mine = self.x[self.at == j]
            if len(mine):
                out.append((j, len(mine), mine.sum(0).tolist()))
        return out


_STATE = "ids array<long>, x binary, at binary, upper binary, lower binary, computed long, sums array<struct<cluster: int, n: long, total: array<long>>>"
_SUMS = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))
_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("at", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("computed", pa.int64()), ("sums", _SUMS)])


def _row(ids: list, b: Bounds, k: int) -> pa.RecordBatch:
    sums = [{"cluster": j, "n": n, "total": t} for j, n, t in b.sums(k)]
    x = b.x.astype("<i4").tobytes()
    return pa.RecordBatch.from_pylist([{"ids": ids, "x": x, "at": b.at.tobytes(), "upper": b.upper.tobytes(), "lower": b.lower.tobytes(), "computed": b.computed, "sums": sums}], _SCHEMA)


def _bounds(row: dict, dim: int, k: int) -> Bounds:
    b = Bounds(np.frombuffer(row["x"], "<i4").reshape(-1, dim).astype(np.int64), k)
    b.at, b.upper = np.frombuffer(row["at"], np.int32).copy(), np.frombuffer(row["upper"], np.float64).copy()
    b.lower = np.frombuffer(row["lower"], np.float64).reshape(-1, k).copy()
    return b


def _moved(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of exact means; one without vectors stays. k x dim sums come to the driver, whatever the table's size."""
    each = state.select(F.explode("sums").alias("s")).select("s.cluster", "s.n", F.posexplode("s.total").alias("i", "v"))
    totals = each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    new = now.copy()
    for r in totals:
        new[r["cluster"], r["i"]] = int(Decimal(r["v"])) // r["n"]
    return new


def elkan(vectors: DataFrame, k: int, rounds: int, seed_text: str, dim: int, scale: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that takes part; `computed` counts its block's distances.

    Vectors of exactly `dim` components take part, none of them null or not
    finite; components become floor(scale * x). A vector whose squared norm in
    those units is 2^60 or more is left out: distances to it don't fit a long.
    The first centroids are the k vectors whose sha256 of seed_text and id is
    least (null ids sort last, equal hashes by the vector; all vectors, if
    fewer). Then `rounds` times: all vectors to the nearest centroid, ties to the
    smaller number, and centroids to the floor of their exact means. At last all
    are assigned once more. Repeated rows count each; no vectors, no rows.
    cluster_inertia or inertia beyond a long is null.
    """
    kept = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v")).where(finite("v") & (F.size("v") == dim)).where(norm_below("v", scale, LARGEST))
    ready = kept.select("vec_id", scaled("v", scale).alias("x"))
    by_hash = F.sha2(F.concat(F.lit(seed_text), F.col("vec_id").cast("string")), 256)
    first = ready.orderBy(by_hash.asc_nulls_last(), "x").limit(k).collect()
    centroids = Centroids(np.array([r["x"] for r in first], np.int64).reshape(-1, dim))
    k = len(first)

    def begin(batches: Iterator[pa.RecordBatch], c: Centroids = centroids) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                b = Bounds(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64), k)
                b.step(c)
                yield _row(part.column(0).to_pylist(), b, k)

    def stepping(c: Centroids):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    row = batch.slice(i, 1).to_pylist()[0]
                    b = _bounds(row, dim, k)
                    b.step(c)
                    yield _row(row["ids"], b, k)

        return step

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                b = _bounds(row, dim, k)
                d = b.squared(np.arange(len(b.x)), last.values[b.at])
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(b.at), pa.array(d), pa.array(np.full(len(d), row["computed"], np.int64))], names=["vec_id", "cluster", "distance", "computed"])

    state, before = ready.mapInArrow(begin, _STATE).persist(StorageLevel.MEMORY_AND_DISK), None
    for _ in range(rounds):
        centroids = Centroids(_moved(state, centroids.values), centroids.values)
        if before is not None:
            before.unpersist()
        before, state = state, state.select("ids", "x", "at", "upper", "lower").mapInArrow(stepping(centroids), _STATE).persist(StorageLevel.MEMORY_AND_DISK)
    last = centroids
    found = written(state.select("ids", "x", "at", "upper", "lower", "computed").mapInArrow(results, "vec_id long, cluster int, distance long, computed long"), "clusters")
    for one in filter(None, (before, state)):
        one.unpersist()
    per = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    long = lambda v: F.lit(int(v) if v < 1 << 63 else None).cast("long")
    pick = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1) if values else F.lit(None)
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last.values.tolist()]
    return found.select(
        "vec_id", "cluster", "distance", pick([long(per.get(j, 0)) for j in range(k)]).cast("long").alias("cluster_inertia"), long(sum(per.values())).alias("inertia"),
        pick([F.lit(h) for h in named]).cast("string").alias("centroid_sha256"), "computed",
    )


def clusters_digest(vectors: DataFrame) -> DataFrame:
    """Eight clusters of the vectors of 64 components, after ten rounds."""
    return elkan(vectors, k=8, rounds=10, seed_text="3:", dim=64, scale=1024).drop("computed")
