"""Near-duplicate vectors by randomised-rotation binary codes.

A vector is rotated at random and kept as the signs of its coordinates, a bit
each, with a correction factor: the inner product of the unit vector and its
code. What it asks others with is a form of four bits a coordinate. The inner
product of a code with another vector's form, divided by the code's factor, is
an unbiased estimate of the cosine, and the factor bounds its error; it is
counted from the bits of both. These are made once and stored.

Pairs are looked for among vectors that agree in a stretch of signs of one of
several further rotations. The number of tables follows from the chance that
two vectors at the threshold agree in none of them. The tables carry codes
alone; vectors are fetched for those that a bound lets through, and computed
again exactly.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.components import components
from quernel.llm.shared import saved

ERROR_WIDTH = 5.0
#: What a first pass lets through beyond a second, so that their rounding doesn't matter.
SLACK = 1e-6


@functools.lru_cache(maxsize=256)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def plan(largest: int, cosine: float, miss: float, per_bucket: int = 32) -> tuple[int, int]:
    """Signs a table and number of tables: buckets of about per_bucket unrelated vectors, and a chance of at most `miss` to lose a pair at the threshold."""
    bits = int(min(30, max(6, math.ceil(math.log2(max(1, largest) / per_bucket + 1)))))
    agree = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def table_keys(unit: np.ndarray, bits: int, tables: int, seed: int = 1000) -> np.ndarray:
    """The signs of `bits` coordinates of each table's rotation, as a number: vectors x tables."""
    dim = unit.shape[1]
    out = np.zeros((len(unit), tables), np.int64)
    need, columns = bits * tables, []
    for k in range(-(-need // dim)):
        columns.append(unit @ rotation(dim, seed + k) > 0)
    signs = np.concatenate(columns, 1)[:, np.random.default_rng(seed).permutation(dim * len(columns))[:need]]
    for t in range(tables):
        out[:, t] = signs[:, t * bits : (t + 1) * bits] @ (1 << np.arange(bits))
    return out


def bit_rows(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, filled up with zeros."""
    n, d = bits.shape
    padded = np.zeros((n, -(-d // 64) * 64), bool)
    padded[:, :d] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


#: Bits a coordinate of the form that asks.
QUERY_BITS = 4


class Codes:
    """Codes of unit vectors, their factors, and the forms that ask with, all as they are stored.

    words: signs after a rotation, in 64-bit words; planes: the form's bits,
    highest first; low and step: what its numbers stand for.
    """

    def __init__(self, unit: np.ndarray, seed: int = 77):
        rotated = unit @ rotation(unit.shape[1], seed)
        signs = rotated > 0
        low, top = rotated.min(1), rotated.max(1)
        step = np.maximum((top - low) / ((1 << QUERY_BITS) - 1), 1e-30)
        form = np.rint((rotated - low[:, None]) / step[:, None]).astype(np.uint8)
        planes = np.stack([bit_rows(form >> b & 1 == 1) for b in reversed(range(QUERY_BITS))], 1)
        factor = np.where(signs, rotated, -rotated).sum(1) / math.sqrt(unit.shape[1])
        self._settle(unit.shape[1], bit_rows(signs), planes, factor.astype(np.float32), low.astype(np.float32), step.astype(np.float32))

    def _settle(self, dim, words, planes, factor, low, step) -> None:
        self.dim, self.words, self.planes = dim, words, planes
        self.factor, self.low, self.step = (x.astype(np.float64) for x in (factor, low, step))
        self.ones = np.bitwise_count(words).sum(1, dtype=np.int64)
        self.total = sum((np.bitwise_count(planes[:, k]).sum(1, dtype=np.int64) << (QUERY_BITS - 1 - k)) for k in range(QUERY_BITS))
        # errors of the code and of the form are independent; that of the form is bounded besides
        own = np.sqrt(np.maximum(0, 1 - self.factor**2)) / math.sqrt(max(1, dim - 1))
        rounding = min(ERROR_WIDTH / math.sqrt(12), math.sqrt(dim) / 2) * self.step.max(initial=0)
        self.rounding = rounding
        self.spread = np.sqrt((ERROR_WIDTH * own) ** 2 + rounding**2) / self.factor

    def packed(self) -> list[bytes]:
        """A code, its factor and its form as bytes."""
        head = np.stack([self.factor, self.low, self.step], 1).astype("<f4")
        return [h.tobytes() + w.tobytes() + p.tobytes() for h, w, p in zip(head, self.words, self.planes)]

    @classmethod
    def unpacked(cls, rows: list[bytes], dim: int) -> Codes:
        n, words = len(rows), -(-dim // 64)
        table = np.frombuffer(b"".join(rows), np.uint8).reshape(n, 12 + 8 * words * (1 + QUERY_BITS))
        head = np.ascontiguousarray(table[:, :12]).view("<f4")
        bits = np.ascontiguousarray(table[:, 12:]).view("<u8")
        out = cls.__new__(cls)
        out._settle(dim, bits[:, :words], bits[:, words:].reshape(n, QUERY_BITS, words), head[:, 0], head[:, 1], head[:, 2])
        return out

    def upper(self, mine: slice, others: slice, other: Codes) -> np.ndarray:
        """Upper bounds of the cosines of some vectors, by their codes, with some of another lot, by their forms."""
        words, planes = self.words[mine], other.planes[others]
        counted = np.zeros((len(words), len(planes)), np.int32)
        for k in range(QUERY_BITS):
            counted <<= 1
            for w in range(words.shape[1]):
                counted += np.bitwise_count(words[:, None, w] & planes[None, :, k, w])
        low, step = other.low[others], other.step[others]
        product = counted * (2 * step) + (low * (2 * self.ones[mine, None] - self.dim) - step * other.total[others])
        spread = np.sqrt(self.spread[mine] ** 2 + np.maximum(0, other.rounding**2 - self.rounding**2) / self.factor[mine] ** 2)
        return product / (math.sqrt(self.dim) * self.factor[mine, None]) + spread[:, None]

    def likely(self, mine: slice, cosine: float) -> np.ndarray:
        """Which of some vectors may have that cosine with which of all, by bounds from either side."""
        every = slice(0, len(self.words))
        return (self.upper(mine, every, self) >= cosine) & (self._asked(mine) >= cosine)

    def _asked(self, mine: slice) -> np.ndarray:
        """The bounds with codes and forms changed over."""
        return self.upper(slice(0, len(self.words)), mine, self).T


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that squares neither overflow nor vanish; cosines stay as they are."""
    _, exponent = np.frexp(np.abs(x).max(1, keepdims=True))
    return np.ldexp(x, -exponent)


def units_of(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def units(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """A column of n vectors of one length, each of length one."""
    return units_of(scaled(np.array(column.to_pylist(), float).reshape(n, -1)))


def exact_cosines(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) / (na * nb)


def near_vectors(vectors: DataFrame, cosine: float = 0.98, miss: float = 1e-5, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", most_together: int = 2048) -> DataFrame:
    """(id, n_links, component_id, kept): links between vectors of equal label with cosine >= `cosine`, in double precision.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and those of a null label or id, link with nothing; so do vectors of
    different lengths with one another; size makes no difference, huge and tiny
    vectors link as others do. Equal vectors of a label are one from
    the start and count as many links as they are rows. A row comes back for
    each row; component_id is the least id that links reach, kept whether that
    is the row's own. Other columns aren't read.

    A pair below the threshold is never linked; one at the threshold is missed
    with chance `miss`, one above it with less. A bucket of more than
    most_together vectors is cut, and each pair of parts compared by a task of
    its own; a pair is counted in the first table that it meets in, and no pair
    leaves a task. A first pass over the codes names the vectors that a bound
    lets through, these are fetched for its bin, and a second pass computes
    their pairs again; it returns counts and the links of a spanning forest.
    """
    single = vectors.schema[vector_column].dataType.simpleString() == "array<float>"
    vector = "array<float>" if single else "array<double>"
    v = F.col(vector_column).cast(vector)
    good = F.coalesce(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), v.alias("v"), good.alias("good"))
    rows = saved(rows.withColumn("key", F.when(F.col("good"), F.sha2(F.concat_ws(",", F.length(F.col("label").cast("string")), F.col("label").cast("string"), F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))), 256))))
    nodes = saved(rows.where("good").groupBy("key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")))
    largest = nodes.groupBy("label", F.size("v")).count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest, cosine, miss)

    def coded(batches):
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column("v").to_pylist()])
            for dim in np.unique(sizes):
                part = pa.Table.from_batches([batch]).filter(pa.array(sizes == dim))
                unit = units(part.column("v"), len(part))
                keys = table_keys(unit, bits, tables).astype(np.int32)
                part = part.drop_columns(["v"]).append_column("dim", pa.array(np.full(len(part), dim, np.int32))).append_column("code", pa.array(Codes(unit).packed(), pa.binary())).append_column("keys", pa.array(list(keys), pa.list_(pa.int32())))
                yield from part.to_batches()

    kind = vectors.schema[label_column].dataType.simpleString()
    codes = saved(nodes.select("node", "copies", "label", "v").mapInArrow(coded, f"node long, copies long, label {kind}, dim int, code binary, keys array<int>"))
    spot = codes.select("node", "copies", "label", "dim", "code", F.posexplode("keys").alias("table", "bucket"))
    where = ["label", "dim", "table", "bucket"]
    large = spot.groupBy(*where).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_together).withColumn("parts", F.ceil(F.col("n") / most_together).cast("int"))
    large = saved(large)
    copied = large.agg(F.sum(F.col("n") * (F.col("parts") - 1))).first()[0] or 0
    spot = spot.join(large.drop("n"), where, "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(0).cast("int"))
    spot = spot.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    bins = max(1, (nodes.count() * tables + copied) // 8000)
    spot = spot.withColumn("meet", F.xxhash64(*where, "i", "j")).withColumn("bin", F.pmod("meet", F.lit(bins)))

    def meetings(table: pa.Table):
        """The rows that meet: a slice of the table in order, and its codes."""
        node, meet, number, sizes = (table.column(c).to_numpy() for c in ("node", "meet", "table", "dim"))
        cuts = np.concatenate([[0], np.nonzero((meet[1:] != meet[:-1]) | (number[1:] != number[:-1]) | (sizes[1:] != sizes[:-1]))[0] + 1, [len(table)]])
        stored = table.column("code")
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo > 1:
                yield lo, hi, Codes.unpacked(stored.slice(lo, hi - lo).to_pylist(), int(sizes[lo]))

    def pairs_of(codes: Codes, part: np.ndarray, least: float):
        """Pairs of a meeting whose bounds reach `least`, the smaller place first; of two parts only those across."""
        crossed, n = part[0] != part[-1], len(part)
        for a in range(0, n, 256):
            p, q = np.nonzero(codes.likely(slice(a, a + 256), least))
            p += a
            ok = (p < q) & (part[p] != part[q]) if crossed else p < q
            yield p[ok], q[ok]

    order = [("meet", "ascending"), ("table", "ascending"), ("part", "ascending"), ("node", "ascending")]

    def survive(table: pa.Table) -> pa.Table:
        bin_, table = table.column("bin")[0].as_py(), table.sort_by(order)
        node, part, alive = table.column("node").to_numpy(), table.column("part").to_numpy(), np.zeros(len(table), bool)
        for lo, hi, c in meetings(table):
            for p, q in pairs_of(c, part[lo:hi], cosine - SLACK):
                alive[lo + p] = alive[lo + q] = True
        kept = np.unique(node[alive])
        return pa.table([pa.array(np.full(len(kept), bin_, np.int64)), pa.array(kept)], names=["bin", "node"])

    def compare(table: pa.Table, fetched: pa.Table) -> pa.Table:
        known = fetched.column("node").to_numpy()
        by = np.argsort(known)
        known, fetched = known[by], fetched.take(pa.array(by))
        table = table.filter(pa.array(np.isin(table.column("node").to_numpy(), known))).sort_by(order)
        node, copies, part, number = (table.column(c).to_numpy() for c in ("node", "copies", "part", "table"))
        at, links, edges = np.searchsorted(known, node), np.zeros(len(node), np.int64), []
        for lo, hi, c in meetings(table):
            x = scaled(np.array(fetched.column("v").take(pa.array(at[lo:hi])).to_pylist(), float))
            norm, t = np.sqrt(np.einsum("ij,ij->i", x, x)), number[lo]
            keys, label = table_keys(units_of(x), bits, tables), np.arange(hi - lo)
            for p, q in pairs_of(c, part[lo:hi], cosine):
                first = (keys[p] == keys[q]).argmax(1) == t
                p, q = p[first], q[first]
                ok = exact_cosines(x[p], x[q], norm[p], norm[q]) >= cosine
                p, q = p[ok], q[ok]
                np.add.at(links, lo + p, copies[lo + q])
                np.add.at(links, lo + q, copies[lo + p])
                before = label.copy()
                while len(p) and (label[p] != label[q]).any():
                    low = np.minimum(label[p], label[q])
                    np.minimum.at(label, p, low)
                    np.minimum.at(label, q, low)
                moved = np.nonzero(label != before)[0]
                edges += [(node[lo + moved], node[lo + label[moved]]), (node[lo + before[moved]], node[lo + label[moved]])]
        some = np.nonzero(links)[0]
        pairs = np.unique(np.concatenate([np.stack(e, 1) for e in edges]), axis=0) if edges else np.zeros((0, 2), np.int64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.table([pa.array(np.concatenate([node[some], pairs[:, 0]])), pa.array(np.concatenate([links[some], np.zeros(len(pairs), np.int64)])), pa.array(np.concatenate([np.zeros(len(some), np.int64), pairs[:, 1]]), mask=np.arange(len(some) + len(pairs)) < len(some))], names=["node", "links", "other"])

    by_bin = spot.select("bin", "meet", "table", "part", "dim", "node", "copies", "code").groupBy("bin")
    survivors = by_bin.applyInArrow(survive, "bin long, node long")
    fetched = survivors.join(nodes.select("node", "v"), "node").select("bin", "node", "v")
    found = saved(by_bin.cogroup(fetched.groupBy("bin")).applyInArrow(compare, "node long, links long, other long"))
    counts = found.where(F.col("other").isNull()).groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b")))
    per_key = nodes.select("key", "node", "copies").join(counts, "node", "left").join(joined, "node", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    out = rows.select("id", "key").join(per_key, "key", "left")
    return out.select(F.col("id").alias(id_column), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))
