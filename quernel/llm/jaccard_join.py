"""N-gram Jaccard join with count vectors in an R-tree.

A document is a set of word shingles. Shingles are hashed into groups, and the
counts of the groups are a point; the overlap of two sets is at most the sum
of the lesser coordinates, so a box of an R-tree bounds the overlap with
everything inside it, and pairs that survive are compared exactly.

Which documents meet in a tree is decided without loss. Two sets that differ
in at most d shingles agree wholly in all but d of their groups, so of any more
than d groups one agrees at least; documents with an equal group among their
fullest are candidates. More groups are kept than one, so linked sets agree in
several: of a set's signatures that others have too, ordered alike for all sets
with the rarest first, the last few can be left out, and what texts agree in by
chance goes with them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.chunks import alone, alone_here
from quernel.llm.components import Forest, components
from quernel.llm.exchange import Deal, Rolling, Texts, mixed, pack_sorted, ranges, unpack_sorted
from quernel.llm.shared import saved
from quernel.llm.substring_dedup import word_places

_bytes, _words = Rolling(41), Rolling(42)
_fold = np.arange(256)
_fold[65:91] += 32
_folded = _bytes.of_byte[_fold]
COORDINATES = 128
LEAF = 16
CLASS = 4095


def shingle_sets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text in ascending order, and where each text's begin.

    Words are split at ASCII white space, A-Z lower-cased; a text of fewer than
    n words is one shingle, one without words none.
    """
    found, sizes = [], np.zeros(len(texts), np.int64)
    for first, last in texts.chunks():
        lo, hi = texts.offsets[first], texts.offsets[last]
        starts, ends, doc = word_places(texts.data[lo:hi], texts.offsets[first : last + 1] - lo)
        each = _bytes.stretch(_bytes.sums(_folded[texts.data[lo:hi]]), starts, ends)
        sums = _words.sums(each)
        count = np.bincount(doc, minlength=last - first)
        opens = np.cumsum(count) - count
        at = np.nonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])[0] if len(doc) >= n else np.zeros(0, np.int64)
        short = np.nonzero((count > 0) & (count < n))[0]
        begin, end = np.concatenate([at, opens[short]]), np.concatenate([at + n, opens[short] + count[short]])
        h, of = _words.stretch(sums, begin, end), np.concatenate([doc[at], short])
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]) if len(h) else np.zeros(0, bool)
        found.append(h[new])
        sizes[first:last] = np.bincount(of[new], minlength=last - first)
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def grouped_sum(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, group, values)
    return out


def set_keys(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A key of each set: equal for equal sets."""
    sizes = np.diff(begins)
    return mixed(grouped_sum(mixed(hashes), np.repeat(np.arange(len(sizes)), sizes), len(sizes)) + sizes.astype(np.uint64))


class Classes:
    """Classes of set sizes. A pair that links has sizes in one class or two adjacent ones; it meets in that of the larger.

    differ: the most shingles by which two linked sets can differ whose larger
    is the greatest of the class. agree: in how many groups they agree then, of
    those that are kept. groups: some more than both, so that those with the
    fewest shingles can be left out; none where only equal sets link.
    """

    def __init__(self, percent: int, size: int):
        """Classes for sets of up to `size` shingles, and the one after."""
        self.edges, differ = [1], []
        while len(self.edges) < 2 or self.edges[-2] <= size:
            low = self.edges[-1]
            self.edges.append(max(low + 1, -(-low * 100 // percent)))
            differ.append(2 * (self.edges[-1] - 1) * (100 - percent) // (100 + percent))
        self.differ = np.array(differ)
        self.agree = self.differ // 4 + 2
        self.groups = np.where(self.differ > 0, self.differ + self.agree + self.differ // 8, 0)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.edges), sizes, "right") - 1


def signatures(hashes: np.ndarray, begins: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the fullest groups of each set, in the class of its size and in the next, and which set each is of.

    Of each set only groups of c shingles or more count, c the greatest number
    that leaves `differ` + `agree` groups or more. Of two linked sets take the
    one with the larger c: `agree` of its groups are the other's too, and as
    full there. The last 12 bits of a hash are the class.
    """
    sizes = np.diff(begins)
    full = np.nonzero(sizes)[0]
    if not len(full):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    classes = Classes(percent, int(sizes.max()))
    spread, value = mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(8), mixed(hashes)
    out_s, out_d = [], []
    for step in (0, 1):
        kind = np.minimum(classes.of(sizes) + step, len(classes.groups) - 1)
        groups = np.where(sizes > 0, classes.groups[kind], 0)
        first = np.cumsum(groups) - groups
        use = np.repeat(groups > 0, sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)[use]
        slot = first[doc] + (spread[use] % groups[doc].astype(np.uint64)).astype(np.int64)
        total = int(groups.sum())
        sums, count = grouped_sum(value[use], slot, total), np.bincount(slot, minlength=total)
        owner = np.repeat(np.arange(len(sizes)), groups)
        place = np.arange(total) - first[owner]
        some = np.nonzero(groups)[0]
        fullest = np.sort(owner * (int(count.max(initial=0)) + 1) - count)[first[some] + classes.differ[kind[some]] + classes.agree[kind[some]] - 1]
        least = np.zeros(len(sizes), np.int64)
        least[some] = some * (int(count.max(initial=0)) + 1) - fullest
        keep = count >= least[owner]
        label = (kind[owner].astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64)
        out_s.append((mixed(mixed(label) + sums) & ~np.uint64(CLASS) | kind[owner].astype(np.uint64) & np.uint64(CLASS))[keep])
        out_d.append(owner[keep])
    return np.concatenate(out_s), np.concatenate(out_d)


# The R-tree


class CountTree:
    """An R-tree over points of group counts, packed by halving along the widest coordinate."""

    def __init__(self, points: np.ndarray):
        self.points, self.sizes = points, points.sum(1)
        self.levels: list[tuple[np.ndarray, np.ndarray, list]] = []
        leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            part = todo.pop()
            if len(part) <= LEAF:
                leaves.append(part)
                continue
            p = points[part]
            part = part[np.argsort(p[:, np.argmax(p.max(0) - p.min(0))], kind="stable")]
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]
        high = np.array([points[x].max(0) for x in leaves])
        low = np.array([self.sizes[x].min() for x in leaves])
        self.levels.append((high, low, leaves))
        while len(self.levels[-1][0]) > 1:
            high, low, _ = self.levels[-1]
            parts = [np.arange(i, min(i + LEAF, len(high))) for i in range(0, len(high), LEAF)]
            self.levels.append((np.array([high[x].max(0) for x in parts]), np.array([low[x].min() for x in parts]), parts))

    def search(self, point: np.ndarray, percent: int) -> np.ndarray:
        """Points whose overlap with `point` may be enough, those with the greatest bound first."""
        size, at = point.sum(), np.zeros(1, np.int64)
        for high, low, inside in reversed(self.levels):
            bound = np.minimum(high[at], point).sum(1)
            at = at[(100 + percent) * bound >= percent * (size + low[at])]
            at = np.concatenate([inside[i] for i in at]) if len(at) else at
            if not len(at):
                return at
        bound = np.minimum(self.points[at], point).sum(1)
        ok = (100 + percent) * bound >= percent * (size + self.sizes[at])
        return at[ok][np.argsort(-bound[ok], kind="stable")]


def link_sets(hashes: np.ndarray, begins: np.ndarray, percent: int, upper: np.ndarray | None = None) -> np.ndarray:
    """The least member of each set's component, for a handful or some thousands of sets.

    Every pair that the tree lets through and that isn't connected yet is
    compared exactly; of sets that aren't `upper`, only with those that are.
    """
    n = len(begins) - 1
    sizes = np.diff(begins)
    slot = np.repeat(np.arange(n), sizes) * COORDINATES + (mixed(hashes ^ np.uint64(0xA3B195354A39B70D)) % np.uint64(COORDINATES)).astype(np.int64)
    points = np.bincount(slot, minlength=n * COORDINATES).reshape(n, COORDINATES).astype(np.int32)
    tree, forest = CountTree(points), Forest(n)
    for i in range(n):
        if not sizes[i]:
            continue
        own = hashes[begins[i] : begins[i + 1]]
        near = tree.search(points[i], percent)
        near = near[near > i]
        if upper is not None and not upper[i]:
            near = near[upper[near]]
        while len(near := near[forest.label[near] != forest.label[i]]):
            j, near = near[0], near[1:]
            other = hashes[begins[j] : begins[j + 1]]
            at = np.minimum(np.searchsorted(other, own), len(other) - 1)
            both = int((other[at] == own).sum())
            if 100 * both >= percent * (len(own) + len(other) - both):
                forest.join(i, j)
    return forest.label


# On Spark


def small_batches(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of about `size` bytes, one row at least."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text", most_together: int = 512, broadcast_rows: int = 500_000) -> DataFrame:
    """(id, n_shingles, component_id): sets of shingles, and the least id that links reach.

    Two documents link if 100 x intersection >= percent x union. Empty sets
    link with nothing. Rows with a null id link with nothing and have a null
    component; repeated rows are linked, having equal sets. Rows of equal id
    with different texts are documents by themselves: each has the component of
    its own text, which may bear the id of another's. Other columns of docs
    aren't read.

    Equal sets are one node from the start, however many rows have them.
    Candidates are compared in components of documents that agree in a group.
    One of more than most_together nodes, or of more shingles than 4,096 times
    that, is cut by the sizes of its sets, each meeting those of its class and
    of the next; what is still larger is cut into parts, and each pair of parts
    compared by a task of its own. What one comparison needs is bounded by
    2 x most_together sets and by their shingles.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    ranges_n = Deal.of(rows, "text").groups

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone_here()
        for batch in small_batches(batches):
            hashes, begins = shingle_sets(Texts.of(pa.Table.from_batches([batch]), "id", "text"), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(begins)), pa.array(set_keys(hashes, begins).view(np.int64))], names=["id", "n_shingles", "node"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone_here()
        for batch in small_batches(batches):
            texts = Texts.of(pa.Table.from_batches([batch]), "id", "text")
            hashes, begins = shingle_sets(texts, n)
            nodes = set_keys(hashes, begins)
            sig, doc = signatures(hashes, begins, percent)
            keep = texts.known[doc]
            sig, node = sig[keep], nodes[doc[keep]]
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]) if len(sig) else np.zeros(0, bool)
            sig, node = sig[new], node[new]
            del hashes, doc, order, new
            out = [(b, pack_sorted(sig[lo:hi]), node[lo:hi].tobytes()) for b, lo, hi in ranges(sig, 64, ranges_n)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["range", "sig", "node"])

    def meet(table: pa.Table) -> pa.Table:
        sig = np.concatenate([unpack_sorted(x) for x in table.column("sig").to_pylist()])
        node = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("node").to_pylist()]).view(np.int64)
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
        sig, node = sig[new], node[new]
        heads = np.nonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))[0]
        size = np.diff(np.append(heads, len(sig)))
        size = np.repeat(size, size)
        shared = size > 1
        agree = Classes(percent, 1 << 40).agree[(sig[shared] & np.uint64(CLASS)).astype(np.int64)] if shared.any() else size[:0]
        return pa.table([pa.array(sig[shared].view(np.int64)), pa.array(node[shared]), pa.array(size[shared], pa.int64()), pa.array(agree, pa.int64())], names=["sig", "node", "size", "agree"])

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("coarse", "block", "i", "j", "node")])
        out_a, out_b = [], []
        if len(table):
            key = np.stack([table.column(c).to_numpy() for c in ("coarse", "block", "i", "j")])
            cuts = np.concatenate([[0], np.nonzero((key[:, 1:] != key[:, :-1]).any(0))[0] + 1, [len(table)]])
            node, upper = table.column("node").to_numpy(), table.column("upper").to_numpy(zero_copy_only=False)
            k = 0
            while k < len(cuts) - 1:  # some small groups, or one large one, at a time
                last = max(k + 1, int(np.searchsorted(cuts, cuts[k] + most_together, "right")) - 1)
                first_row, n_rows = cuts[k], cuts[last] - cuts[k]
                hashes, begins = shingle_sets(Texts.of(table.slice(first_row, n_rows), "id", "text"), n)
                # an id that several rows bear brings all their texts; only that of the node counts
                mine = set_keys(hashes, begins).view(np.int64) == node[first_row : first_row + n_rows]
                if not mine.all():
                    hashes, begins = hashes[np.repeat(mine, np.diff(begins))], np.concatenate([[0], np.cumsum(np.diff(begins)[mine])])
                places = np.concatenate([[0], np.cumsum(mine)])
                whose = first_row + np.nonzero(mine)[0]
                for lo, hi in zip(places[cuts[k:last] - first_row], places[cuts[k + 1 : last + 1] - first_row]):
                    own, rows_of = begins[lo : hi + 1], whose[lo:hi]
                    label = link_sets(hashes[own[0] : own[-1]], own - own[0], percent, upper[rows_of])
                    moved = np.nonzero(label != np.arange(hi - lo))[0]
                    out_a.append(node[rows_of][moved])
                    out_b.append(node[rows_of][label[moved]])
                k = last
        return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (out_a, out_b)], names=["a", "b"])

    sets = saved(rows.mapInArrow(scan, "id long, n_shingles long, node long"))
    shared = rows.mapInArrow(ask, "range int, sig binary, node binary").groupBy("range").applyInArrow(alone(meet), "sig long, node long, size long, agree long")
    commonest = Window.partitionBy("node", F.col("sig").bitwiseAND(CLASS)).orderBy(F.desc("size"), F.desc("sig"))
    shared = saved(shared.withColumn("place", F.row_number().over(commonest)).where("place >= agree").select("sig", "node"))
    least_node = shared.groupBy("sig").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sig", "b")
    coarse = components(shared.join(least_node, "sig").select(F.col("node").alias("a"), "b")).withColumnRenamed("component", "coarse")
    first = sets.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("node").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"))
    coarse = saved(coarse.join(first, "node"))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / most_together, F.sum("n") / (4096 * most_together))).cast("int")
    large = coarse.groupBy("coarse").agg(parts.alias("parts")).where("parts > 1").select("coarse", F.lit(True).alias("large"))
    kind = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * 1.000001)).cast("int")
    members = coarse.join(large, "coarse", "left").withColumn("own", F.when(F.col("large"), kind).otherwise(-1))
    members = members.withColumn("block", F.explode(F.when(F.col("large"), F.array(F.col("own"), F.col("own") + 1)).otherwise(F.array(F.lit(-1))))).withColumn("upper", F.col("block") == F.col("own"))
    blocks = members.groupBy("coarse", "block").agg(F.count(F.lit(1)).alias("size"), F.max("upper").alias("any"), parts.alias("parts")).where("any and size > 1")
    members = members.join(blocks.select("coarse", "block", "parts"), ["coarse", "block"])
    members = saved(members.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select("coarse", "block", "upper", "node", "id", "parts", "part"))
    n_members, n_copies = members.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.col("parts") - 1, F.lit(1))), F.lit(0))).first()
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part")))
    texts = rows.where(F.col("id").isNotNull()).join(F.broadcast(members) if n_members <= broadcast_rows else members, "id")
    texts = texts.withColumn("other", F.explode(others)).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    bins = max(1, n_copies // 200)
    texts = texts.withColumn("bin", F.pmod(F.xxhash64("coarse", "block", "i", "j"), F.lit(bins))).select("bin", "coarse", "block", "i", "j", "upper", "node", "id", "text")
    links = texts.groupBy("bin").applyInArrow(alone(link), "a long, b long")
    joined = components(links)
    placed = saved(sets.join(joined, "node", "left").withColumn("component", F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component", "node"))))
    least = placed.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("id").alias("component_id"))
    return placed.join(least, "component", "left").select(F.col("id").alias(id_column), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
