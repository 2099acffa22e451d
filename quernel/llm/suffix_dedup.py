"""Removal of byte strings that an earlier document holds too, by suffix arrays.

Every string of 50 bytes has an anchor: its 24-byte part of least hash. Anchors
depend on the string alone, so equal strings have equal anchors, in the same
place of the string. Anchors that only one document has are set aside by a
merged sketch; the stretches of text around the others are dealt into shards by
their anchors. Each shard sorts the suffixes that begin at anchors, and the
reversed texts before anchors, and takes common prefixes of neighbours: a sparse
suffix array either way. Strings are equal if both their parts are, and so the
least id of each is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.exchange import Deal, Rolling, Texts, flagged_columns, mixed, pack, pack_flags, pack_sorted, ranges, sketch, unpack, unpack_flags, unpack_sorted

_bytes = Rolling(31)
PLACE_BITS = 28
SPARE_BITS = 8
GROUP_BYTES, MOST_BYTES = 4 << 20, 16 << 20
SHARD_BYTES = 5 << 20
CHUNK_BYTES = 1 << 17  # what is worked on at once stays in a core's cache


# Suffix arrays


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out |= padded[j : j + len(text)] << np.uint64(56 - 8 * j)
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by Larsson-Sadakane refinement.

    After an initial order by eight bytes, only groups that are still tied are
    ordered again, by the rank of the suffix that far on; the distance doubles
    each round, until none is tied.
    """
    n = len(text)
    first = eight_bytes(text)
    if text[-8:].all():
        sa = np.argsort(first).astype(np.int32)
        ordered, left = first[sa], np.zeros(n, np.int8)
    else:  # zero bytes at the end look like what follows it; the shorter suffix comes first
        left = np.minimum(n - np.arange(n), 8).astype(np.int8)
        sa = np.lexsort((left, first)).astype(np.int32)
        ordered, left = first[sa], left[sa]
    if not n:
        return sa
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]) | (left[1:] != left[:-1])])
    del first, ordered, left
    starts = np.nonzero(new)[0].astype(np.int32)
    rank = np.empty(n + 1, np.int32)
    rank[sa], rank[n] = starts[np.cumsum(new, dtype=np.int32) - 1], -1
    at, sizes = np.arange(n, dtype=np.int32), np.diff(np.append(starts, n))
    del new, starts
    h = 8
    while True:
        at = at[np.repeat(sizes > 1, sizes)]  # places of suffixes that are still tied
        if not len(at):
            return sa
        suffix = sa[at]
        key = (rank[suffix].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(suffix + h, n)] + 1).astype(np.uint64)
        order = np.argsort(key)
        key, suffix = key[order], suffix[order]
        sa[at] = suffix
        new = np.concatenate([[True], key[1:] != key[:-1]])
        heads = np.nonzero(new)[0]
        rank[suffix] = at[heads][np.cumsum(new) - 1]
        sizes = np.diff(np.append(heads, len(at)))
        h *= 2


def common_prefixes(text: np.ndarray, sa: np.ndarray, limit: int, lane: int = 256) -> np.ndarray:
    """How many bytes, up to `limit`, each suffix shares with the one before it in sa.

    Kasai's algorithm: going through the text, a suffix shares with its
    neighbour at most one byte fewer than the suffix before did with its own.
    Many stretches of the text are gone through side by side.
    """
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    eight = np.append(eight_bytes(text), np.zeros(limit + 9, np.uint64))
    shared = np.zeros(n, np.int32)
    starts = np.arange(0, n, lane)
    h = np.zeros(len(starts), np.int64)
    for k in range(min(lane, n)):
        i = starts + k
        if i[-1] >= n:
            i, h = i[:-1], h[:-1]
            starts = starts[:-1]
        j = before[i]
        h = np.where(j < 0, 0, np.maximum(h - 1, 0))
        go = np.nonzero(j >= 0)[0]
        while len(go):
            a, b = i[go] + h[go], j[go] + h[go]
            differs = eight[a] ^ eight[b]
            top = np.frexp((differs & ~(differs >> np.uint64(1))).astype(float))[1]  # place of the highest bit; the next is cleared, so nothing rounds up
            more = np.minimum((64 - top) // 8, n - np.maximum(a, b))
            h[go] += more
            go = go[(more == 8) & (h[go] < limit)]
        h = np.minimum(h, limit)
        shared[i] = h
    out = shared[sa]
    out[:1] = 0
    return out


def suffixes_in_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, and how many bytes each shares with the one before it: a suffix array of chosen places."""
    width = rows.shape[1]
    padded = np.zeros((len(rows), max(1, -(-width // 8)) * 8), np.uint8)
    padded[:, :width] = rows
    order = np.lexsort(padded.view(">u8").astype(np.uint64).T[::-1])
    differs = padded[order[1:]] != padded[order[:-1]]
    shared = np.zeros(len(rows), np.int64)
    shared[1:] = np.where(differs.any(1), differs.argmax(1), width)
    return order, shared


def anchored_owners(data: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, ids: np.ndarray, length: int, part: int) -> np.ndarray:
    """Of every string of `length` bytes in stretches of data, one stretch after another: the least id of those equal to it.

    A stretch is `size` bytes from `begin`; all its strings have the anchor at
    `place` of it. A string with o bytes before its anchor equals another one
    if the suffixes at the anchors share length - o bytes, and the reversed
    texts before them share o. What a row holds outside its stretch is not
    asked for.
    """
    reach, count = length - part, size - length + 1
    around = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(length, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(around, reach + length)[begin + place]
    order, right = suffixes_in_order(rows[:, reach:])
    rows, place, ids, count, at = rows[order], place[order], ids[order], count[order], (np.cumsum(count) - count)[order]
    order, left = suffixes_in_order(rows[:, reach - 1 :: -1] if reach else rows[:, :0])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    owner = np.empty(int(count.sum()), np.int64)
    for o in range(reach + 1):
        mine = np.nonzero((place >= o) & (place - count < o))[0]
        if not len(mine):
            continue
        key = np.cumsum(right < length - o)[mine] << 32 | np.cumsum(left < o)[rank[mine]]
        by = np.argsort(key)
        key, mine = key[by], mine[by]
        heads = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        owner[at[mine] + place[mine] - o] = np.repeat(np.minimum.reduceat(ids[mine], heads), np.diff(np.append(heads, len(mine))))
    return owner


# Anchors


def blocks(texts: Texts, length: int, part: int) -> tuple[np.ndarray, ...]:
    """Runs of strings of `length` bytes that share an anchor: first start, number, document, place of the anchor from the first start, its hash, hash of all their bytes.

    Documents whose id is null have none.
    """
    out = []
    for first, last in texts.chunks(CHUNK_BYTES):
        lo, hi = int(texts.offsets[first]), int(texts.offsets[last])
        n = hi - lo
        if n < length:
            continue
        if n >> PLACE_BITS:
            raise ValueError(f"a text of {n} bytes is longer than 2^{PLACE_BITS}")
        sums = _bytes.sums(_bytes.of_byte[texts.data[lo:hi]])
        h = (sums[part:] - sums[: n - part + 1]) * _bytes.backs[: n - part + 1]
        m = (h >> np.uint64(PLACE_BITS + 1) << np.uint64(PLACE_BITS)).view(np.int64) | np.arange(n - part + 1)  # signed numbers are compared faster
        span, reach = length - part + 1, 1
        while 2 * reach <= span:
            m = np.minimum(m[:-reach], m[reach:])
            reach *= 2
        if span > reach:
            m = np.minimum(m[: len(m) - (span - reach)], m[span - reach :])
        ends = texts.offsets[first + 1 : last + 1] - lo
        ok = np.ones(n, bool)
        short = (ends[:, None] - np.arange(1, length)).reshape(-1)
        ok[short[short >= 0]] = False  # a text's last places, or all of a short one
        ok = ok[: len(m)]
        new = ok.copy()
        new[1:] &= (m[1:] != m[:-1]) | ~ok[:-1]
        final = ok.copy()
        final[:-1] &= new[1:] | ~ok[1:]
        start = np.nonzero(new)[0]
        if not len(start):
            continue
        count, a = np.nonzero(final)[0] - start + 1, m[start] & ((1 << PLACE_BITS) - 1)
        doc = np.searchsorted(ends, start, "right") + first
        keep = texts.known[doc]
        start, count, doc, a = start[keep], count[keep], doc[keep], a[keep]
        out.append((start + lo, count.astype(np.int32), doc.astype(np.int32), (a - start).astype(np.int32), mixed(mixed(h[a])), _bytes.stretch(sums, start, start + (count + length - 1))))  # least hashes are small; mixed they fill all ranges alike
    if not out:
        return (np.zeros(0, np.int64),) + (np.zeros(0, np.int32),) * 3 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*out))


def least_of_equal(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each key the least id beside an equal one."""
    order = np.argsort(keys)
    k = keys[order]
    heads = np.nonzero(np.concatenate([[True], k[1:] != k[:-1]])[: len(k)])[0]
    least = np.empty(len(k), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], heads), np.diff(np.append(heads, len(k)))) if len(k) else 0
    return least


def one_each(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where each distinct key is with its least id, in order of keys."""
    order = np.lexsort((ids, keys))
    k = keys[order]
    return order[np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]]


def places_among(keys: np.ndarray, values: np.ndarray, bits: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Which of values are among ascending keys, and where there."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    some = np.zeros(1 << bits, bool)  # by their first bits most of the others fall out
    some[keys >> np.uint64(64 - bits)] = True
    which = np.nonzero(some[values >> np.uint64(64 - bits)])[0]
    at = np.minimum(np.searchsorted(keys, values[which]), len(keys) - 1)
    met = keys[at] == values[which]
    return which[met], at[met]


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of data one after another."""
    return data[stretches_of(starts, sizes)]


def stretches_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Named:
    """The stretches that the groups of a range name, entry by entry, those of a group one after another.

    first: of each distinct stretch the entry with the least id, in order of
    anchors; which: the distinct stretch of each entry; shared: whether the
    anchor of a distinct stretch is named by several entries. What is shared
    goes through the suffix arrays, a copy of each distinct stretch; a stretch
    that one group alone names, and no other beside it, has no string in common
    with other groups, and its own copies are settled in the group.
    """

    @classmethod
    def of(cls, table: pa.Table) -> Named:
        self = cls()
        self.groups = table.column("\x01group").to_pylist()
        anchors = [unpack_sorted(x) for x in table.column("anchor").to_pylist()]
        none = np.zeros(0, np.uint64)
        self.anchor = np.concatenate([none, *anchors])
        self.stretch = np.concatenate([none, *[np.frombuffer(x, np.uint64) for x in table.column("stretch").to_pylist()]])
        self.ids = np.concatenate([none.astype(np.int64), *[unpack(x).astype(np.int64) + b for x, b in zip(table.column("ids").to_pylist(), table.column("least_id").to_pylist())]])
        self.of = np.repeat(np.arange(len(anchors)), [len(a) for a in anchors])
        order = np.lexsort((self.ids, self.stretch, self.anchor))
        a, s = self.anchor[order], self.stretch[order]
        new_a = np.concatenate([[True], a[1:] != a[:-1]])[: len(a)]
        new_s = new_a | np.concatenate([[True], s[1:] != s[:-1]])[: len(a)]
        self.first = order[new_s]
        self.which = np.empty(len(a), np.int64)
        self.which[order] = np.cumsum(new_s) - 1
        self.shared = np.bincount(np.cumsum(new_a) - 1)[np.cumsum(new_a)[new_s] - 1] > 1 if len(a) else np.zeros(0, bool)
        return self

    def by_group(self, entries: np.ndarray):
        """Ascending entries by group: (group, its entries) of each that has some."""
        of = self.of[entries]
        first = np.nonzero(np.concatenate([[True], of[1:] != of[:-1]])[: len(of)])[0].tolist()
        for lo, hi in zip(first, [*first[1:], len(of)]):
            yield self.groups[of[lo]], entries[lo:hi]


def columns_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema)


def repeated_bytes(docs: DataFrame, length: int = 50, part: int = 24, id_column: str = "doc_id", text_column: str = "text", kept_to: str = "kept", group_bytes: int = GROUP_BYTES, shard_bytes: int = SHARD_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal removed runs) and the kept bytes.

    A byte of a text's UTF-8 is removed if a string of `length` bytes that
    covers it also starts in a document with a smaller id. Rows with equal ids
    don't remove from one another, rows with a null id neither lose nor take
    bytes, a null text is empty. All columns of docs stay; those that bear the
    names of the results are replaced. kept is binary: a removed run may end
    inside a character.

    The texts are shuffled once and read from that shuffle by each of four
    steps. A stretch of text is named once by each group that has it and sent
    by one of them if its anchor is named more than once, so what a hot passage
    adds is bounded by the number of groups. Stretches are told apart by the
    hashes of their anchor and of their bytes, 128 bits; in a group by 64. As
    groups and ranges meet in pairs, groups of large tables are larger, up to
    most_bytes. Of a shard, whole anchors of about shard_bytes are sorted at once.
    """
    names = ("n_bytes", "n_removed", "n_spans", kept_to)
    docs = docs.select(*[c for c in docs.columns if c not in names])
    deal = Deal.of(docs, text_column, group_bytes, most_bytes)
    n, bits = deal.groups, min(40, max(16, (deal.total_bytes // 14).bit_length() + SPARE_BITS))
    rows = deal.dealt(docs, id_column, text_column)

    def ask(table: pa.Table) -> pa.Table:
        group = table.column("\x01group")[0].as_py()
        _, _, doc, _, anchor, _ = blocks(Texts.of(table, id_column, text_column), length, part)
        columns, twice = sketch(anchor, doc, bits)
        out = [(b, group, pack_sorted(columns[lo:hi]), pack_flags(twice[lo:hi])) for b, lo, hi in ranges(columns, bits, n)]
        return columns_of(out, asked)

    def merge(table: pa.Table) -> pa.Table:
        flags = flagged_columns(list(zip(table.column("columns").to_pylist(), table.column("twice").to_pylist())))
        return pa.table([table.column("range"), table.column("\x01group"), pa.array([pack_flags(f) for f in flags], pa.binary()), pa.array([len(f) for f in flags], pa.int64())], answered)

    def flagged(table: pa.Table, answers: pa.Table):
        """Of the stretches of a group whose anchor is repeated: id, anchor, stretch."""
        texts = Texts.of(table, id_column, text_column)
        _, _, doc, _, anchor, stretch = blocks(texts, length, part)
        order = np.argsort(anchor)
        column = anchor[order] >> np.uint64(64 - bits)
        heads = np.nonzero(np.concatenate([[True], column[1:] != column[:-1]])[: len(column)])[0]
        found = {b: unpack_flags(f, k) for b, f, k in zip(*(answers.column(c).to_pylist() for c in ("range", "often", "n")))}
        flags = np.concatenate([np.zeros(0, bool), *[found[b] for b, _, _ in ranges(column[heads], bits, n)]])
        often = order[np.repeat(flags, np.diff(np.append(heads, len(column))))]
        return texts.ids[doc[often]], anchor[often], stretch[often]

    def name(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if len(table):
            group = table.column("\x01group")[0].as_py()
            ids, anchor, stretch = flagged(table, answers)
            pick = one_each(stretch, ids)
            pick = pick[np.argsort(anchor[pick])]
            ids, anchor, stretch = ids[pick], anchor[pick], stretch[pick]
            for b, lo, hi in ranges(anchor, 64, n):
                least = int(ids[lo:hi].min())
                out.append((b, group, pack_sorted(anchor[lo:hi]), stretch[lo:hi].tobytes(), least, pack((ids[lo:hi] - least).astype(np.uint64))))
        return columns_of(out, named)

    def choose(table: pa.Table) -> pa.Table:
        named_ = Named.of(table)
        out = [(g, pack_sorted(np.sort(named_.stretch[e]))) for g, e in named_.by_group(np.sort(named_.first[named_.shared]))]
        return columns_of(out, chosen)

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if len(table) and len(answers):
            keys = np.sort(np.concatenate([unpack_sorted(x) for x in answers.column("stretch").to_pylist()]))
            group, texts = table.column("\x01group")[0].as_py(), Texts.of(table, id_column, text_column)
            start, count, doc, place, anchor, stretch = blocks(texts, length, part)
            mine, _ = places_among(keys, stretch)
            pick = mine[one_each(stretch[mine], texts.ids[doc[mine]])]
            pick = pick[np.argsort(anchor[pick])]
            start, count, place, own, anchor, stretch = start[pick], count[pick], place[pick], texts.ids[doc[pick]], anchor[pick], stretch[pick]
            for b, lo, hi in ranges(anchor, 64, n):
                body = zstandard.ZstdCompressor(level=1).compress(gathered(texts.data, start[lo:hi], count[lo:hi].astype(np.int64) + (length - 1)).tobytes())
                least = int(own[lo:hi].min())
                out.append((b, group, body, pack(count[lo:hi].astype(np.uint64)), pack(place[lo:hi].astype(np.uint64)), stretch[lo:hi].tobytes(), least, pack((own[lo:hi] - least).astype(np.uint64))))
        return columns_of(out, sent)

    def shard(requests: pa.Table, bodies: pa.Table) -> pa.Table:
        out = []
        if len(bodies):
            names_ = Named.of(requests)
            data = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8) for x in bodies.column("body").to_pylist()])
            count, place = (np.concatenate([unpack(x).astype(np.int64) for x in bodies.column(c).to_pylist()]) for c in ("counts", "places"))
            stretch = np.concatenate([np.frombuffer(x, np.uint64) for x in bodies.column("stretch").to_pylist()])
            own = np.concatenate([unpack(x).astype(np.int64) + b for x, b in zip(bodies.column("ids").to_pylist(), bodies.column("least_id").to_pylist())])
            size = count + (length - 1)
            begin, by = np.cumsum(size) - size, np.argsort(stretch)
            # the bodies of all that is shared, by their anchors; a run ends only where an anchor does, so no string is in two
            entry = names_.first[names_.shared]
            body = by[np.searchsorted(stretch[by], names_.stretch[entry])]
            begin, size, count, place, own, anchor = begin[body], size[body], count[body], place[body], own[body], names_.anchor[entry]
            head = np.maximum.accumulate(np.where(np.concatenate([[True], anchor[1:] != anchor[:-1]]), np.arange(len(anchor)), 0))
            run = (np.cumsum(size) - size)[head] // shard_bytes
            cuts = [0, *(np.nonzero(run[1:] != run[:-1])[0] + 1).tolist(), len(run)]
            owner = np.concatenate([anchored_owners(data, begin[lo:hi], size[lo:hi], place[lo:hi], own[lo:hi], length, part) for lo, hi in zip(cuts, cuts[1:])])
            first = np.cumsum(count) - count
            lowest = np.minimum.reduceat(owner, first)
            at = (np.cumsum(names_.shared) - 1)[names_.which]
            low = np.nonzero(names_.shared[names_.which])[0]
            low = low[lowest[at[low]] < names_.ids[low]]
            for group, e in names_.by_group(low):
                k = count[at[e]]
                out.append((group, names_.stretch[e].tobytes(), pack(k.astype(np.uint64)), pack_flags(gathered(owner, first[at[e]], k) < np.repeat(names_.ids[e], k))))
        return columns_of(out, told)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = Texts.of(table, id_column, text_column)
        start, count, doc, _, _, stretch = blocks(texts, length, part)
        ids = texts.ids[doc]
        whole = ids > least_of_equal(stretch, ids)
        step = np.zeros(len(texts.data) + 1, np.int8)
        step[start[whole]] += 1
        step[start[whole] + count[whole]] -= 1
        hit = np.cumsum(step, dtype=np.int8)[:-1].view(bool)  # whether a string that starts here is in a document with a smaller id
        del step
        if len(answers) and len(stretch):
            key = np.concatenate([np.frombuffer(x, np.uint64) for x in answers.column("stretch").to_pylist()])
            each = [unpack(x).astype(np.int64) for x in answers.column("counts").to_pylist()]
            lost = np.concatenate([unpack_flags(x, int(k.sum())) for x, k in zip(answers.column("lost").to_pylist(), each)])
            counts = np.concatenate(each)
            first, by = np.cumsum(counts) - counts, np.argsort(key)
            rest = np.nonzero(~whole)[0]  # those with the least id of the group, for which the ranges have judged
            told_, at = places_among(key[by], stretch[rest])
            told_, at = rest[told_], by[at]
            for lo in range(0, len(told_), 1 << 17):
                t, f = told_[lo : lo + (1 << 17)], first[at[lo : lo + (1 << 17)]]
                sizes = count[t].astype(np.int64)
                hit[stretches_of(start[t], sizes)[gathered(lost, f, sizes)]] = True
        removed, spans, kept = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
        for a, z in texts.chunks(CHUNK_BYTES):
            lo, hi = int(texts.offsets[a]), int(texts.offsets[z])
            bounds = texts.offsets[a : z + 1] - lo
            if not hit[lo:hi].any():
                kept += [texts.data[i:j].tobytes() for i, j in zip(bounds[:-1] + lo, bounds[1:] + lo)]
                continue
            sums = np.concatenate([np.zeros(length, np.int32), np.cumsum(hit[lo:hi], dtype=np.int32)])
            gone = sums[length:] > sums[:-length]  # no string goes beyond its document
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            heads = bounds[:-1][bounds[:-1] < len(gone)]
            opens[heads] = gone[heads]
            at, spans[a:z] = np.append(np.cumsum(gone, dtype=np.int32), 0), np.diff(np.searchsorted(np.nonzero(opens)[0], bounds))
            removed[a:z] = np.diff(at[bounds - 1])  # what is before 0 is at -1
            kept += [texts.data[lo + i : lo + j][~gone[i:j]].tobytes() if k else texts.data[lo + i : lo + j].tobytes() for i, j, k in zip(bounds[:-1], bounds[1:], removed[a:z])]
        own = table.drop_columns(["\x01group"])
        for name, values in (("n_bytes", np.diff(texts.offsets)), ("n_removed", removed), ("n_spans", spans)):
            own = own.append_column(name, pa.array(values, pa.int64()))
        return own.append_column(kept_to, pa.array(kept, pa.binary()))

    asked = pa.schema([("range", pa.int32()), ("\x01group", pa.int32()), ("columns", pa.binary()), ("twice", pa.binary())])
    answered = pa.schema([("range", pa.int32()), ("\x01group", pa.int32()), ("often", pa.binary()), ("n", pa.int64())])
    named = pa.schema([("range", pa.int32()), ("\x01group", pa.int32()), ("anchor", pa.binary()), ("stretch", pa.binary()), ("least_id", pa.int64()), ("ids", pa.binary())])
    chosen = pa.schema([("\x01group", pa.int32()), ("stretch", pa.binary())])
    sent = pa.schema([("range", pa.int32()), ("\x01group", pa.int32()), ("body", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("stretch", pa.binary()), ("least_id", pa.int64()), ("ids", pa.binary())])
    told = pa.schema([("\x01group", pa.int32()), ("stretch", pa.binary()), ("counts", pa.binary()), ("lost", pa.binary())])
    by_group = rows.groupBy("\x01group")
    sketches = by_group.applyInArrow(ask, "range int, `\x01group` int, columns binary, twice binary")
    often = sketches.groupBy("range").applyInArrow(merge, "range int, `\x01group` int, often binary, n long")
    names_of = by_group.cogroup(often.groupBy("\x01group")).applyInArrow(name, "range int, `\x01group` int, anchor binary, stretch binary, least_id long, ids binary").groupBy("range")
    senders = names_of.applyInArrow(choose, "`\x01group` int, stretch binary")
    stretches = by_group.cogroup(senders.groupBy("\x01group")).applyInArrow(send, "range int, `\x01group` int, body binary, counts binary, places binary, stretch binary, least_id long, ids binary")
    owners = names_of.cogroup(stretches.groupBy("range")).applyInArrow(shard, "`\x01group` int, stretch binary, counts binary, lost binary")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return by_group.cogroup(owners.groupBy("\x01group")).applyInArrow(remove, f"{fields}, n_bytes long, n_removed long, n_spans long, `{kept_to}` binary")


def repeats_digest(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of all docs."""
    found = repeated_bytes(docs.select("doc_id", "text"), length)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
