"""Removal of word sequences that an earlier document holds too.

Pass one fills count-min sketches of the windows of each group of documents
and merges them; a window whose merged count is below two is in one document
only, and the sketch never counts too few. Pass two groups, exactly, the
windows that are estimated repeated, and tells each group which of its windows
a smaller id has elsewhere.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.chunks import alone
from quernel.llm.exchange import Deal, Rolling, Texts, flagged_columns, pack, pack_flags, pack_sorted, ranges, sketch, unpack, unpack_flags, unpack_sorted

#: The bytes between words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_bytes, _words = (Rolling(11), Rolling(12)), (Rolling(21), Rolling(22))
#: Binary places of the sketch's width beyond those of the number of windows.
SPARE_BITS = 5


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of some texts, and which text each is in."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    space = SPACE[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[0], before[1:], after[-1], after[:-1] = True, space[:-1], True, space[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    starts, ends = np.nonzero(~space & before)[0], np.nonzero(~space & after)[0] + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def windows(texts: Texts, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, document and first word of every window of a group, and the words before each document.

    A window's words are one document's. Documents whose id is null have none.
    """
    out, base, counts = [], 0, np.zeros(len(texts), np.int64)
    for first, last in texts.chunks():
        lo, hi = texts.offsets[first], texts.offsets[last]
        starts, ends, doc = word_places(texts.data[lo:hi], texts.offsets[first : last + 1] - lo)
        counts[first:last] = np.bincount(doc, minlength=last - first)
        at = np.nonzero(doc[: len(doc) - length + 1] == doc[length - 1 :])[0] if len(doc) >= length else np.zeros(0, np.int64)
        at = at[texts.known[first:last][doc[at]]]
        hashes = []
        for of_bytes, of_words in zip(_bytes, _words):
            each = of_bytes.stretch(of_bytes.sums(of_bytes.of_byte[texts.data[lo:hi]]), starts, ends)
            hashes.append(of_words.stretch(of_words.sums(each), at, at + length))
        out.append((*hashes, doc[at] + first, at + base))
        base += len(doc)
    h1, h2, doc, at = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    return h1, h2, doc, at, np.concatenate([[0], np.cumsum(counts)])


def repeated_words(docs: DataFrame, length: int = 13, id_column: str = "doc_id", text_column: str = "text", kept_to: str = "kept", group_bytes: int = 8 << 20) -> DataFrame:
    """docs with n_words, n_removed and the kept words joined by one space.

    A word is removed if a window of `length` words that covers it also starts
    in a document with a smaller id. Rows with equal ids don't remove from one
    another, rows with a null id neither lose words nor take any, a null text
    has no words. All columns of docs stay; those that bear the names of the
    results are replaced. Windows are told apart by 96 bits of two hashes.

    The texts are shuffled once and read from that shuffle by each of three
    steps. A group's windows travel as sketch columns of about two bytes and
    then, if repeated, as keys; a hot window comes once from each group.
    """
    names = ("n_words", "n_removed", kept_to)
    docs = docs.select(*[c for c in docs.columns if c not in names])
    deal = Deal.of(docs, text_column, group_bytes)
    n, bits = deal.groups, min(40, max(16, (deal.total_bytes // 6).bit_length() + SPARE_BITS))
    rows = deal.dealt(docs, id_column, text_column)

    def ask(table: pa.Table) -> pa.Table:
        group = table.column("\x01group")[0].as_py()
        h1, h2, doc, _, _ = windows(Texts.of(table, id_column, text_column), length)
        out: list[tuple] = []
        for row, hashes in enumerate((h1, h2)):
            columns, twice = sketch(hashes, doc, bits)
            out += [(row, b, group, pack_sorted(columns[lo:hi]), pack_flags(twice[lo:hi])) for b, lo, hi in ranges(columns, bits, n)]
        return pa.Table.from_pylist([dict(zip(asked.names, x)) for x in out], asked)

    def merge(table: pa.Table) -> pa.Table:
        flags = flagged_columns(list(zip(table.column("columns").to_pylist(), table.column("twice").to_pylist())))
        return pa.table([table.column("row"), table.column("range"), table.column("\x01group"), pa.array([pack_flags(f) for f in flags], pa.binary()), pa.array([len(f) for f in flags], pa.int64())], answered)

    def ask_exactly(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return pa.Table.from_pylist([], exact)
        group, texts = table.column("\x01group")[0].as_py(), Texts.of(table, id_column, text_column)
        h1, h2, doc, _, _ = windows(texts, length)
        often = np.ones(len(h1), bool)
        found = {(r, b): unpack_flags(f, k) for r, b, f, k in zip(*(answers.column(c).to_pylist() for c in ("row", "range", "often", "n")))}
        for row, hashes in enumerate((h1, h2)):
            columns, _ = sketch(hashes, doc, bits)
            flags = np.concatenate([np.zeros(0, bool), *(found[row, b] for b, _, _ in ranges(columns, bits, n))])
            often &= flags[np.searchsorted(columns, hashes >> np.uint64(64 - bits))] if len(columns) else False
        h1, h2, ids = h1[often], h2[often] >> np.uint64(32), texts.ids[doc[often]]
        first = least(h1, h2, ids)
        h1, h2, ids = h1[first], h2[first], ids[first]
        out = [(b, group, pack_sorted(h1[lo:hi]), pack(h2[lo:hi]), int(ids[lo:hi].min()), pack((ids[lo:hi] - ids[lo:hi].min()).astype(np.uint64))) for b, lo, hi in ranges(h1, 64, n)]
        return pa.Table.from_pylist([dict(zip(exact.names, x)) for x in out], exact)

    def group_exactly(table: pa.Table) -> pa.Table:
        parts = [(unpack_sorted(a), unpack(b), unpack(d).astype(np.int64) + base) for a, b, d, base in zip(*(table.column(c).to_pylist() for c in ("h1", "h2", "ids", "least_id")))]
        h1, h2, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, h2, h1))
        new = changes(h1[order], h2[order])
        owner = ids[order][np.nonzero(new)[0]][np.cumsum(new) - 1]
        foreign = np.zeros(len(ids), bool)
        foreign[order] = ids[order] > owner
        at, out = 0, []
        for group, (a, b, _) in zip(table.column("\x01group").to_pylist(), parts):
            f = foreign[at : at + len(a)]
            at += len(a)
            if f.any():
                out.append((group, pack_sorted(a[f]), pack(b[f])))
        return pa.Table.from_pylist([dict(zip(told.names, x)) for x in out], told)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = Texts.of(table, id_column, text_column)
        h1, h2, doc, at, before = windows(texts, length)
        h2, ids = h2 >> np.uint64(32), texts.ids[doc]
        gone = foreign_keys(h1, h2, answers)
        order = np.lexsort((ids, h2, h1))
        new = changes(h1[order], h2[order])
        owner = ids[order][np.nonzero(new)[0]][np.cumsum(new) - 1] if len(ids) else ids
        gone[order] |= ids[order] > owner
        cover = np.zeros(before[-1] + 1, np.int64)
        np.add.at(cover, at[gone], 1)
        np.add.at(cover, at[gone] + length, -1)
        keep = np.cumsum(cover)[:-1] == 0
        n_words = np.diff(before)
        lost = n_words - np.diff(np.concatenate([[0], np.cumsum(keep)])[before])
        kept = []
        for i in range(len(texts)):
            words = texts.text(i).split()
            kept.append(b" ".join(compress(words, keep[before[i] : before[i + 1]]) if lost[i] else words))
        own = table.drop_columns(["\x01group"])
        return own.append_column("n_words", pa.array(n_words)).append_column("n_removed", pa.array(lost)).append_column(kept_to, pa.array(kept, pa.binary()).cast(pa.string()))

    asked = pa.schema([("row", pa.int32()), ("range", pa.int32()), ("\x01group", pa.int32()), ("columns", pa.binary()), ("twice", pa.binary())])
    answered = pa.schema([("row", pa.int32()), ("range", pa.int32()), ("\x01group", pa.int32()), ("often", pa.binary()), ("n", pa.int64())])
    exact = pa.schema([("range", pa.int32()), ("\x01group", pa.int32()), ("h1", pa.binary()), ("h2", pa.binary()), ("least_id", pa.int64()), ("ids", pa.binary())])
    told = pa.schema([("\x01group", pa.int32()), ("h1", pa.binary()), ("h2", pa.binary())])
    ddl = {id(asked): "row int, range int, `\x01group` int, columns binary, twice binary", id(answered): "row int, range int, `\x01group` int, often binary, n long", id(exact): "range int, `\x01group` int, h1 binary, h2 binary, least_id long, ids binary", id(told): "`\x01group` int, h1 binary, h2 binary"}
    by_group = rows.groupBy("\x01group")
    sketches = by_group.applyInArrow(alone(ask), ddl[id(asked)])
    often = sketches.groupBy("row", "range").applyInArrow(alone(merge), ddl[id(answered)])
    keys = by_group.cogroup(often.groupBy("\x01group")).applyInArrow(alone(ask_exactly), ddl[id(exact)])
    owners = keys.groupBy("range").applyInArrow(alone(group_exactly), ddl[id(told)])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return by_group.cogroup(owners.groupBy("\x01group")).applyInArrow(alone(remove), f"{fields}, n_words long, n_removed long, `{kept_to}` string")


def changes(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Where a new key begins among ordered ones."""
    if not len(h1):
        return np.zeros(0, bool)
    return np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])


def least(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of each key's entry with the least id, keys ascending."""
    order = np.lexsort((ids, h2, h1))
    return order[changes(h1[order], h2[order])]


def foreign_keys(h1: np.ndarray, h2: np.ndarray, answers: pa.Table) -> np.ndarray:
    """Which keys the answers name."""
    if not len(answers) or not len(h1):
        return np.zeros(len(h1), bool)
    a = np.concatenate([unpack_sorted(x) for x in answers.column("h1").to_pylist()])
    b = np.concatenate([unpack(x) for x in answers.column("h2").to_pylist()])
    pair = np.dtype([("a", "<u8"), ("b", "<u8")])
    both = np.unique(np.rec.fromarrays([a, b], dtype=pair)) if len(np.unique(a)) != len(a) else None
    order = np.argsort(a)
    a, b = a[order], b[order]
    if both is not None:
        return np.isin(np.rec.fromarrays([h1, h2], dtype=pair), both)
    at = np.minimum(np.searchsorted(a, h1), len(a) - 1)
    return (a[at] == h1) & (b[at] == h2)


def repeats_digest(docs: DataFrame, length: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of all docs."""
    found = repeated_words(docs.select("doc_id", "text"), length)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
