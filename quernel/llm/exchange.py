"""Questions and answers between groups of documents and ranges of keys.

Documents are dealt into groups of bounded size. A group sends what it knows
of its windows to ranges of hashes, packed into one binary value a range; a
range merges what it gets and answers each group, packed again. So a window is
a few bytes in a shuffle and no row of its own, and a window that a third of
all documents hold comes once from each group at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Made once a process; making one takes longer than a small blob.
_compressor, _decompressor = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
GROUP_BYTES = 8 << 20
MANY_GROUPS = 256
ROW_BYTES = 64


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as bytes: only as many bytes each as the greatest needs, by place, compressed."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + _compressor.compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(_decompressor.decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers, as their differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def pack_flags(flags: np.ndarray) -> bytes:
    return _compressor.compress(np.packbits(flags).tobytes())


def unpack_flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(_decompressor.decompress(data), np.uint8), count=n).astype(bool)


def ranges(keys: np.ndarray, bits: int, n: int) -> list[tuple[int, int, int]]:
    """Which of n equal ranges of all values of `bits` bits hold some of ascending keys: (range, first, last + 1) of each that does.

    The work follows the keys, however many ranges there are.
    """
    if not len(keys):
        return []
    top = keys >> np.uint64(bits - 32) if bits >= 32 else keys << np.uint64(32 - bits)
    which = (top * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    first = np.nonzero(np.concatenate([[True], which[1:] != which[:-1]]))[0]
    return list(zip(which[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]))


@dataclass(frozen=True)
class Deal:
    """How many groups and ranges there are, and the bytes of all texts."""

    groups: int
    total_bytes: int

    @classmethod
    def of(cls, docs: DataFrame, text_column: str = "text", group_bytes: int = GROUP_BYTES, most_bytes: int | None = None) -> Deal:
        """Groups of group_bytes; where that makes more than MANY_GROUPS, of more, up to most_bytes."""
        n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_column))).first()
        total = n * ROW_BYTES + (size or 0)
        most = max(group_bytes, min(most_bytes or 0, -(-total // MANY_GROUPS)))
        return cls(max(1, -(-total // most)), size or 0)

    def dealt(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """docs with \x01group, by the id and text together, so that a hot id or text alone makes no hot group."""
        return docs.withColumn("\x01group", F.pmod(F.xxhash64(id_column, text_column), F.lit(self.groups)).cast("int"))


@dataclass
class Texts:
    """The texts of a group: all bytes, where each text begins and ends, and the ids."""

    data: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray
    known: np.ndarray  # whether the id is not null

    @classmethod
    def of(cls, table: pa.Table, id_column: str, text_column: str) -> Texts:
        column = table.column(text_column).cast(pa.large_string()).fill_null("").combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
        ids = table.column(id_column).cast(pa.int64())
        return cls(data, offsets - offsets[0], ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy())

    def __len__(self) -> int:
        return len(self.ids)

    def chunks(self, size: int = 1 << 20):
        """Runs of whole texts of about `size` bytes: (first, last) of each."""
        first = 0
        while first < len(self):
            last = max(first + 1, int(np.searchsorted(self.offsets, self.offsets[first] + size, "right")) - 1)
            last = min(last, len(self))
            yield first, last
            first = last

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Rolling:
    """Hashes of stretches of a sequence of 64-bit values, from running sums of a polynomial."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.of_byte = rng.integers(1, (1 << 64) - 1, 256, np.uint64)
        self.base = np.uint64(int(rng.integers(1 << 60)) * 8 + 5)
        self.back = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.backs = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, step in (("powers", self.base), ("backs", self.back)):
                values = np.full(n, step, np.uint64)
                values[0] = 1
                setattr(self, name, np.multiply.accumulate(values))

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def stretch(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of values[start:end]."""
        return mixed((sums[ends] - sums[starts]) * self.backs[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    """The hash with its bits spread."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def flagged_columns(blobs: list[tuple[bytes, bytes]]) -> list[np.ndarray]:
    """Merge sparse sketches of one range: which columns of each have a total of two or more.

    A blob holds the ascending columns of a group's sketch and flags for those
    that the group itself counts twice or more.
    """
    columns = [unpack_sorted(c) for c, _ in blobs]
    counts = [1 + unpack_flags(f, len(c)).astype(np.int64) for c, (_, f) in zip(columns, blobs)]
    every = np.concatenate(columns) if columns else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(every) else np.zeros(0, bool)
    run = np.cumsum(first) - 1
    total = np.bincount(run, np.concatenate(counts)[order]) if len(every) else np.zeros(0)
    often = np.zeros(len(every), bool)
    often[order] = total[run] >= 2
    return np.split(often, np.cumsum([len(c) for c in columns])[:-1]) if columns else []


def sketch(hashes: np.ndarray, docs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """One row of a count-min sketch of a group, sparse: its columns, and which count two documents or more."""
    keys = (hashes >> np.uint64(64 - bits) << np.uint64(24)) | docs.astype(np.uint64)
    keys.sort()
    columns = keys >> np.uint64(24)
    first = np.concatenate([[True], columns[1:] != columns[:-1]]) if len(keys) else np.zeros(0, bool)
    last = np.concatenate([columns[1:] != columns[:-1], [True]]) if len(keys) else np.zeros(0, bool)
    return columns[first], keys[first] != keys[last]
