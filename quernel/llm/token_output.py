"""Token ids in a binary shard format with a shared compression dictionary.

A shard file holds a run of documents in ascending id order. Each document's
ids are one zstandard frame made with a dictionary that was trained on
serialized id arrays, so a short document can be read alone: the index at the
end of the file gives the place of each frame.

    magic "QTOK0001" | frames | index: n x (doc_id int64, frame start uint64,
    frame bytes uint32, tokens uint32) | dictionary sha256 (32 bytes) |
    trailer: index start uint64, n uint64, bytes an id (2 or 4) uint32, "QEND"

The dictionary is a file of its own, found by its hash.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.llm.chunks import Kept, chunks, held, splits_plainly
from quernel.llm.shared import hashed_sample, new_folder, split_count, text_bytes

MAGIC, END = b"QTOK0001", b"QEND"
INDEX = np.dtype([("doc_id", "<i8"), ("start", "<u8"), ("bytes", "<u4"), ("tokens", "<u4")])
TRAILER = struct.Struct("<QQI4s")
#: What stands for a null id in an index; it sorts last.
NO_ID = (1 << 63) - 1
#: A word of Latin letters, perhaps after a space and with a mark after it: one match of the pattern, or two.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)").fullmatch


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one beyond the bytes."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TextEncoder:
    """Encodes texts by a tokenizers file, remembering what recurring chunks and words give.

    A chunk that is one plain word goes straight to the tokenizer's model;
    any other goes through the whole tokenizer.
    """

    def __init__(self, path: str, most_kept: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.characters = self.tokenizer.model, byte_characters()
        self.kept, self.words = Kept(most_kept), Kept(most_kept // 3)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.feed = self._whole(["\n"])[0]
        self.marks = {"": b""} | {m: self._whole([m])[0] for m in ".,"}
        plain = ["", "Zoë", "straße"]  # a normalizer or another pattern would tell words apart
        self.plain = [self._word(" " + w) for w in plain[1:]] == self._whole([" " + w for w in plain[1:]]) and self._whole([" Zoë,"])[0] == self._word(" Zoë") + self.marks[","]
        if len(self.feed) != self.width:
            raise ValueError("a line feed must be one id")

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        return self._bytes([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.characters))])

    def _new(self, keys: set[str]) -> dict[str, bytes]:
        """What chunks encode to that the memory doesn't hold; see `serialized` for their keys."""
        made, rest, chunk_of = {}, [], {}
        older, words, plain, marks = self.kept.older, self.words, self.plain, self.marks
        for key in keys:
            if (x := older.get(key)) is not None:
                made[key] = x
                continue
            chunk, before = (key[1:], self.feed) if key[:1] == "\n" else (" " + key, b"")
            if plain and len(chunk) <= 64 and (m := _PLAIN(chunk)):
                word = m[1]
                if (x := words.get(word)) is None:
                    if (x := words.older.get(word)) is None:
                        x = self._word(word)
                    words.room(1)
                    words[word] = x
                made[key] = before + x + marks[m[2]]
            else:
                rest.append(chunk)
                chunk_of[key] = before
        for (key, before), x in zip(chunk_of.items(), self._whole(rest)):
            made[key] = before + x
        return made

    def serialized(self, text: str, last: tuple[int, ...] = ()) -> bytes:
        """The ids of a text and then `last`, as little-endian unsigned integers of `width` bytes.

        A chunk is a word with the space or the line feed before it. Its key is
        the word, after a space, and "\\n" and the word after a line feed.
        """
        if not splits_plainly(text):
            return b"".join(self._whole(chunks(text))) + self._bytes(last)
        parts = ("\n" + text).replace("\n", " \n").split(" ")
        del parts[0]
        found = list(map(self.kept.get, parts))
        if None in found:
            made = self._new({c for c, x in zip(parts, found) if x is None})
            found = [made[c] if x is None else x for c, x in zip(parts, found)]
            self.kept.room(len(made))
            self.kept.update((c, x) for c, x in made.items() if len(c) <= 64)
        return b"".join(found)[self.width :] + self._bytes(last)


def text_encoder(path: str) -> TextEncoder:
    """The encoder of a tokenizers file, made once a process."""
    return held(("tokens", path), lambda: TextEncoder(path))


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of at most `size` bytes; empty if there is too little to train on."""
    samples = [x for x in samples if len(x) >= 8]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def shard_bytes(doc_ids: list[int], frames: list[bytes], tokens: list[int], dictionary: bytes, width: int) -> bytes:
    index = np.zeros(len(frames), INDEX)
    sizes = np.array([len(f) for f in frames], "<u4")
    index["doc_id"], index["bytes"], index["tokens"] = doc_ids, sizes, tokens
    index["start"] = len(MAGIC) + np.concatenate([[0], np.cumsum(sizes[:-1], dtype="<u8")])[: len(frames)]
    body = b"".join([MAGIC, *frames])
    return b"".join([body, index.tobytes(), hashlib.sha256(dictionary).digest(), TRAILER.pack(len(body), len(frames), width, END)])


class ShardReader:
    """Reads documents of a shard file; `document(i)` reads the trailer, the index and one frame only."""

    def __init__(self, path: str, dictionary: bytes | Callable[[str], bytes]):
        """dictionary: the bytes, or what gives those of a hash in hexadecimal; the hash in the shard chooses."""
        fs, inner = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        at, n, self.width, end = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if end != END:
            raise ValueError(f"{path} is no whole shard")
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, at), INDEX)
        written_with = self.file.read_at(32, at + n * INDEX.itemsize)
        dictionary = dictionary(written_with.hex()) if callable(dictionary) else dictionary
        if written_with != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self._d = decompressor(dictionary)

    def document(self, i: int) -> np.ndarray:
        row = self.index[i]
        raw = self._d.decompress(self.file.read_at(int(row["bytes"]), int(row["start"])), max_output_size=int(row["tokens"]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def __len__(self) -> int:
        return len(self.index)


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    prepared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if prepared:
        prepared.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=prepared, write_checksum=False)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def put_file(path: str, data: bytes) -> None:
    """Write a file whole or not at all; tasks that run twice write the same."""
    fs, inner = pafs.FileSystem.from_uri(path)
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, inner)


def get_file(path: str) -> bytes:
    fs, inner = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(inner) as f:
        return f.read()


def write_token_shards(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text",
    shard_text_bytes: int = 8 << 20, dictionary_bytes: int = 65536, dictionary_rows: int = 1000, dictionary_row_bytes: int = 65536,
) -> DataFrame:
    """Write the ids of all texts, each followed by end_id, as shard files in ascending id order.

    Returns the manifest, a row a shard: shard (its place in the order), path,
    n_docs, n_tokens. It is kept in the folder as Parquet, with the dictionary.
    A null text counts as empty; equal ids come in the order of their texts'
    hashes; rows with a null id come last; an empty table gives an
    empty manifest; other columns aren't read.

    The dictionary alone comes from a bounded sample: about dictionary_rows
    rows chosen by hash, of at most dictionary_row_bytes bytes each. Documents
    are dealt by ranges of (id, hash of text), so no range is bound to one
    source, and each task holds one shard at a time: its frames and one text.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    n_shards = split_count(text_bytes(rows), shard_text_bytes)
    sample = hashed_sample(rows.where(F.octet_length("text") <= dictionary_row_bytes), dictionary_rows, "doc_id", "text", text="text")

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([text_encoder(tokenizer_path).serialized(t, (end_id,)) for t in batch.column(0).to_pylist()], pa.binary())], names=["ids"])

    samples = sorted(bytes(r[0]) for r in sample.select("text").mapInArrow(serialize, "ids binary").toLocalIterator())
    dictionary = train_dictionary(samples[: 2 * dictionary_rows], dictionary_bytes)
    dictionary_path = f"{folder}/{hashlib.sha256(dictionary).hexdigest()}.dict"
    put_file(dictionary_path, dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, compress = text_encoder(tokenizer_path), _compressor(dictionary).compress
        ids: list[int] = []
        frames: list[bytes] = []
        counts: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            data = shard_bytes(ids, frames, counts, dictionary, encoder.width)
            path = f"{folder}/{hashlib.sha256(data).hexdigest()}.qtok"
            put_file(path, data)
            row = pa.RecordBatch.from_pydict({"first_id": [ids[0]], "path": [path], "n_docs": [len(ids)], "n_tokens": [sum(counts)], "first_hash": [first_hash]}, schema=manifest_schema)
            ids.clear(), frames.clear(), counts.clear()
            return row

        first_hash = 0
        for batch in batches:
            for doc_id, text, order in zip(*(c.to_pylist() for c in batch.columns)):
                if not ids:
                    first_hash, held = order, 0
                raw = encoder.serialized(text, (end_id,))
                ids.append(NO_ID if doc_id is None else doc_id)
                frames.append(compress(raw))
                counts.append(len(raw) // encoder.width)
                held += len(raw)
                if held >= 4 * shard_text_bytes:
                    yield flush()
        if ids:
            yield flush()

    manifest_schema = pa.schema([("first_id", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_hash", pa.int64())])
    keyed = rows.withColumn("order", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), "order"]
    written = keyed.repartitionByRange(n_shards, *order).sortWithinPartitions(*order).mapInArrow(write, "first_id long, path string, n_docs long, n_tokens long, first_hash long")
    written.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def with_starts(manifest: DataFrame, per_block: int = 1000) -> DataFrame:
    """The manifest with start: tokens in all shards before. Sums of blocks come first, so no task orders more than a block or the blocks."""
    n_blocks = max(1, manifest.count() // per_block)
    m = manifest.repartitionByRange(n_blocks, "first_id", "first_hash", "path").withColumn("block", F.spark_partition_id())
    sums = m.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1))).select("block", F.coalesce("before", F.lit(0)).alias("before"))
    inner = F.sum("n_tokens").over(W.partitionBy("block").orderBy("first_id", "first_hash", "path").rowsBetween(W.unboundedPreceding, -1))
    return m.withColumn("inner", F.coalesce(inner, F.lit(0))).join(before, "block").select("path", "n_docs", "n_tokens", (F.col("before") + F.col("inner")).cast("long").alias("start"))


def read_token_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Read all documents of the shards in `manifest` back from their files.

    Returns doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers) and shard, a row for each document.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = functools.lru_cache(4)(lambda name: get_file(f"{folder}/{name}.dict"))
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(path, dictionary)
                tokens = shard.index["tokens"].astype("i8")
                crc = [zlib.crc32(shard.document(i).tobytes()) for i in range(len(shard))]
                starts = start + np.cumsum(tokens) - tokens
                ids = shard.index["doc_id"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=ids == NO_ID), pa.array(starts), pa.array(tokens), pa.array(crc, pa.int64()), pa.array([path.rpartition("/")[2]] * len(ids))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                )

    parts = max(1, min(manifest.count(), 4 * docs_parallelism(manifest)))
    return manifest.select("path", "start").repartition(parts).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def docs_parallelism(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write all documents as token shards below the shared folder, and return what reading them back gives."""
    folder = new_folder(docs.sparkSession, "tokens")
    manifest = write_token_shards(docs, folder, tokenizer_path, end_id)
    return read_token_shards(with_starts(manifest), folder)
