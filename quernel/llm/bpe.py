"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every byte prefix of a piece there is one token that its encoding ends
with. `PrefixEncoder` stores these last tokens: a token may follow the last
token of a shorter prefix if the two side by side encode to themselves, and
exactly one choice per prefix is compatible. A stored table answers for every
prefix, so bytes can be appended exactly, and after an edit only the table from
the edit onwards is made again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.chunks import Kept, chunks, given_back, held


class Vocabulary:
    """Ranks of a byte-level BPE; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[int, bool] = Kept(300_000)  # by left << 32 | right
        self._single: dict[int, bool] = {}
        self._spines: dict[int, tuple[list[bytes], list[bytes]]] = {}

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, piece: bytes) -> list[int]:
        """The encoding by repeated merging of the pair of lowest rank, leftmost first."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[x] for x in parts]

    def stands(self, token: int) -> bool:
        """Whether a token's bytes encode to the token."""
        if (known := self._single.get(token)) is None:
            known = self._single[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def allowed(self, left: int, right: int) -> bool:
        return self.stands(right) and self.follows(left, right)

    def spines(self, token: int) -> tuple[list[bytes], list[bytes]]:
        """The parts at a token's left and right edge as merging makes it, from one byte to the token."""
        if (known := self._spines.get(token)) is None:
            data = self.bytes_of[token]
            if len(data) == 1:
                known = [data], [data]
            else:
                left, right = self._halves(data)
                known = [*self.spines(self.ranks[left])[0], data], [*self.spines(self.ranks[right])[1], data]
            self._spines[token] = known
        return known

    def _halves(self, data: bytes) -> list[bytes]:
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """Whether two tokens that stand for themselves do so side by side.

        They don't if at some moment the part that ends the left token and the
        part that opens the right one would merge before either grows. Parts
        grow in the order of their ranks; among equal ranks the leftmost goes first.
        """
        if (known := self._pairs.get(left << 32 | right)) is not None:
            return known
        ranks, a, b, i, j, known = self.ranks, self.spines(left)[1], self.spines(right)[0], 0, 0, True
        while known:
            grow_a = ranks[a[i + 1]] if i + 1 < len(a) else 1 << 60
            grow_b = ranks[b[j + 1]] if j + 1 < len(b) else 1 << 60
            across = ranks.get(a[i] + b[j], 1 << 61)
            if across < grow_a and across <= grow_b:
                known = False
            elif grow_a == grow_b == 1 << 60:
                break
            elif grow_a <= grow_b:
                i += 1
            else:
                j += 1
        self._pairs.room(1)
        self._pairs[left << 32 | right] = known
        return known


class PrefixEncoder:
    """The table of last tokens of one piece.

    >>> e = PrefixEncoder(v).append(b"hel").append(b"lo")   # as if encoded at once
    >>> e.replace(1, 2, b"a")                               # keeps the table before byte 1
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]

    def append(self, more: bytes) -> PrefixEncoder:
        v, last = self.vocabulary, self.last
        ranks, longest, pairs, follows, stands = v.ranks, v.longest, v._pairs, v.follows, v.stands
        data = self.data = self.data + more
        for end in range(len(last), len(data) + 1):
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                token = ranks.get(data[start:end])
                if token is None:
                    continue
                known = pairs.get(last[start] << 32 | token)
                if known or known is None and stands(token) and (start == 0 or follows(last[start], token)):
                    break
            last.append(token)
        return self

    def replace(self, start: int, end: int, new: bytes) -> PrefixEncoder:
        """Put `new` in place of the bytes from start to end; the prefixes before it stay."""
        tail = self.data[end:]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        return self.append(new + tail)

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first `end` bytes, all by default."""
        at, out = len(self.data) if end is None else end, []
        while at > 0:
            out.append(self.last[at])
            at -= len(self.vocabulary.bytes_of[self.last[at]])
        return out[::-1]


#: Bytes of the openings that words share.
OPENING = 7


class Encoder:
    """Encodes texts: each match of `pattern` separately, whole tokens first."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, most_kept: int = 300_000):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.kept, self.last = Kept(most_kept), Kept(most_kept // 3)
        self.written = {i: str(i).encode() for i in vocabulary.bytes_of}

    def piece(self, piece: str) -> list[int]:
        """The ids of one match: the last tokens of its prefixes, those of an opening met before from memory.

        A prefix's last token is sought first where the prefix before has its
        own, then from the shortest on; only one is compatible, so the order
        in which they are tried changes nothing.
        """
        data = piece.encode()
        v = self.vocabulary
        ranks, length, pairs, allowed = v.ranks, v.length, v._pairs, v.allowed
        if (rank := ranks.get(data)) is not None:
            return [rank]
        if len(data) > 64:
            return PrefixEncoder(v).append(data).tokens()
        opening = data[:OPENING]
        known = self.last.get(opening) or self.last.again(opening)
        last = list(known) if known else [-1, ranks[data[:1]]]
        for end in range(len(last), len(data) + 1):
            first = end - 1 - length[last[-1]]
            token = ranks.get(data[first:end])
            if token is None or first and not ((ok := pairs.get(last[first] << 32 | token)) or ok is None and allowed(last[first], token)):
                for start in range(end - 1, -1, -1):
                    if start != first and (token := ranks.get(data[start:end])) is not None:
                        if not start or (ok := pairs.get(last[start] << 32 | token)) or ok is None and allowed(last[start], token):
                            break
            last.append(token)
        if not known and len(data) >= OPENING:
            self.last.room(1)
            self.last[opening] = tuple(last[: OPENING + 1])
        out, at = [], len(data)
        while at:
            out.append(token := last[at])
            at -= length[token]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        return [i for c in chunks(text) for p in self.find(c) for i in self.piece(p)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))

    def _known(self, chunk: str) -> tuple[bytes, bytes]:
        """The ids of a chunk or match in decimal, joined by commas, and the bytes that they decode to; short ones from memory."""
        if (known := self.kept.get(chunk)) is not None or (known := self.kept.again(chunk)) is not None:
            return known
        if len(found := self.find(chunk)) == 1:
            known = self._written(self.piece(found[0]))
        else:  # a match counts as a chunk if it is one match by itself too
            ids, decoded = zip(*(self._known(p) if self.find(p) == [p] else self._written(self.piece(p)) for p in found))
            known = b",".join(ids), b"".join(decoded)
        if len(chunk) <= 64:
            self.kept.room(1)
            self.kept[chunk] = known
        return known

    def _written(self, ids: list[int]) -> tuple[bytes, bytes]:
        return b",".join([self.written[i] for i in ids]), self.decode(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids joined by commas, sha256 of the bytes decoded from them."""
        parts = [c for c in chunks(text) if c]
        found = list(map(self.kept.get, parts))
        if None in found:
            found = [self._known(c) if x is None else x for c, x in zip(parts, found)]
        ids, decoded = zip(*found) if found else ((), ())
        joined = b",".join(ids)
        return joined.count(b",") + 1 if joined else 0, hashlib.sha256(joined).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()


def encoder_of(path: str, pattern: str, most_kept: int = 300_000) -> Encoder:
    """The encoder of a vocabulary file, made once a process."""
    return held(("bpe", path, pattern, most_kept), lambda: Encoder(Vocabulary.from_file(path), pattern, most_kept))


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", most_kept: int = 300_000) -> DataFrame:
    """Encode every text and decode the ids again; counts and digests of both.

    Returns id, n_tokens, ids_sha256, decoded_sha256, a row for each row of
    docs: repeated rows and null ids stay, a null text counts as empty (no ids;
    the digests of nothing), other columns of docs are left out whatever they
    are called. No shuffle: a row needs nothing but itself. ranks_path must
    lead to the vocabulary on every machine. most_kept bounds what a worker
    remembers, not what it gives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = encoder_of(ranks_path, pattern, most_kept).digest
        for batch in batches:
            rows = [digest(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        given_back()

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
