"""Numbers from hashes in numpy, for draws by the thousand million: those of `keys.hash_number`, many at a time."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

#: Numbers hashed together: all that share what comes before their last four digits.
TOGETHER = 10_000

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0)
_ADDED = (0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC, 0xCA62C1D6)


def _expanded(w):
    """The 80 words of a block from its first 16, in place; of numbers or of rows of numbers."""
    for t in range(16, 80):
        x = w[t - 3] ^ w[t - 8] ^ w[t - 14] ^ w[t - 16]
        w[t] = ((x << 1) | (x >> 31)) & 0xFFFFFFFF
    return w


@lru_cache(4)
def _last_digits(at: int) -> np.ndarray:
    """What the last four digits, from byte `at` of the block on, add to its 80 words: words are made by xor alone, so parts of a text can be put together after."""
    w, numbers = np.zeros((80, TOGETHER), np.uint32), np.arange(TOGETHER, dtype=np.uint32)
    for k in range(4):
        digit = numbers // np.uint32(10 ** (3 - k)) % np.uint32(10) + np.uint32(ord("0"))
        w[(at + k) // 4] |= digit << np.uint32(24 - 8 * ((at + k) % 4))
    return _expanded(w)


def _block(head: bytes) -> np.ndarray:
    """The first 48 bits of the SHA-1 of head and each four digits; the text has at most 55 bytes."""
    text = (head + bytes(4) + b"\x80").ljust(56, b"\0") + (8 * (len(head) + 4)).to_bytes(8, "big")
    first = _expanded([int.from_bytes(text[i : i + 4], "big") for i in range(0, 64, 4)] + [0] * 64)
    last, u = _last_digits(len(head)), np.uint32
    a, b, c, d, e = (np.full(TOGETHER, x, u) for x in _START)
    f, s = np.empty(TOGETHER, u), np.empty(TOGETHER, u)
    for t in range(80):
        np.bitwise_xor(last[t], u(first[t]), out=s)
        s += u(_ADDED[t // 20])
        s += e  # from here on e is free
        if t < 20:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif 40 <= t < 60:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_xor(b, d, out=e)
            f &= e
            f ^= d
        else:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        s += f
        np.left_shift(a, u(5), out=f)
        np.right_shift(a, u(27), out=e)
        f |= e
        s += f
        np.left_shift(b, u(30), out=f)
        b >>= u(2)
        b |= f
        a, b, c, d, e, s = s, a, b, c, d, e
    a += u(_START[0])
    b += u(_START[1])
    return (a.astype(np.uint64) << np.uint64(16)) | (b >> u(16))


def hash_numbers(seed: int | str, first: int, last: int) -> np.ndarray:
    """keys.hash_number(seed, i) of i from first, not below 0, to last - 1, as uint64."""
    out = np.empty(max(last - first, 0), np.uint64)
    for high in range(first // TOGETHER, -(-last // TOGETHER)):
        low, above = max(first, high * TOGETHER), min(last, (high + 1) * TOGETHER)
        head = f"{seed}:{high}".encode()
        if high and len(head) <= 51:
            some = _block(head)[low - high * TOGETHER : above - high * TOGETHER]
        else:  # fewer digits, or a text of more than one block
            some = [int.from_bytes(hashlib.sha1(f"{seed}:{i}".encode()).digest()[:6], "big") for i in range(low, above)]
        out[low - first : above - first] = some
    return out
