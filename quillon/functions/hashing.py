"""Randomness from key hashes: the same on every run, partitioning and engine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_int(key: Column, digits: int = 12, algorithm: str = "md5") -> Column:
    """The first ``digits`` hex digits of the key's digest as a long (12 digits: 48 bits)."""
    digest = F.md5(key) if algorithm == "md5" else F.sha2(key, 256)
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def seed48(row_id: Column, condition: str | Column, seed: int | Column) -> Column:
    """Seed of one (row, condition, seed): 48 bits of SHA-256 of ``id|condition|seed``."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(str(x))
    return hash_int(F.concat_ws("|", row_id, as_col(condition), as_col(seed)), 12, "sha2")


def uniform(key: Column) -> Column:
    """A uniform number in (0, 1) from the key's digest."""
    return (hash_int(key) + F.lit(0.5)) / F.lit(float(1 << 48))


def hash_index(key: Column, n: Column | int, digits: int = 8) -> Column:
    """``int(sha256(key)[:digits], 16) % n``."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(hash_int(key, digits, "sha2"), n.cast("long"))


#: MD5's constants, left rotations and words by step.
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [x for xs in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in xs * 4]
_WORDS = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Digests computed at once: enough to hide numpy's cost per call.
BATCH = 1 << 15


def _md5_ints(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """``hash_int`` of ``n`` padded messages of one block, given as 16 words, each a number or an array of uint32."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, high = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        word = words[_WORDS[i]]
        a += f
        if isinstance(word, np.ndarray):
            a += word
            word = 0
        a += np.uint32((_ADDED[i] + word) & 0xFFFFFFFF)
        np.right_shift(a, np.uint32(32 - _TURNS[i]), out=high)
        a <<= np.uint32(_TURNS[i])
        a |= high
        a += b
        a, d, c, b = d, c, b, a
    first, second = ((x + np.uint32(y)).byteswap().astype(np.int64) for x, y in ((a, _START[0]), (b, _START[1])))
    return first << 16 | second >> 16


def _same_width(first: int, last: int) -> Iterator[tuple[int, int, int]]:
    """The numbers from ``first`` to ``last`` (excluded), cut by their number of digits."""
    while first < last:
        digits = len(str(first))
        yield first, min(last, 10**digits), digits
        first = min(last, 10**digits)


def _words(numbers: np.ndarray, digits: int, at: int, fixed: dict[int, bytes]) -> np.ndarray:
    """The 14 words of blocks of zeros, as rows, with each number's digits from byte ``at`` and the fixed bytes."""
    text = np.zeros((len(numbers), 56), np.uint8)
    for x in range(digits):
        text[:, at + x] = 48 + numbers // 10 ** (digits - 1 - x) % 10
    for x, part in fixed.items():
        text[:, x : x + len(part)] = np.frombuffer(part, np.uint8)
    return np.ascontiguousarray(text.view("<u4").T)


def draw_ints(seed: int, first: int, last: int, k: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``hash_int(seed|b|j)`` of each replicate b from ``first`` to ``last`` (excluded) and each draw j below ``k``, as
    (first b, first j, array of replicates x draws), in pieces of ``BATCH`` or less; those of a replicate by rising j.

    Replicate and draw fill different bytes of a message, so each is written once and their words are added."""
    head = f"{seed}|".encode()
    for b0, b1, wide in _same_width(first, last):
        for j0, j1, digits in _same_width(0, k):
            at, size = len(head) + wide + 1, len(head) + wide + 1 + digits
            if size > 55:
                raise ValueError("seed, replicate and draw don't fit one block of MD5")
            draws = min(j1 - j0, BATCH)
            of_b = _words(np.arange(b0, b1), wide, len(head), {0: head, at - 1: b"|", size: b"\x80"})
            for j in range(j0, j1, draws):
                of_j = _words(np.arange(j, min(j + draws, j1)), digits, at, {})
                written = of_j.any(axis=1)
                for b in range(b0, b1, step := max(1, BATCH // draws)):
                    bs = of_b[:, b - b0 : b - b0 + step]
                    shape = bs.shape[1], of_j.shape[1]
                    words = [(x[:, None] + y).ravel() if w or len(x) > 1 else int(x[0]) for x, y, w in zip(bs, of_j, written)]
                    yield b, j, _md5_ints([*words, 8 * size, 0], shape[0] * shape[1]).reshape(shape)
