"""md5 of many short keys at once, for draws that replay by md5 in any engine.

A key is a head, such as a stage and a repetition, and a tail, such as a photograph. All tails go together on
arrays of 32-bit words, one array operation for each operation of the digest; a key of more than one block of
the digest is left to hashlib.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5
from math import floor, sin

import numpy as np

ROWS = 16384  # keys in one array operation: what stays in the processor's cache
NUMBERS = 25_000  # numbers in one array operation, a part of ENDS
ENDS = 100_000  # numbers from here on end in that many digits, which come again
ONE_BLOCK = 55  # bytes of a key that fit a block of the digest
_ADD = [floor(abs(sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MASK = 2**32 - 1
_ADDED, _LEFT, _RIGHT = ([np.array(x, np.uint32) for x in of] for of in (_ADD, _TURN, [32 - t for t in _TURN]))


def _step(i: int, a: int, b: int, c: int, d: int, word: int) -> tuple[int, int, int, int]:
    """One operation of the digest on plain numbers."""
    f = d ^ (b & (c ^ d)) if i < 16 else c ^ (d & (b ^ c)) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | (d ^ _MASK))
    f = (f + a + _ADD[i] + word) & _MASK
    return d, (b + (f << _TURN[i] | f >> (32 - _TURN[i]))) & _MASK, b, c


def _one_block(words: list, n: int) -> np.ndarray:
    """The first 64 bits of the digests of n blocks; a word is an array, or a number where all blocks agree.

    What comes before the first array is worked out once. Constants are arrays without dimensions, which cost a
    call half as much as numbers.
    """
    state, begin = _START, 0
    while begin < 64 and isinstance(words[_WORD[begin]], int):
        state = _step(begin, *state, words[_WORD[begin]])
        begin += 1
    a, b, c, d = (np.full(n, x, np.uint32) for x in state)
    f, left = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(begin, 64):
        if i < 16:
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif i < 32:
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif i < 48:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        word, add = words[_WORD[i]], _ADDED[i]
        if not isinstance(word, int):
            np.add(f, word, f)
        elif word:
            add = np.array((_ADD[i] + word) & _MASK, np.uint32)
        np.add(f, add, f)
        np.add(f, a, f)
        np.left_shift(f, _LEFT[i], left)
        np.right_shift(f, _RIGHT[i], f)
        np.bitwise_or(f, left, f)
        np.add(f, b, f)
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()


class Tails:
    """Tails of keys, laid out once for every length of a head."""

    def __init__(self, tails: list[bytes]):
        self.tails, self.n = tails, len(tails)
        self.sizes = np.array([len(t) for t in tails], np.int64)
        self.laid = {}

    def _lay(self, size: int) -> tuple[list, np.ndarray]:
        """(words of the blocks with the first `size` bytes blank, rows too long for a block)."""
        if size not in self.laid:
            long = np.flatnonzero(self.sizes + size > ONE_BLOCK)
            rows = [t if len(t) + size <= ONE_BLOCK else b"" for t in self.tails]
            blocks = np.zeros((self.n, 64), np.uint8)
            width = max(map(len, rows), default=0) + 1
            text = b"".join((t + b"\x80").ljust(width, b"\0") for t in rows)
            blocks[:, size : size + width] = np.frombuffer(text, np.uint8).reshape(self.n, width)
            bits = np.array([8 * (len(t) + size) for t in rows], "<u4")
            blocks[:, 56:60] = bits.view(np.uint8).reshape(self.n, 4)
            words = [np.ascontiguousarray(w) for w in blocks.view("<u4").T]
            self.laid[size] = [int(w[0]) if self.n and (w == w[0]).all() else w for w in words], long
        return self.laid[size]

    def heads(self, head: bytes) -> np.ndarray:
        """The first 64 bits of md5(head + tail) of every tail, as unsigned numbers."""
        if len(head) > ONE_BLOCK:
            return np.array([_head64(head + t) for t in self.tails], np.uint64)
        laid, long = self._lay(len(head))
        full = head.ljust(64, b"\0")
        ahead = [int.from_bytes(full[i : i + 4], "little") for i in range(0, 64, 4)]
        words = [w + x if isinstance(w, int) else (w | np.uint32(x) if x else w) for w, x in zip(laid, ahead)]
        out = _one_block(words, self.n)
        for i in long:
            out[i] = _head64(head + self.tails[i])
        return out


def _head64(key: bytes) -> int:
    return int.from_bytes(md5(key).digest()[:8], "big")


def in_blocks(tails: list[bytes], rows: int = ROWS) -> Iterator[tuple[int, Tails]]:
    """(first row, tails) of stretches that are digested together."""
    for first in range(0, len(tails), rows):
        yield first, Tails(tails[first : first + rows])


@lru_cache(maxsize=16)
def _ends(first: int, n: int, width: int) -> Tails:
    return Tails([str(i).zfill(width).encode() for i in range(first, first + n)])


def of_numbers(head: bytes, n: int) -> Iterator[np.ndarray]:
    """The first 64 bits of md5(head + number) of the numbers below n in their order, some at a time.

    Numbers share what is laid out for their last digits.
    """
    for first in range(0, n, NUMBERS):
        high, low = divmod(first, ENDS)
        ends = _ends(low, min(NUMBERS, n - first), len(str(ENDS)) - 1 if high else 0)
        yield ends.heads(head + b"%d" % high if high else head)
