"""First 32 bits of the MD5 of many short strings that differ little, by Numpy: the hash-weighted bootstrap
takes one for every row and replicate. The strings of one call are a prefix common to all, then
their own bytes; whole blocks of the strings are worked through in step."""

from __future__ import annotations

import math

import numpy as np

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


LANES = 1 << 14  # strings worked on at once


def padded(strings: list[bytes], before: int, skipped: int = 0) -> np.ndarray:
    """Strings of one number of blocks, with their padding, as they stand after ``before`` bytes of prefix (zero here)
    and ``skipped`` bytes of blocks that are done: an array (words of all blocks, strings)."""
    out = np.zeros((len(strings), 64 * blocks_of(len(strings[0]), before)), dtype=np.uint8)
    for row, s in zip(out, strings):
        end = before + len(s)
        row[before:end] = np.frombuffer(s, dtype=np.uint8)
        row[end] = 0x80
        row[-8:] = np.frombuffer((8 * (skipped + end)).to_bytes(8, "little"), dtype=np.uint8)
    return np.ascontiguousarray(out.view("<u4").T)


def blocks_of(length: int, before: int) -> int:
    """64-byte blocks of a string after a prefix, with its padding."""
    return (before + length + 8) // 64 + 1


def _block(state: list, words: list, shape: tuple[int, int]) -> list:
    a, b, c, d = state
    f, spare = np.empty(shape, np.uint32), [np.empty(shape, np.uint32) for _ in range(5)]
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        shift = _SHIFTS[kind][i % 4]
        f += a
        f += words[g] + _SINES[i]
        turned = spare[i % 5]
        np.left_shift(f, np.uint32(shift), out=turned)
        f >>= np.uint32(32 - shift)
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    return [x + y for x, y in zip(state, (a, b, c, d))]


def md5_states(prefixes: list[bytes], words: np.ndarray, state: list | None = None) -> list:
    """The four state words, arrays (prefixes, strings), after the blocks of prefix + string for prefixes of one
    length; ``words`` from :func:`padded`."""
    n = (len(prefixes[0]) + 3) // 4
    heads = np.stack([np.frombuffer(p.ljust(4 * n, b"\0"), dtype="<u4") for p in prefixes]) if n else None
    shape = (len(prefixes), words.shape[1])
    state = [np.full(shape, s, dtype=np.uint32) for s in _START] if state is None else state
    for first in range(0, len(words), 16):
        state = _block(state, [w[None] | heads[:, first + k, None] if first + k < n else w[None]
                               for k, w in enumerate(words[first:first + 16])], shape)
    return state


def md5_heads(prefixes: list[bytes], words: np.ndarray, state: list | None = None) -> np.ndarray:
    """First 32 bits of md5(prefix + string), as the number their eight hex digits stand for."""
    return md5_states(prefixes, words, state)[0].byteswap()
