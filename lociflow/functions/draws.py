"""The random numbers of keys.unit_hash for long runs of draws, in numpy inside tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Draws made at a time, whose arrays stay in a core's cache.
BATCH = 1 << 16
START = tuple(map(np.uint32, (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)))
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
PICKS = [i for i in range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [7 * i % 16 for i in range(16)]


def _block(state: tuple, words: list, n: int) -> tuple:
    """md5's state after a block of 16 words, each of which is a number or an array of n."""
    a, b, c, d = (np.full(n, x) if np.ndim(x) == 0 else x.copy() for x in state)
    f, turned = np.empty(n, np.uint32), np.empty(n, np.uint32)
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
        f += a
        word = words[PICKS[i]]
        if isinstance(word, int):
            f += np.uint32((word + SINES[i]) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(SINES[i])
        np.left_shift(f, TURNS[i], out=turned)
        f >>= np.uint32(32 - TURNS[i])
        f |= turned
        f += b
        a, d, c, b, f = d, c, b, f, a
    return tuple(x + y for x, y in zip((a, b, c, d), state, strict=True))


def _hashes(head: bytes, i: np.ndarray, digits: int) -> np.ndarray:
    size = len(head) + digits
    blocks = (size + 8) // 64 + 1
    padded = head + bytes(digits) + b"\x80" + bytes(64 * blocks - size - 9) + (8 * size).to_bytes(8, "little")
    words = [int.from_bytes(padded[k : k + 4], "little") for k in range(0, len(padded), 4)]
    rest = i
    for at in range(size - 1, len(head) - 1, -1):
        rest, digit = rest // np.uint32(10), rest
        words[at // 4] = words[at // 4] + (digit - rest * np.uint32(10) + np.uint32(48) << np.uint32(8 * (at % 4)))
    words = [w if isinstance(w, np.ndarray) else int(w) for w in words]
    state = START
    for k in range(blocks):
        state = _block(state, words[16 * k : 16 * k + 16], len(i))
    first, second = state[0].byteswap().astype(np.uint64), state[1].astype(np.uint16).byteswap()
    return ((first << np.uint64(16)) | second).astype(np.float64) / 2.0**48


def unit_hashes(head: str, n: int) -> Iterator[np.ndarray]:
    """unit_hash of "head/i" for each i from 0 to before n, in batches; n is up to 2 ** 32."""
    at = 0
    while at < n:
        digits = len(str(at))
        to = min(n, at + BATCH, 10**digits)  # numbers of as many digits
        yield _hashes(f"{head}/".encode(), np.arange(at, to, dtype=np.uint32), digits)
        at = to
