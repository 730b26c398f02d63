"""Integer codes: run bytes, and the bit code of frequency headers.

Defined results: counts that are all zero are a header like others; a header cut short, or empty, raises ValueError, one with a count beyond
63 bits OverflowError; what follows a header is ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

RUN_PIECE = 255


def run_byte(extra: int) -> int:
    """The byte for ``extra`` zeros (0 to 255) beyond a level's own: even counts go up from 0, odd ones down from 255."""
    return extra // 2 if extra % 2 == 0 else 256 - (extra + 1) // 2


def run_extra(byte: int) -> int:
    return 2 * byte if byte < 128 else 511 - 2 * byte


@lru_cache(maxsize=64)
def length_bits(n: int) -> str:
    """The number ``n`` as a sum of non-adjacent Fibonacci numbers, lowest first, ended by a second 1 in a row."""
    series = [1, 2]
    while series[-1] <= n:
        series.append(series[-1] + series[-2])
    digits = ""
    for f in reversed(series[:-1] if n < series[-1] else series):
        digits = ("1" if f <= n else "0") + digits
        n -= f if f <= n else 0
    return digits.rstrip("0") + "1"


@lru_cache(maxsize=4096)
def _bits(x: int) -> str:
    """x >= 1: its bit length, then its bits below the leading one."""
    return length_bits(x.bit_length()) + bin(x)[3:]


def encode_counts(counts: np.ndarray) -> bytes:
    """256 counts as a bit string: each count plus one; after a zero also the length of the run of zeros it begins."""
    out, next_one = [], 0
    some = np.flatnonzero(counts)
    for s, n in zip([*some.tolist(), 256], [*np.asarray(counts)[some].tolist(), None], strict=True):
        if s > next_one:
            out += [_bits(1), _bits(s - next_one)]
        if n is not None:
            out.append(_bits(int(n) + 1))
        next_one = s + 1
    bits = "".join(out)
    size = -(-len(bits) // 8)
    return int(bits.ljust(8 * size, "0"), 2).to_bytes(size, "big")


def decode_counts(data: bytes) -> tuple[np.ndarray, int]:
    """The 256 counts at the beginning of ``data``, and the number of bytes they take."""
    bits = bin(int.from_bytes(b"\1" + data[:1200], "big"))[3:]
    at = 0

    def number() -> int:
        nonlocal at
        end = bits.index("11", at)
        low, high, n = 1, 2, 0
        for c in bits[at : end + 1]:
            n += low if c == "1" else 0
            low, high = high, low + high
        at = end + 2
        x = int("1" + bits[at : at + n - 1], 2)
        at += n - 1
        return x

    counts, s = np.zeros(256, np.int64), 0
    while s < 256:
        counts[s] = number() - 1
        s += 1 if counts[s] else number()
    return counts, -(-at // 8)
