"""Frequency tables and the range coder.

Defined results: no data gives the four bytes of the coder's end, and no bytes back; counts that are all zero stay so and code nothing, and decoding bytes
with them, or with a total beyond the coder's smallest range, raises ValueError;
data cut short decodes as if zeros followed; lengths are not bounded. Symbols with a count of zero can't be encoded.
"""

from __future__ import annotations

import bisect

import numpy as np

# Fixed values of the format.
#: Totals above this are scaled down before coding.
MOST = 1 << 19
TOP, BOTTOM, SHIFT = 1 << 31, 1 << 23, 23


def clamped(counts: np.ndarray) -> np.ndarray:
    """Counts whose total is at most MOST; none that is positive becomes zero."""
    total = int(counts.sum())
    if total <= MOST:
        return counts
    out = np.trunc(counts * (MOST / total)).astype(np.int64)
    out[(out == 0) & (counts > 0)] = 1
    left = MOST - int(out.sum())
    while left:
        some = np.flatnonzero(out > 1)
        step = some[: abs(left)]
        out[step] += np.sign(left)
        left -= int(np.sign(left)) * len(step)
    return out


def rescaled(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Counts whose total is the next power of two, and its exponent.

    What truncation leaves goes round the symbols below 128 that occur; where there are none, round all that occur.
    """
    n = int(counts.sum())
    if not n:
        return counts.astype(np.int64), 0
    scale = max(0, (n - 1).bit_length())
    t = 1 << scale
    if t == n:
        return counts.astype(np.int64), scale
    out = np.trunc(counts * (t / n)).astype(np.int64)
    some = np.flatnonzero(out[:128])
    some = some if len(some) else np.flatnonzero(out)
    left = t - int(out.sum())
    out[some] += left // len(some) + (np.arange(len(some)) < left % len(some))
    return out, scale


def encode(data: bytes, counts: np.ndarray) -> bytes:
    """The bytes of ``data``, coded with the frequencies ``counts``."""
    freq, scale = rescaled(counts)
    cum = [0, *np.cumsum(freq).tolist()]
    out, low, size = bytearray(), 0, TOP

    def carry() -> None:
        at = len(out) - 1
        while out[at] == 255:
            out[at] = 0
            at -= 1
        out[at] += 1

    for s in data:
        unit = size >> scale
        low += unit * cum[s]
        size = size - unit * cum[255] if s == 255 else unit * (cum[s + 1] - cum[s])
        if size <= BOTTOM:
            if low & TOP:
                carry()
                low -= TOP
            while size <= BOTTOM:
                out.append(low >> SHIFT)
                low = (low & (BOTTOM - 1)) << 8
                size <<= 8
    if low & TOP:
        carry()
        low -= TOP
    return bytes(out) + (low << 1).to_bytes(4, "big")


def decode(data: bytes, counts: np.ndarray, length: int) -> bytes:
    """``length`` bytes; raises ValueError for counts that nothing can have been coded with."""
    if length and not 0 < sum(counts.tolist()) <= BOTTOM:
        raise ValueError("frequencies that code nothing")
    freq, scale = rescaled(counts)
    cum = [0, *np.cumsum(freq).tolist()]
    starts = cum[:256]
    stream = data + bytes(8)
    low, at, size, out = int.from_bytes(stream[:4], "big") >> 1, 4, TOP, bytearray(length)
    odd = stream[3] & 1  # the bit that the first four bytes have beyond 31
    for i in range(length):
        unit = size >> scale
        s = min(255, bisect.bisect_right(starts, low // unit) - 1)
        out[i] = s
        low -= unit * cum[s]
        size = size - unit * cum[255] if s == 255 else unit * (cum[s + 1] - cum[s])
        while size <= BOTTOM:
            byte = stream[at] if at < len(stream) else 0
            low = low << 8 | odd << 7 | byte >> 1
            odd = byte & 1
            at += 1
            size <<= 8
    return bytes(out)
