"""Zero-run encoding of byte streams at levels 1 and 3, and the choice among them.

At level L a run of n >= L zeros is written as L zeros and the run byte of n - L; runs longer than L + 255 are written in
pieces. Shorter runs stay as they are.

Defined results: no bytes give none, both ways, and level -1; runs and streams of any length are encoded whole; a stream that ends within a
run's zeros decodes to those that are there.
"""

from __future__ import annotations

import numpy as np

from .codes import RUN_PIECE, run_byte, run_extra


def zero_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of zeros."""
    edge = np.diff(np.concatenate([[0], (data == 0).astype(np.int8), [0]]))
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


def _run(n: int, level: int) -> bytes:
    most = level + RUN_PIECE
    pieces = (n - 1) // most
    rest = n - pieces * most
    out = (bytes(level) + bytes([run_byte(RUN_PIECE)])) * pieces
    return out + (bytes(level) + bytes([run_byte(rest - level)]) if rest >= level else bytes(rest))


def encode(data: bytes, level: int) -> bytes:
    x = np.frombuffer(data, np.uint8)
    out, last = [], 0
    for s, n in zip(*map(np.ndarray.tolist, zero_runs(x)), strict=True):
        out += [data[last:s], _run(n, level)]
        last = s + n
    return b"".join([*out, data[last:]])


def decode(data: bytes, level: int) -> bytes:
    """Levels 1, 2 and 3."""
    out, at, mark = [], 0, bytes(level)
    while (s := data.find(mark, at)) >= 0 and s + level < len(data):
        out += [data[at : s + level], bytes(run_extra(data[s + level]))]
        at = s + level + 1
    return b"".join([*out, data[at:]])


def encoded_length(data: np.ndarray, level: int) -> int:
    """The length that ``encode`` gives, from the runs alone."""
    _, n = zero_runs(data)
    most = level + RUN_PIECE
    pieces = (n - 1) // most
    rest = n - pieces * most
    return len(data) - int(n.sum()) + int((pieces * (level + 1) + np.where(rest >= level, level + 1, rest)).sum())


def choose_level(data: np.ndarray) -> int:
    """-1 if all bytes but the first are zero, 0 for none, 1 or 3."""
    if not data[1:].any():
        return -1
    n, short = len(data), encoded_length(data, 3)
    if n * 197 // 200 <= short:
        return 0
    if short * 100 // n <= 32 and encoded_length(data, 1) < short * 98 // 100:
        return 1
    return 3
