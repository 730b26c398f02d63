"""Long repeats by a Burrows-Wheeler transform.

``repeats`` sorts the suffixes of a text to a depth beyond the wanted length, takes the transform of that order, and
finds common prefixes by increasing value: breadth first, the interval of a string on the transform is
extended backward by each byte in it, and the end of a longer string's interval is a place where neighbouring suffixes
have that many bytes in common, if none was found there before. The first eight bytes, by which suffixes are sorted first, show
neighbours' shorter common prefixes, so the search begins with strings of that length. It stops at the wanted length; neighbours
without such a place have at least that many bytes in common.

Defined results: a text of zero bytes alone, or one shorter than the length, has no two suffixes in a group; equal suffixes are
one group in any order; texts may be as long as 32-bit numbers can count; there are no nulls and no columns here, and an empty text
is not one (it must end in a zero byte).
"""

from __future__ import annotations

import numpy as np

from .common import ragged


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys, where the run of equal ones that each is in begins, and which are not alone in theirs."""
    new = np.append(True, key[1:] != key[:-1])
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)), ~(new & np.append(new[1:], True))


def _first_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as numbers; zeros beyond the end."""
    padded = np.append(text, np.zeros(8, np.uint8))
    return np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (len(text),), (1,), writeable=False).astype(np.uint64)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first ``depth`` bytes at least; ``text`` ends in zeros beyond its end.

    After the first sort only suffixes that still equal others are sorted again, in the rows that they have together.
    """
    n = len(text)
    key = _first_bytes(text)
    known, most = 8, (n + 1).bit_length()
    parts = max(2, min(3, 64 // most))  # ranks that fit in a key
    order = np.argsort(key)
    begin, several = _groups(key[order])
    rank = np.zeros(n + 1, np.uint32)  # the last one is that of all places beyond the end
    rank[order] = begin + 1
    rows = np.flatnonzero(several)
    while known < depth and len(rows):
        at = order[rows]
        key = rank[at].astype(np.uint64) << np.uint64(most * (parts - 1))
        for i in range(1, parts):
            key |= rank[np.minimum(at + i * known, n)].astype(np.uint64) << np.uint64(most * (parts - 1 - i))
        by = np.argsort(key)
        begin, several = _groups(key[by])
        order[rows] = at = at[by]
        rank[at] = rows[begin] + 1
        rows = rows[several]
        known *= parts
    return order


def repeats(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and where in it groups of suffixes that share their first ``least`` bytes begin.

    Zero bytes separate strings: groups are right for suffixes without one among their first ``least`` bytes. The
    text must end in a zero byte.
    """
    n = len(text)
    order = suffix_order(text, least + 1)
    transform = text[order - 1]
    by = np.argsort(transform, kind="stable").astype(np.int32)  # by[LF(k)] = k
    lf = np.empty(n, np.int32)
    lf[by] = np.arange(n, dtype=np.int32)
    same = transform[by][1:] == transform[by][:-1]
    after, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)  # the next and last row with the same byte
    after[by[:-1][same]] = by[1:][same]
    before[by[1:][same]] = by[:-1][same]
    # Extending by a zero byte is of no use: rows with one are as if they were the same byte's only ones, nowhere.
    zero = transform == 0
    after[zero], before[zero] = -1, n
    known = min(8, least)
    key = _first_bytes(text)[order] >> np.uint64(8 * (8 - known))
    differ = np.append(key[1:] ^ key[:-1], np.uint64(1 << 63))
    found = np.append(True, differ > 0)
    # Strings of ``known`` bytes whose next neighbour has all but the last of them; what is found later is found from these.
    edges = np.flatnonzero(found)
    begin, end = edges[:-1], edges[1:]
    fresh = differ[end - 1] < 256
    for i in range(known):
        fresh &= (key[begin] >> np.uint64(8 * i)) & np.uint64(255) > 0
    begin, end = begin[fresh], end[fresh]
    for _ in range(known, least):
        if not len(begin):
            break
        row = ragged(begin, end - begin)
        size = end - begin
        last = after[row] >= np.repeat(end, size)
        first = before[row] < np.repeat(begin, size)
        ends = np.sort(lf[row[last]]).astype(np.int64) + 1
        begins = np.sort(lf[row[first]]).astype(np.int64)
        new = ~found[ends]
        found[ends] = True
        begin, end = begins[new], ends[new]
    return order, np.flatnonzero(found[:n])
